"""Count regressions.

Fits with predictors carry Newton's method in SQL; the tests also check them by simulation and
against Spark ML.
"""

from pyspark.sql import functions as F

from fieldtally.operators import cells as c
from fieldtally.operators.counts import _Z94 as Z94
from fieldtally.operators.counts import fit_poisson, fit_zip
from fieldtally.operators.posterior import draw_posterior, summarise_draws
from fieldtally.plans.modeling import (
    STANDARDISED, WEATHER_PREDICTORS, run_spatial_model, run_weather_model, weather_model_frame,
)

from .base import PHOTOS_SQL, Registry, load, photos, rounded
from .cells import CELL, heights, placed, ship_span
from .daily import DAILY_SQL, dataset

registry = Registry()


def zip_summary_sql(frame: str, predictors: list[str], target: str, with_sql: str, steps: int = 25) -> str:
    """Zero-inflated Poisson regression with the default priors, by Newton's method in SQL.

    ``frame`` is a table of ``with_sql``. Each step sums gradient and information over
    the frame and solves for the step by Gauss-Jordan elimination, written out.
    """
    p = len(predictors) + 1
    n = p + 1
    t = [f"t{i}" for i in range(n)]
    x = ["x0", *[f"x{i}" for i in range(1, p)]]

    def system(source: str) -> str:
        """The rows of -H and of the gradient at each point of ``source``."""
        eta = " + ".join(f"{a} * {b}" for a, b in zip(t, x))
        rows = f"""SELECT *, CASE WHEN y > 0 THEN 1 ELSE psi * exp(-mu) / (1 - psi + psi * exp(-mu)) END AS r
          FROM (SELECT *, exp({eta}) AS mu, 1 / (1 + exp(-{t[p]})) AS psi FROM {source}, fr)"""
        rows = f"SELECT *, r * (1 - r) AS v, y - r * mu AS slope, r * (1 - r) * mu * mu - r * mu AS curve FROM ({rows})"
        cells = []
        for i in range(p):
            cells.append(f"sum(slope * {x[i]}) - {t[i]} AS b{i}")
            for j in range(p):
                cells.append(f"-sum(curve * {x[i]} * {x[j]}) + {int(i == j)} AS a{i}_{j}")
            for a in (f"a{i}_{p}", f"a{p}_{i}"):
                cells.append(f"sum(mu * v * {x[i]}) AS {a}")
        cells.append(f"sum(r - psi) + 1 - 2 * any_value(psi) AS b{p}")
        cells.append(f"-sum(v - psi * (1 - psi)) + 2 * any_value(psi * (1 - psi)) AS a{p}_{p}")
        return f"SELECT k, {', '.join(t)}, {', '.join(cells)} FROM ({rows}) GROUP BY k, {', '.join(t)}"

    def solved(query: str, right: list[str]) -> str:
        """Eliminate all columns of a; ``right`` are the prefixes of the right-hand sides."""
        columns = [f"a{{}}_{j}" for j in range(n)] + [r + "{}" for r in right]
        for c in range(n):
            out = []
            for i in range(n):
                for name in columns:
                    mine, pivot = name.format(i), f"({name.format(c)} / a{c}_{c})"
                    out.append(f"{pivot} AS {mine}" if i == c else f"{mine} - a{i}_{c} * {pivot} AS {mine}")
            query = f"SELECT k, {', '.join(t)}, {', '.join(out)} FROM ({query})"
        return query

    ident = ", ".join(f"CAST({int(i == j)} AS DOUBLE) AS e{j}_{i}" for i in range(n) for j in range(n))
    moved = ", ".join(f"{t[i]} + b{i} * shrink" for i in range(n))
    largest = "greatest(" + ", ".join(f"abs(b{i})" for i in range(n)) + ")"
    names = ["alpha", *[f"betas[{i}]" for i in range(p - 1)]]
    labels = ["intercept", *predictors]
    sd = [f"sqrt(e{i}_{i})" for i in range(n)]
    psi = f"1 / (1 + exp(-{t[p]}))"
    lines = [
        f"SELECT '{names[i]}' AS parameter, {i} AS position, '{labels[i]}' AS label, round({t[i]}, 4) AS mean, round({sd[i]}, 4) AS sd,"
        f" round({t[i]} - {Z94} * {sd[i]}, 4) AS low, round({t[i]} + {Z94} * {sd[i]}, 4) AS high FROM spread"
        for i in range(p)
    ]
    lines.append(
        f"SELECT 'psi', {p}, 'poisson share', round({psi}, 4), round({psi} * (1 - {psi}) * {sd[p]}, 4),"
        f" round(1 / (1 + exp(-({t[p]} - {Z94} * {sd[p]}))), 4), round(1 / (1 + exp(-({t[p]} + {Z94} * {sd[p]}))), 4) FROM spread"
    )
    fr = ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(predictors, 1))
    share = "least(greatest(avg((y > 0)::INTEGER), 0.05), 0.95)"
    return f"""WITH RECURSIVE {with_sql},
fr AS MATERIALIZED (SELECT CAST(1 AS DOUBLE) AS x0, {fr}, CAST({target} AS DOUBLE) AS y FROM {frame}),
step(k, {', '.join(t)}) AS (
  SELECT 0, ln(avg(y) FILTER (y > 0)), {', '.join(['CAST(0 AS DOUBLE)'] * (p - 1))}, ln({share} / (1 - {share})) FROM fr
  UNION ALL
  SELECT k + 1, {moved} FROM (SELECT *, least(1, 5 / {largest}) AS shrink FROM ({solved(system('step'), ['b'])})) WHERE k < {steps}),
fit AS (SELECT * FROM step ORDER BY k DESC LIMIT 1),
spread AS ({solved('SELECT *, ' + ident + ' FROM (' + system('fit') + ')', [f'e{j}_' for j in range(n)])})
{' UNION ALL '.join(lines)}"""


def summary_of(summary):
    """The summary, its numbers rounded."""
    out = summary.withColumnsRenamed({"hdi_3%": "low", "hdi_97%": "high"})
    return rounded(out, 4, "mean", "sd", "low", "high")

HOURS_SQL = """hours AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS count FROM events GROUP BY 1),
x AS (SELECT count, CASE WHEN hour(hour) >= 12 THEN 1 ELSE 0 END AS afternoon FROM hours)"""


def hours(spark, sf_dir):
    per_hour = load(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("count"))
    return per_hour.withColumn("afternoon", (F.hour("hour") >= 12).cast("int"))


@registry.add(f"""WITH {HOURS_SQL},
s AS (SELECT avg(count) FILTER (afternoon = 0) AS m0, avg(count) FILTER (afternoon = 1) AS m1,
             sum(count) FILTER (afternoon = 0) AS s0, sum(count) FILTER (afternoon = 1) AS s1 FROM x)
SELECT 'alpha' AS parameter, round(ln(m0), 6) AS mean, round(sqrt(1 / s0), 6) AS sd FROM s
UNION ALL SELECT 'betas[0]', round(ln(m1 / m0), 6), round(sqrt(1 / s0 + 1 / s1), 6) FROM s""")
def poisson_fit(spark, sf_dir):
    model = fit_poisson(hours(spark, sf_dir), ["afternoon"], "count", prior_sd=None)
    return rounded(model.summary(spark), 6, "mean", "sd").select("parameter", "mean", "sd")


ZIP_COUNTS_SQL = """counts AS (SELECT CAST(floor(o_totalprice / 100000) AS BIGINT) AS count FROM orders),
m AS (SELECT avg(count) FILTER (count > 0) AS positive, avg(CASE WHEN count > 0 THEN 1.0::DOUBLE ELSE 0 END) AS share
      FROM counts)"""


@registry.add(f"""WITH RECURSIVE {ZIP_COUNTS_SQL},
step(k, mu) AS (SELECT 0, positive FROM m
                UNION ALL SELECT k + 1, positive * (1 - exp(-mu)) FROM step, m WHERE k < 300),
fit AS (SELECT mu FROM step ORDER BY k DESC LIMIT 1)
SELECT 'alpha' AS parameter, round(ln(mu), 6) AS mean FROM fit
UNION ALL SELECT 'psi', round(share / (1 - exp(-mu)), 6) FROM fit, m""")
def zip_fit(spark, sf_dir):
    counts = load(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") / 100000).alias("count"))
    model = fit_zip(counts, [], "count", prior_sd=None)
    return rounded(model.summary(spark), 6, "mean").select("parameter", "mean")


@registry.add(f"""WITH RECURSIVE {ZIP_COUNTS_SQL},
step(k, mu) AS (SELECT 0, positive FROM m
                UNION ALL SELECT k + 1, positive * (1 - exp(-mu)) FROM step, m WHERE k < 300),
fit AS (SELECT mu FROM step ORDER BY k DESC LIMIT 1)
SELECT o_orderkey, round(mu, 5) AS mu, round(mu * share / (1 - exp(-mu)), 5) AS prediction FROM orders, fit, m""")
def zip_predict(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 100000).alias("count"))
    model = fit_zip(orders, [], "count", prior_sd=None)
    return rounded(model.predict(orders), 5, "mu", "prediction").select("o_orderkey", "mu", "prediction")


@registry.add(f"""WITH {DAILY_SQL},
f AS (SELECT * FROM daily WHERE rain_7 IS NOT NULL AND soil_moisture_mean IS NOT NULL),
s AS (SELECT avg(rain_7) AS m1, stddev_samp(rain_7) AS d1, avg(soil_moisture_mean) AS m2,
             stddev_samp(soil_moisture_mean) AS d2, avg(temperature_mean) AS m3, stddev_samp(temperature_mean) AS d3,
             avg(relative_humidity_mean) AS m4, stddev_samp(relative_humidity_mean) AS d4 FROM f)
SELECT date, species_count, round((rain_7 - m1) / d1, 6) AS rain_7_std,
       round((soil_moisture_mean - m2) / d2, 6) AS soil_moisture_mean_std,
       round((temperature_mean - m3) / d3, 6) AS temperature_mean_std,
       round((relative_humidity_mean - m4) / d4, 6) AS relative_humidity_mean_std FROM f, s""")
def weather_frame(spark, sf_dir):
    frame, target = weather_model_frame(dataset(spark, sf_dir), (1996, 1999))
    columns = WEATHER_PREDICTORS[:4]
    return rounded(frame, 6, *columns).select("date", target, *columns)


SCALED = [f"(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()) AS {c}_std" for c in STANDARDISED]
WEATHER_FIT_SQL = f"""{DAILY_SQL},
scaled AS (SELECT *, {', '.join(SCALED)} FROM daily WHERE rain_7 IS NOT NULL AND soil_moisture_mean IS NOT NULL)"""


@registry.add(zip_summary_sql("scaled", WEATHER_PREDICTORS, "species_count", WEATHER_FIT_SQL))
def weather_model(spark, sf_dir):
    return summary_of(run_weather_model(dataset(spark, sf_dir), (1996, 1999))[1])


CELL_COUNTS_SQL = f"""{PHOTOS_SQL},
heights AS (SELECT {CELL} AS cell, round(avg(l_discount), 6) AS elevation FROM photos GROUP BY 1)"""
SPATIAL_SQL = f"""{CELL_COUNTS_SQL},
counts AS (SELECT {CELL} AS cell, date, count(*) AS count FROM photos WHERE year(date) BETWEEN 1996 AND 1999 GROUP BY ALL),
scaled AS (SELECT count, (elevation - avg(elevation) OVER ()) / stddev_samp(elevation) OVER () AS elevation_std
           FROM counts JOIN heights USING (cell))"""


@registry.add(zip_summary_sql("scaled", ["elevation_std"], "count", SPATIAL_SQL))
def spatial_model(spark, sf_dir):
    return summary_of(run_spatial_model(photos(spark, sf_dir), heights(spark, sf_dir), years=(1996, 1999), zoom=11)[1])


DENSE_SQL = f"""{CELL_COUNTS_SQL},
counts AS (SELECT {CELL} AS cell, date, count(*) AS count FROM photos GROUP BY ALL),
days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM photos),
dense AS (SELECT coalesce(count, 0) AS count, elevation FROM heights CROSS JOIN days LEFT JOIN counts USING (cell, date))"""


@registry.add(zip_summary_sql("dense", ["elevation"], "count", DENSE_SQL))
def zip_fit_on_dense_grid(spark, sf_dir):
    """Zero inflation is only visible once the empty cell-days are there."""
    counts = c.fill_cell_days(c.count_cell_days(placed(spark, sf_dir)), *ship_span(spark, sf_dir))
    frame = c.attach_by_cell(counts, heights(spark, sf_dir))
    return summary_of(fit_zip(frame, ["elevation"], "count").summary(spark))


@registry.add()
def weather_model_draws(spark, sf_dir):
    """Intervals from draws. Weighted draws are beyond SQL; tests/test_posterior.py holds a quadrature."""
    frame, target = weather_model_frame(dataset(spark, sf_dir), (1996, 1999))
    model = fit_zip(frame, WEATHER_PREDICTORS, target)
    return draw_posterior(frame, model, target).summary(spark)


@registry.add("""WITH d AS (SELECT l_returnflag AS part, l_linenumber AS chain, l_orderkey AS draw, l_extendedprice AS value FROM lineitem),
placed AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY value) AS i, count(*) OVER (PARTITION BY part) AS n FROM d),
spans AS (SELECT a.part, a.value AS low, b.value AS high, a.i FROM placed AS a JOIN placed AS b ON a.part = b.part
          AND b.i = a.i + floor(a.n * 0.94::DOUBLE)),
narrowest AS (SELECT part, low, high FROM spans QUALIFY row_number() OVER (PARTITION BY part ORDER BY high - low, i) = 1),
halves AS (SELECT part, chain, value, 2 * row_number() OVER (PARTITION BY part, chain ORDER BY draw, value) > count(*) OVER (PARTITION BY part, chain) AS half FROM d),
parts AS (SELECT part, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM halves GROUP BY part, chain, half),
across AS (SELECT part, sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)) AS r_hat FROM parts GROUP BY part)
SELECT part, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, any_value(low) AS low, any_value(high) AS high,
       round(any_value(r_hat), 6) AS r_hat
FROM d JOIN narrowest USING (part) JOIN across USING (part) GROUP BY part""")
def draw_summary(spark, sf_dir):
    """Narrowest intervals and agreement of chains, of prices as if they were draws: line numbers as chains."""
    items = load(spark, sf_dir, "lineitem")
    draws = items.select(
        F.col("l_returnflag").alias("part"), F.col("l_linenumber").alias("chain"), F.col("l_orderkey").alias("draw"),
        F.col("l_extendedprice").alias("value"),
    )
    out = summarise_draws(draws, ["part"]).withColumnsRenamed({"hdi_3%": "low", "hdi_97%": "high"})
    return rounded(rounded(out, 4, "mean", "sd"), 6, "r_hat")

"""Filters, column selection, scaling, summaries, payloads."""

from datetime import date

from pyspark.sql import functions as F

from fieldtally.functions.dates import since_year
from fieldtally.functions.geo import Box
from fieldtally.operators import audit, sketches
from fieldtally.operators import filters as fl
from fieldtally.operators.daily import seasonal_features, temperature_features
from fieldtally.operators.frequency import count_by_year, top_k
from fieldtally.operators.frequent_items import exact_top
from fieldtally.operators.scaling import minmax, zscore
from fieldtally.plans.modeling import weather_table
from fieldtally.session import scratch_folder
from fieldtally.sources import payload as pl
from fieldtally.sources.sinks import write_in_z_order

from .base import DAYS_SQL, PHOTOS_SQL, WEATHER_SQL, Registry, days, load, photos, rounded, weather

registry = Registry()


@registry.add("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998")
def year_filter(spark, sf_dir):
    o = fl.filter_by_year(load(spark, sf_dir, "orders"), "o_orderdate", 1996, 1998)
    return o.select("o_orderkey", "o_custkey", "o_orderdate")


@registry.add("SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) >= 1999")
def year_filter_open(spark, sf_dir):
    return load(spark, sf_dir, "orders").where(since_year(F.col("o_orderdate"), 1999)).select("o_orderkey", "o_orderdate")


@registry.add("SELECT year(o_orderdate)::INTEGER AS year, count(*) AS photo_count FROM orders GROUP BY 1")
def year_counts(spark, sf_dir):
    return count_by_year(load(spark, sf_dir, "orders"), "o_orderdate")


@registry.add(f"""WITH {PHOTOS_SQL}
SELECT date, photo_url, latitude, longitude FROM photos
WHERE latitude >= 29.9 AND latitude <= 31.2 AND longitude >= -95.9 AND longitude <= -94.0""")
def bbox_filter(spark, sf_dir):
    return fl.filter_by_bbox(photos(spark, sf_dir), Box.default()).select("date", "photo_url", "latitude", "longitude")


@registry.add(f"""WITH {PHOTOS_SQL}
SELECT date, photo_url, latitude, longitude FROM photos
WHERE latitude >= 30.1 AND latitude <= 30.6 AND longitude >= -95.5 AND longitude <= -95.0""")
def bbox_ranges(spark, sf_dir):
    """A box of a table in Z-order, found by ranges of keys."""
    table = write_in_z_order(photos(spark, sf_dir), scratch_folder(spark, "z-order"), files=8)
    found = fl.filter_by_bbox_in_order(table, Box(-95.5, 30.1, -95.0, 30.6))
    return found.select("date", "photo_url", "latitude", "longitude")


@registry.add("""SELECT vec_id, CAST(embedding[1] AS DOUBLE) BETWEEN -0.1 AND 0.1
       AND CAST(embedding[2] AS DOUBLE) BETWEEN -0.1 AND 0.1 AS inside FROM embeddings""")
def bbox_contains(spark, sf_dir):
    e = F.col("embedding")
    inside = Box(-0.1, -0.1, 0.1, 0.1).contains(e[0].cast("double"), e[1].cast("double"))
    return load(spark, sf_dir, "embeddings").select("vec_id", inside.alias("inside"))


@registry.add("""SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL""")
def drop_incomplete(spark, sf_dir):
    joined = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return fl.drop_incomplete(joined, ["quality", "toxic"]).select("doc_id", "lang", "quality")


@registry.add("""SELECT count(*) FILTER (quality IS NULL) AS quality, count(*) FILTER (lang IS NULL) AS lang
FROM documents LEFT JOIN labels USING (doc_id)""")
def null_counts(spark, sf_dir):
    joined = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return audit.null_counts(joined, ["quality", "lang"])


@registry.add("SELECT doc_id, lang, source FROM documents")
def available_columns(spark, sf_dir):
    return fl.available(load(spark, sf_dir, "documents"), ["doc_id", "title", "lang", "author", "source"])


@registry.add("""WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd, avg(user_id) AS um,
                   stddev_samp(user_id) AS usd FROM events)
SELECT event_id, round((value - m) / sd, 6) AS value_std, round((user_id - um) / usd, 6) AS user_id_std
FROM events, s""")
def standardise(spark, sf_dir):
    out = zscore(load(spark, sf_dir, "events"), ["value", "user_id"])
    return rounded(out, 6, "value_std", "user_id_std").select("event_id", "value_std", "user_id_std")


@registry.add("""WITH s AS (SELECT min(value) AS lo, max(value) AS hi, min(user_id) AS ulo, max(user_id) AS uhi FROM events)
SELECT event_id, round((value - lo) / (hi - lo), 6) AS value_norm,
       round((user_id - ulo) / (uhi - ulo), 6) AS user_id_norm FROM events, s""")
def min_max(spark, sf_dir):
    out = minmax(load(spark, sf_dir, "events"), ["value", "user_id"])
    return rounded(out, 6, "value_norm", "user_id_norm").select("event_id", "value_norm", "user_id_norm")


@registry.add(f"""WITH {WEATHER_SQL}
SELECT date, round((temperature_max + temperature_min) / 2, 6) AS temperature_mean,
       round(temperature_max - temperature_min, 6) AS temp_range FROM weather""")
def temperatures(spark, sf_dir):
    out = temperature_features(weather(spark, sf_dir))
    return rounded(out, 6, "temperature_mean", "temp_range").select("date", "temperature_mean", "temp_range")


@registry.add(f"""WITH {DAYS_SQL}
SELECT url, round(sin(2 * pi() * dayofyear(date) / 365.25), 9) AS seasonal_sin,
       round(cos(2 * pi() * dayofyear(date) / 365.25), 9) AS seasonal_cos FROM days""")
def seasonal(spark, sf_dir):
    out = seasonal_features(days(spark, sf_dir))
    return rounded(out, 9, "seasonal_sin", "seasonal_cos").select("url", "seasonal_sin", "seasonal_cos")


@registry.add(f"""WITH {DAYS_SQL} SELECT date, url FROM days ORDER BY date DESC, url LIMIT 20""")
def newest_pages(spark, sf_dir):
    return top_k(days(spark, sf_dir).select("date", "url"), 20, "date", "url")


@registry.add("SELECT DISTINCT user_id, event_type FROM events")
def distinct_rows(spark, sf_dir):
    return load(spark, sf_dir, "events").select("user_id", "event_type").distinct()


PAYLOAD_COLUMNS = {
    "temperature_max": "max(l_extendedprice)", "temperature_min": "min(l_extendedprice)",
    "temperature_mean": "max(l_extendedprice) + 1", "precipitation_sum": "sum(l_quantity)",
    "rain_sum": "sum(l_quantity) + 1", "snowfall_sum": "CAST(count(*) AS DOUBLE)", "wind_speed_max": "max(l_quantity)",
    "wind_speed_mean": "min(l_quantity)", "relative_humidity_mean": "max(l_tax)", "soil_temp_mean": "min(l_tax)",
    "soil_moisture_mean": "max(l_discount)",
}


def payloads(spark, sf_dir):
    """One payload per month: the days of line items as parallel arrays, with a key nobody asked for."""
    per_day = (
        load(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("date"))
        .agg(*[F.expr(e).alias(c) for c, e in PAYLOAD_COLUMNS.items()])
    )
    names = {v: k for k, v in pl.KEYS.items()}
    entries = F.array_sort(F.collect_list(F.struct("date", *PAYLOAD_COLUMNS)))
    arrays = per_day.groupBy(F.trunc("date", "month").alias("month")).agg(entries.alias("d"))
    daily = F.struct(
        F.transform("d", lambda e: F.date_format(e.date, "yyyy-MM-dd")).alias("time"),
        *[F.col("d").getField(c).alias(names[c]) for c in PAYLOAD_COLUMNS],
        F.lit("x").alias("units"),
    )
    return arrays.select(F.to_json(F.struct(F.lit(1).alias("version"), daily.alias("daily"))).alias("payload"))


@registry.add("""SELECT CAST(l_shipdate AS DATE) AS date, """
              + ", ".join(f"{e} AS {c}" for c, e in PAYLOAD_COLUMNS.items())
              + " FROM lineitem GROUP BY 1")
def payload_unpivot(spark, sf_dir):
    return pl.unpivot_daily(payloads(spark, sf_dir))


@registry.add(f"""WITH {DAYS_SQL}, w AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) + 1 AS rain_sum
                              FROM lineitem GROUP BY 1)
SELECT date, rain_sum FROM w WHERE date BETWEEN (SELECT min(date) FROM days) AND (SELECT max(date) FROM days)""")
def weather_table_build(spark, sf_dir):
    return weather_table(days(spark, sf_dir), payloads(spark, sf_dir)).select("date", "rain_sum")


@registry.add("""SELECT 1 AS n_bad, 'payload is missing daily variables: rain_sum' AS error
FROM (SELECT DISTINCT date_trunc('month', l_shipdate) AS m FROM lineitem)""")
def payload_errors(spark, sf_dir):
    broken = payloads(spark, sf_dir).select(F.replace("payload", F.lit('"rain_sum"'), F.lit('"rain"')).alias("payload"))
    return pl.bad_payloads(broken).select(F.lit(1).alias("n_bad"), "error")


@registry.add("""SELECT p_name, count(*) AS occurrences FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_name ORDER BY occurrences DESC, p_name LIMIT 25""")
def frequent_items_exact(spark, sf_dir):
    """The 25 most frequent names, counted by bounded summaries and an exact recount."""
    names = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return exact_top(names, "p_name", 25)


@registry.add("""SELECT event_type, count(DISTINCT user_id) AS users, TRUE AS within_bound
FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY event_type""")
def distinct_from_sketches(spark, sf_dir):
    """Distinct users over two weeks, by sketches of single days, beside exact counts."""
    days = load(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    stored = scratch_folder(spark, "sketches")
    sketches.distinct_sketches(days, ["event_type", "date"], "user_id").write.parquet(stored)
    span = sketches.between(spark.read.parquet(stored), date(2024, 1, 5), date(2024, 1, 19))
    exact = days.where(F.col("date").between(date(2024, 1, 5), date(2024, 1, 19))).groupBy("event_type")
    exact = exact.agg(F.countDistinct("user_id").alias("users"))
    both = exact.join(sketches.distinct_over(span, ["event_type"]), "event_type")
    off = F.abs(F.col("n_distinct") - F.col("users"))
    return both.select("event_type", "users", (off <= F.col("users") * 4 * sketches.standard_error() + 1).alias("within_bound"))

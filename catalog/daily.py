"""Calendar, presence, weather features, rolling windows, reconciliation."""

from datetime import date

from pyspark.sql import functions as F

from fieldtally.functions.dates import season
from fieldtally.operators import audit
from fieldtally.operators import daily as d
from fieldtally.operators.filters import filter_by_year
from fieldtally.operators.frequency import count_by, distinct_per_day
from fieldtally.plans import refresh
from fieldtally.plans.modeling import daily_dataset
from fieldtally.session import scratch_folder

from .base import (
    DAYS_SQL, EVENT_DAYS_SQL, PHOTOS_SQL, WEATHER_SQL, Registry, days, event_days, load, parsed_photos, photos,
    rounded, weather,
)

registry = Registry()

FEATURES = [
    "temperature_max", "temperature_min", "relative_humidity_mean", "soil_moisture_mean", "temperature_mean",
    "temp_range", "seasonal_sin", "seasonal_cos",
]

DAILY_SQL = f"""
{PHOTOS_SQL}, {DAYS_SQL}, {WEATHER_SQL},
in_years AS (SELECT * FROM weather WHERE year(date) BETWEEN 1996 AND 1999),
per_day AS (SELECT date, 1 AS has_mushroom, sum(photo_count) AS photo_count FROM days
            WHERE year(date) BETWEEN 1996 AND 1999 GROUP BY date),
names AS (SELECT date, first_species AS s FROM photos UNION ALL SELECT date, second_species FROM photos),
species AS (SELECT date, count(DISTINCT s) AS species_count FROM names GROUP BY date),
daily AS (
  SELECT date, CAST(coalesce(has_mushroom, 0) AS BIGINT) AS has_mushroom,
         CAST(coalesce(photo_count, 0) AS BIGINT) AS photo_count,
         CAST(coalesce(species_count, 0) AS BIGINT) AS species_count,
         rain_sum, temperature_max, temperature_min, relative_humidity_mean, soil_moisture_mean,
         rain_sum AS rain_1,
         sum(rain_sum) OVER (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rain_3,
         sum(rain_sum) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rain_7,
         (temperature_max + temperature_min) / 2 AS temperature_mean,
         temperature_max - temperature_min AS temp_range,
         sin(2 * pi() * dayofyear(date) / 365.25) AS seasonal_sin,
         cos(2 * pi() * dayofyear(date) / 365.25) AS seasonal_cos
  FROM in_years LEFT JOIN per_day USING (date) LEFT JOIN species USING (date)
)"""


def dataset(spark, sf_dir):
    named = parsed_photos(spark, sf_dir).select("date", "species_list")
    return daily_dataset(days(spark, sf_dir), weather(spark, sf_dir), named, (1996, 1999))


@registry.add(f"""WITH {DAILY_SQL}
SELECT date, has_mushroom, photo_count, species_count, rain_sum, rain_1, rain_3, rain_7,
       {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)} FROM daily""")
def daily_features(spark, sf_dir):
    return rounded(dataset(spark, sf_dir), 6, *FEATURES)


@registry.add(f"""WITH {DAILY_SQL}
SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,
       CAST(sum(has_mushroom) AS BIGINT) AS days_present, round(avg(has_mushroom), 6) AS share_present,
       CAST(sum(species_count) AS BIGINT) AS species_observations FROM daily""")
def dataset_summary(spark, sf_dir):
    return rounded(audit.dataset_summary(dataset(spark, sf_dir)), 6, "share_present")


@registry.add(f"""WITH {DAYS_SQL}, {WEATHER_SQL},
per_day AS (SELECT date, sum(photo_count) AS n FROM days GROUP BY date)
SELECT date, CASE WHEN n IS NULL THEN 0::BIGINT ELSE 1::BIGINT END AS has_mushroom,
       CAST(coalesce(n, 0) AS BIGINT) AS photo_count, 0::BIGINT AS species_count
FROM weather LEFT JOIN per_day USING (date)""")
def calendar_presence(spark, sf_dir):
    return d.attach_presence(d.calendar_from(weather(spark, sf_dir)), days(spark, sf_dir))


@registry.add(f"""WITH {PHOTOS_SQL},
names AS (SELECT date, first_species AS s FROM photos UNION ALL SELECT date, second_species FROM photos)
SELECT date, count(DISTINCT s) AS species_count FROM names GROUP BY date""")
def distinct_species_per_day(spark, sf_dir):
    return distinct_per_day(parsed_photos(spark, sf_dir), "species_list")


@registry.add(f"""WITH {DAYS_SQL}, {WEATHER_SQL}
SELECT DISTINCT date FROM days WHERE date NOT IN (SELECT date FROM weather)""")
def uncovered_days(spark, sf_dir):
    return d.uncovered_days(days(spark, sf_dir), d.calendar_from(weather(spark, sf_dir)))


@registry.add(f"""WITH {EVENT_DAYS_SQL}
SELECT date, photo_count,
       CAST(sum(photo_count) OVER (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS sum_3,
       CAST(sum(photo_count) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS sum_7
FROM event_days""")
def rolling_sum(spark, sf_dir):
    return d.rolling(event_days(spark, sf_dir), "photo_count", {"sum_3": 3, "sum_7": 7})


@registry.add(f"""WITH {DAYS_SQL},
per_day AS (SELECT date, CAST(sum(photo_count) AS BIGINT) AS photo_count FROM days GROUP BY date)
SELECT date, photo_count,
       round(avg(photo_count) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS roll_7,
       round(avg(photo_count) OVER (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS roll_30
FROM per_day""")
def rolling_mean(spark, sf_dir):
    per_day = days(spark, sf_dir).groupBy("date").agg(F.sum("photo_count").alias("photo_count"))
    return rounded(d.rolling(per_day, "photo_count", {"roll_7": 7, "roll_30": 30}, "mean"), 6, "roll_7", "roll_30")


@registry.add(f"""WITH {WEATHER_SQL},
calendar AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM weather), (SELECT max(date) FROM weather),
                                                INTERVAL 1 DAY)) AS DATE) AS date)
SELECT date, rain_sum,
       sum(rain_sum) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rain_7
FROM calendar LEFT JOIN weather USING (date)""")
def rolling_on_full_calendar(spark, sf_dir):
    filled = d.fill_calendar(weather(spark, sf_dir).select("date", "rain_sum"))
    return d.rolling(filled, "rain_sum", {"rain_7": 7})


@registry.add("""WITH per_day AS (
  SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, date, n,
       CAST(sum(n) OVER (PARTITION BY event_type ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT)
         AS sum_7
FROM per_day""")
def rolling_sum_by_series(spark, sf_dir):
    per_day = (
        load(spark, sf_dir, "events")
        .groupBy("event_type", F.col("ts").cast("date").alias("date"))
        .agg(F.count("*").alias("n"))
    )
    return d.rolling(per_day, "n", {"sum_7": 7}, series=["event_type"])


@registry.add(f"""WITH {DAYS_SQL}, {PHOTOS_SQL},
reported AS (SELECT date, count(*) AS photo_count FROM days GROUP BY date),
actual AS (SELECT date, count(*) AS actual_photo_count FROM photos GROUP BY date)
SELECT date, photo_count, coalesce(actual_photo_count, 0) AS actual_photo_count,
       actual_photo_count IS NULL AS no_photos
FROM reported LEFT JOIN actual USING (date)
WHERE actual_photo_count IS NULL OR photo_count <> actual_photo_count""")
def reconcile_counts(spark, sf_dir):
    reported = days(spark, sf_dir).groupBy("date").agg(F.count("*").alias("photo_count"))
    actual = F.col("actual_photo_count")
    return d.count_discrepancies(reported, photos(spark, sf_dir)).select(
        "date", "photo_count", F.coalesce(actual, F.lit(0)).alias("actual_photo_count"), actual.isNull().alias("no_photos")
    )


@registry.add(f"""WITH {PHOTOS_SQL}
SELECT date, count(*) AS actual_photo_count FROM photos GROUP BY date""")
def photos_per_day(spark, sf_dir):
    return count_by(photos(spark, sf_dir), "date", name="actual_photo_count")


@registry.add(f"""WITH {DAYS_SQL}
SELECT date, photo_count, CAST(o_custkey % 30 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS temp,
       CAST('-' || (o_custkey % 10) AS DOUBLE) + 0 AS min, CAST(o_custkey % 40 AS DOUBLE) AS max,
       CAST((o_custkey % 20) || '.2' AS DOUBLE) AS precip FROM days""")
def sentence_metrics(spark, sf_dir):
    # adding zero turns the parsed "-0" into a plain zero
    return d.with_weather_metrics(days(spark, sf_dir)).withColumn("min", F.col("min") + F.lit(0.0))


@registry.add(f"""WITH {DAYS_SQL},
m AS (SELECT date, o_custkey % 30 + CAST(0.5 AS DOUBLE) AS temp, -CAST(o_custkey % 10 AS DOUBLE) + 0 AS min,
             CAST(o_custkey % 40 AS DOUBLE) AS max, CAST((o_custkey % 20) || '.2' AS DOUBLE) AS precip FROM days)
SELECT date, url, photo_count, temp, min, max, precip FROM days JOIN m USING (date)""")
def join_sentence_metrics(spark, sf_dir):
    records = days(spark, sf_dir)
    metrics = d.with_weather_metrics(records).withColumn("min", F.col("min") + F.lit(0.0))
    return d.join_weather_metrics(records.select("date", "url", "photo_count"), metrics)


@registry.add(f"""WITH {DAYS_SQL}
SELECT date, url, photo_count, o_custkey % 30 + CAST(0.5 AS DOUBLE) AS temp, -CAST(o_custkey % 10 AS DOUBLE) + 0 AS min,
       CAST(o_custkey % 40 AS DOUBLE) AS max, CAST((o_custkey % 20) || '.2' AS DOUBLE) AS precip FROM days""")
def own_sentence_metrics(spark, sf_dir):
    metrics = d.with_weather_metrics(days(spark, sf_dir), keep=("url",))
    return metrics.withColumn("min", F.col("min") + F.lit(0.0))


@registry.add("""SELECT strftime(min(CAST(ts AS DATE)), '%Y-%m-%d') AS start_date,
       strftime(max(CAST(ts AS DATE)), '%Y-%m-%d') AS end_date FROM events""")
def date_span(spark, sf_dir):
    return audit.date_span(load(spark, sf_dir, "events"), "ts")


@registry.add("""SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter'
            WHEN month(o_orderdate) <= 5 THEN 'Spring' WHEN month(o_orderdate) <= 8 THEN 'Summer' ELSE 'Fall' END
         AS season, year(o_orderdate)::INTEGER AS year, count(*) AS n
FROM orders GROUP BY ALL""")
def season_counts(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.groupBy(season(F.col("o_orderdate")).alias("season"), F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("n")
    )


@registry.add(f"WITH {DAILY_SQL} SELECT date, photo_count, species_count, rain_3, rain_7 FROM daily")
def daily_refresh(spark, sf_dir):
    """A dataset built without the records of some dates, brought up to date with them."""
    folder = scratch_folder(spark, "daily")
    rain = filter_by_year(weather(spark, sf_dir), "date", 1996, 1999)
    whole, seen = days(spark, sf_dir), parsed_photos(spark, sf_dir).select("date", "species_list")
    late = [date(1996, 5, 1), date(1996, 5, 2), date(1998, 12, 30)]
    early = [x.where(~F.col("date").isin(late)) for x in (whole, seen)]
    refresh.write_daily(daily_dataset(early[0], rain, early[1]), folder)
    out = refresh.refresh_daily(spark, folder, whole, rain, seen, late)
    return out.select("date", "photo_count", "species_count", "rain_3", "rain_7")

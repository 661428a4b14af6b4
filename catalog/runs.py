"""Readers, sinks and whole runs: given tables are landed in a shared folder, read and run from there."""

from pyspark.sql import functions as F

from fieldtally.plans import modeling, preprocess
from fieldtally.session import scratch_folder
from fieldtally.sources import tables
from fieldtally.sources.sinks import write_table

from .base import DAYS_SQL, PHOTOS_SQL, RULES, WEATHER_SQL, Registry, days, keep_sql, load, photos, weather

registry = Registry()

PHOTO_COLUMNS = ["date", "page_url", "photo_url", "index_on_page", "full_caption", "latitude", "longitude"]
DAY_COLUMNS = ["date", "url", "photo_count", "identified_species", "weather_summary"]


#: Rows of one landed CSV file. As text photos take some ten times the room of the table they come from, so files are compressed.
#: A compressed file is one split: there are as many as keep all cores at work.
LANDED_ROWS = 50_000


def landed(spark, sf_dir, *names, fmt="csv"):
    """Paths of the tables named, side by side."""
    folder, ending = scratch_folder(spark, "landed"), ".csv" if fmt == "csv" else ""
    tables_of = {"days": days, "photos": lambda *a: photos(*a).select(*PHOTO_COLUMNS, "species"), "weather": weather}
    for name in names:
        compression = "gzip" if fmt == "csv" else None
        write_table(tables_of[name](spark, sf_dir), f"{folder}/{name}{ending}", fmt, csv_rows=LANDED_ROWS, compression=compression)
    return [f"{folder}/{name}{ending}" for name in names]


@registry.add(f"""WITH {DAYS_SQL}
SELECT date, url, photo_count, '[''' || o_orderpriority || ''', ''customer ' || (o_custkey % 50) || ''']' AS identified_species
FROM days""")
def read_days_csv(spark, sf_dir):
    return tables.read_days(spark, *landed(spark, sf_dir, "days"), False).select("date", "url", "photo_count", "identified_species")


@registry.add(f"WITH {PHOTOS_SQL} SELECT {', '.join(PHOTO_COLUMNS)} FROM photos")
def read_photos_csv(spark, sf_dir):
    return tables.read_photos(spark, *landed(spark, sf_dir, "photos"), False).select(*PHOTO_COLUMNS)


@registry.add("""SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text, lang, source, n_chars FROM documents""")
def read_quoted_texts_csv(spark, sf_dir):
    """Texts with line breaks, quotes and separators, written as CSV and read in pieces."""
    folder = scratch_folder(spark, "quoted")
    texts = load(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\r\n?", "\n").alias("text"), "lang", "source", "n_chars")
    texts.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(folder)
    types = {"doc_id": "bigint", "n_chars": "bigint"}
    return tables.read_table(spark, folder, types, split=True)


@registry.add(f"WITH {PHOTOS_SQL} SELECT {', '.join(PHOTO_COLUMNS)} FROM photos")
def read_photos_split(spark, sf_dir):
    return tables.read_photos(spark, *landed(spark, sf_dir, "photos"), False, split=True).select(*PHOTO_COLUMNS)


@registry.add(f"WITH {WEATHER_SQL} SELECT * FROM weather WHERE year(date) BETWEEN 1996 AND 1998")
def read_weather_parquet(spark, sf_dir):
    read = tables.read_weather(spark, *landed(spark, sf_dir, "weather", fmt="parquet"), "parquet")
    return modeling.filter_by_year(read, "date", 1996, 1998)


@registry.add(f"WITH {DAYS_SQL} SELECT date, url, photo_count, year(date)::INTEGER AS year FROM days")
def sink_by_year(spark, sf_dir):
    folder = scratch_folder(spark, "sink")
    write_table(days(spark, sf_dir).select("date", "url", "photo_count"), folder, by_year=True)
    return spark.read.parquet(folder)


KEPT_SQL = f"""{PHOTOS_SQL}, kept AS (SELECT * FROM photos WHERE {keep_sql('first_species', 'full_caption')}),
names AS (SELECT date, first_species AS s FROM kept UNION ALL SELECT date, second_species FROM kept)"""


@registry.add(f"WITH {KEPT_SQL} SELECT s AS species, count(*) AS occurrences, 'photo-level' AS source FROM names GROUP BY s")
def preprocessing_run(spark, sf_dir):
    day_path, photo_path = landed(spark, sf_dir, "days", "photos")
    out = preprocess.run_preprocessing(spark, day_path, photo_path, scratch_folder(spark, "out"), False, RULES)
    return out["species_frequency"]


def daily_sql(names: str) -> str:
    return f"""{DAYS_SQL}, {WEATHER_SQL},
per_day AS (SELECT date, sum(photo_count) AS n FROM days GROUP BY date),
species AS (SELECT date, count(DISTINCT s) AS k FROM {names} GROUP BY date)
SELECT date, CASE WHEN n IS NULL THEN 0::BIGINT ELSE 1::BIGINT END AS has_mushroom,
       CAST(coalesce(n, 0) AS BIGINT) AS photo_count, CAST(coalesce(k, 0) AS BIGINT) AS species_count
FROM weather LEFT JOIN per_day USING (date) LEFT JOIN species USING (date)"""


@registry.add(f"""WITH {PHOTOS_SQL},
names AS (SELECT date, first_species AS s FROM photos UNION ALL SELECT date, second_species FROM photos),
{daily_sql('names')}""")
def modeling_run(spark, sf_dir):
    """No photos are handed over: they are read from beside the days."""
    day_path, _, weather_path = landed(spark, sf_dir, "days", "photos", "weather")
    data = modeling.run_modeling_dataset(spark, day_path, weather_path, scratch_folder(spark, "out"), False)
    return data.select("date", "has_mushroom", "photo_count", "species_count")


@registry.add(f"WITH {KEPT_SQL}, {daily_sql('names')}")
def full_run(spark, sf_dir):
    out = modeling.run_full(spark, *landed(spark, sf_dir, "days", "photos", "weather"), scratch_folder(spark, "out"), False, RULES)
    return out["daily"].select("date", "has_mushroom", "photo_count", "species_count")

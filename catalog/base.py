"""Adapters that give the test tables the shape of observation tables, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.functions.rules import RuleSet
from fieldtally.plans.preprocess import process_photos


class Registry:
    def __init__(self) -> None:
        self.queries = {}
        self.oracles = {}

    def add(self, sql: str | None = None):
        """Register a function (spark, sf_dir) -> DataFrame under its own name."""

        def register(fn):
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.oracles[fn.__name__] = sql
            return fn

        return register


PIECES_PER_CORE = 4


def load(spark: SparkSession, sf_dir: str, table: str, costly: bool = False) -> DataFrame:
    """A table. Where a parser follows (``costly``), rows of a table that lies in fewer pieces than the cluster
    has work for are dealt out anew: a small file is one split, and cannot be cut within a row group. The
    session may name the number of pieces in ``fieldtally.scanPieces``."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if not costly:
        return df
    pieces = spark.conf.get("fieldtally.scanPieces", None)
    if pieces:
        return df.repartition(int(pieces))
    enough = PIECES_PER_CORE * spark.sparkContext.defaultParallelism
    return df.repartition(enough) if df.rdd.getNumPartitions() < enough else df


SITE = "https://obs.example.org"

# ---- photos: line items, named by their part -------------------------------

PHOTOS_SQL = f"""
photos AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
         '{SITE}/day/' || l_orderkey || '.htm' AS page_url,
         '{SITE}/pictures/archives/' || year(l_shipdate) || '/R' || l_suppkey || '/jpeg/'
           || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || 'b.jpg' AS photo_url,
         l_linenumber AS index_on_page,
         p_name || ' (' || p_type || ') by ' || p_brand AS full_caption,
         p_name AS first_species, p_brand AS second_species,
         CAST(29 AS DOUBLE) + l_quantity * CAST('0.05' AS DOUBLE) AS latitude,
         CAST(-96 AS DOUBLE) + l_extendedprice / CAST(50000 AS DOUBLE) AS longitude,
         l_returnflag, l_discount
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def photos(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    """Raw photo records; ``species`` is the text of a list of records."""
    items = load(spark, sf_dir, "lineitem", costly).join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return items.select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.format_string(f"{SITE}/day/%d.htm", "l_orderkey").alias("page_url"),
        F.format_string(
            f"{SITE}/pictures/archives/%d/R%d/jpeg/%02db.jpg", F.year("l_shipdate"), "l_suppkey", "l_linenumber"
        ).alias("photo_url"),
        F.col("l_linenumber").alias("index_on_page"),
        F.concat("p_name", F.lit(" ("), "p_type", F.lit(") by "), "p_brand").alias("full_caption"),
        F.format_string(
            "[{'latin_name': '%s', 'page_url': None}, {'latin_name': '', 'page_url': 'x'}, {'latin_name': \"%s\"}]",
            "p_name", "p_brand",
        ).alias("species"),
        (F.lit(29.0) + F.col("l_quantity") * F.lit(0.05)).alias("latitude"),
        (F.lit(-96.0) + F.col("l_extendedprice") / F.lit(50000.0)).alias("longitude"),
        "l_returnflag",
        "l_discount",
    )


def parsed_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo records with their species lists."""
    return process_photos(photos(spark, sf_dir, costly=True))


# ---- days: orders ----------------------------------------------------------

DAYS_SQL = f"""
days AS (
  SELECT CAST(o_orderdate AS DATE) AS date, '{SITE}/date-en/' || o_orderkey || '.htm' AS url,
         CAST(floor(o_totalprice / 100000) AS BIGINT) AS photo_count,
         o_orderpriority, o_custkey
  FROM orders
)"""


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day records, several per date."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"),
        F.format_string(f"{SITE}/date-en/%d.htm", "o_orderkey").alias("url"),
        F.floor(F.col("o_totalprice") / 100000).alias("photo_count"),
        F.format_string("['%s', 'customer %d']", "o_orderpriority", F.pmod("o_custkey", F.lit(50))).alias(
            "identified_species"
        ),
        F.format_string(
            "Weather. Temperature %d.5° (average), min. %d°, max. %d°. Wind 3 m/s. Precipitation %d.2 mm.",
            F.pmod("o_custkey", F.lit(30)), -F.pmod("o_custkey", F.lit(10)), F.pmod("o_custkey", F.lit(40)),
            F.pmod("o_custkey", F.lit(20)),
        ).alias("weather_summary"),
    )


# ---- weather: line items per ship date -------------------------------------

WEATHER_SQL = """
weather AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
         sum(l_quantity) AS rain_sum,
         max(l_extendedprice) / 1000 AS temperature_max,
         min(l_extendedprice) / 1000 AS temperature_min,
         avg(l_discount) AS relative_humidity_mean,
         avg(l_tax) AS soil_moisture_mean
  FROM lineitem GROUP BY 1
)"""


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            F.sum("l_quantity").alias("rain_sum"),
            (F.max("l_extendedprice") / 1000).alias("temperature_max"),
            (F.min("l_extendedprice") / 1000).alias("temperature_min"),
            F.avg("l_discount").alias("relative_humidity_mean"),
            F.avg("l_tax").alias("soil_moisture_mean"),
        )
    )


# ---- events per day --------------------------------------------------------

EVENT_DAYS_SQL = """
event_days AS (
  SELECT CAST(ts AS DATE) AS date, count(*) AS photo_count FROM events GROUP BY 1
)"""


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "events")
        .groupBy(F.col("ts").cast("date").alias("date"))
        .agg(F.count("*").alias("photo_count"))
    )


# ---- rules -----------------------------------------------------------------

RULES = RuleSet(
    exclude_genera=("Red", " blue "),
    exclude_species=("small ring", "OLD BOLT"),
    include_species=("Red Widget",),
    exclude_caption_keywords=("Promo", "economy", "brand#1"),
)


def first_keyword_sql(caption: str) -> str:
    return (
        f"CASE WHEN contains(lower({caption}), 'promo') THEN 1 WHEN contains(lower({caption}), 'economy') THEN 2"
        f" WHEN contains(lower({caption}), 'brand#1') THEN 3 ELSE 0 END"
    )


def keep_sql(name: str, caption: str | None) -> str:
    keyword = f"WHEN {first_keyword_sql(caption)} > 0 THEN FALSE " if caption else ""
    return (
        f"CASE WHEN lower(trim({name})) = 'red widget' THEN TRUE"
        f" WHEN lower(trim({name})) IN ('small ring', 'old bolt') THEN FALSE"
        f" WHEN split_part(lower(trim({name})), ' ', 1) IN ('red', 'blue') THEN FALSE {keyword}ELSE TRUE END"
    )


def reason_sql(name: str, position: str) -> str:
    genus = f"split_part(lower(trim({name})), ' ', 1)"
    return (
        f"CASE WHEN lower(trim({name})) = 'red widget' THEN NULL"
        f" WHEN lower(trim({name})) IN ('small ring', 'old bolt') THEN 'species in exclude list: ' || {name}"
        f" WHEN {genus} IN ('red', 'blue') THEN 'genus excluded: ' || upper({genus}[1]) || {genus}[2:]"
        f" WHEN {position} = 1 THEN 'caption keyword: ''promo'''"
        f" WHEN {position} = 2 THEN 'caption keyword: ''economy'''"
        f" WHEN {position} = 3 THEN 'caption keyword: ''brand#1''' END"
    )


# ---- cells -----------------------------------------------------------------


def cell_sql(lat: str, lon: str, zoom: int = 14) -> str:
    n = 1 << zoom
    x = f"CAST(greatest(0, least({n - 1}, floor(({lon} + 180.0) / 360.0 * {n}))) AS BIGINT)"
    y = f"CAST(greatest(0, least({n - 1}, floor((1.0 - asinh(tan(radians({lat}))) / pi()) / 2.0 * {n}))) AS BIGINT)"
    known = f"{lat} BETWEEN -90 AND 90 AND {lon} BETWEEN -180 AND 180"
    return f"(CASE WHEN {known} THEN {zoom << 58} + {x} * {1 << 29} + {y} END)"


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round sums of doubles, whose last bits depend on the order of addition."""
    return df.withColumns({c: F.round(c, digits) for c in columns})

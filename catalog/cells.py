"""Map cells."""

from datetime import date

from pyspark.sql import functions as F

from fieldtally.functions import geo
from fieldtally.operators import audit
from fieldtally.operators import cells as c
from fieldtally.plans.modeling import cell_model_frame

from .base import PHOTOS_SQL, Registry, cell_sql, load, photos, rounded

registry = Registry()

CELL = cell_sql("latitude", "longitude", 11)
FINE = cell_sql("latitude", "longitude", 14)
LOOKUP_SQL = f"""lookup AS (SELECT {CELL} AS cell, round(avg(l_discount), 6) AS elevation FROM photos
                        WHERE l_returnflag = 'A' GROUP BY 1)"""


def placed(spark, sf_dir, zoom=11):
    return c.add_cells(photos(spark, sf_dir), zoom=zoom)


def lookup(spark, sf_dir):
    """One elevation per cell, only for cells with a returned item."""
    rows = placed(spark, sf_dir).where(F.col("l_returnflag") == "A")
    return rounded(c.mean_by_cell(rows.withColumn("elevation", F.col("l_discount"))), 6, "elevation")


def heights(spark, sf_dir, zoom=11):
    """One elevation for every cell."""
    rows = placed(spark, sf_dir, zoom).withColumn("elevation", F.col("l_discount"))
    return rounded(c.mean_by_cell(rows), 6, "elevation")


def ship_span(spark, sf_dir):
    """The first and the last date of the items."""
    span = load(spark, sf_dir, "lineitem").select(F.min("l_shipdate").cast("date"), F.max("l_shipdate").cast("date"))
    return tuple(span.first())


@registry.add("SELECT vec_id, " + cell_sql("CAST(embedding[1] AS DOUBLE) * 80", "CAST(embedding[2] AS DOUBLE) * 170", 14)
              + " AS cell FROM embeddings")
def cell_index(spark, sf_dir):
    e = F.col("embedding")
    cell = geo.cell_id(e[0].cast("double") * 80.0, e[1].cast("double") * 170.0)
    return load(spark, sf_dir, "embeddings").select("vec_id", cell.alias("cell"))


@registry.add(f"""WITH {PHOTOS_SQL} SELECT {FINE} AS cell, count(*) AS photo_count FROM photos GROUP BY 1""")
def cell_counts(spark, sf_dir):
    return c.count_cells(placed(spark, sf_dir, 14))


@registry.add(f"""WITH {PHOTOS_SQL} SELECT {CELL} AS cell, date, count(*) AS count FROM photos GROUP BY ALL""")
def cell_day_counts(spark, sf_dir):
    return c.count_cell_days(placed(spark, sf_dir))


@registry.add(f"""WITH {PHOTOS_SQL} SELECT count(DISTINCT {FINE}) AS n FROM photos""")
def cell_distinct(spark, sf_dir):
    return audit.distinct_count(placed(spark, sf_dir, 14), "cell")


@registry.add(f"""WITH {PHOTOS_SQL} SELECT {CELL} AS cell, round(avg(l_discount), 6) AS l_discount FROM photos GROUP BY 1""")
def cell_mean(spark, sf_dir):
    return rounded(c.mean_by_cell(placed(spark, sf_dir), "l_discount"), 6, "l_discount")


@registry.add(f"""WITH {PHOTOS_SQL}, {LOOKUP_SQL}, placed AS (SELECT *, {CELL} AS cell FROM photos)
SELECT photo_url, page_url, cell, elevation FROM placed LEFT JOIN lookup USING (cell)""")
def cell_enrich(spark, sf_dir):
    out = c.attach_by_cell(placed(spark, sf_dir), lookup(spark, sf_dir))
    return out.select("photo_url", "page_url", "cell", "elevation")


@registry.add(f"""WITH {PHOTOS_SQL}, {LOOKUP_SQL}, placed AS (SELECT *, {CELL} AS cell FROM photos)
SELECT photo_url, page_url, cell, elevation FROM placed LEFT JOIN lookup USING (cell)""")
def cell_enrich_spread(spark, sf_dir):
    out = c.attach_by_cell(placed(spark, sf_dir), lookup(spark, sf_dir), spread=8)
    return out.select("photo_url", "page_url", "cell", "elevation")


CENTRE_SQL = f"""tiles AS (SELECT DISTINCT {FINE} AS cell FROM photos),
xy AS (SELECT cell, (cell >> 29) & 536870911 AS x, cell & 536870911 AS y FROM tiles)"""


def lat_sql(y):
    return f"degrees(atan(sinh(pi() * (1 - ({y}) * 2.0 / 16384))))"


@registry.add(f"""WITH {PHOTOS_SQL}, {CENTRE_SQL}
SELECT cell, round({lat_sql('y + 0.5')}, 9) AS lat, round((x + 0.5) / 16384 * 360 - 180, 9) AS lon FROM xy""")
def cell_centroid(spark, sf_dir):
    return rounded(c.cells_of(placed(spark, sf_dir, 14)), 9, "lat", "lon")


@registry.add(f"""WITH {PHOTOS_SQL}, {CENTRE_SQL} SELECT DISTINCT {13 << 58} + (x >> 1) * 536870912 + (y >> 1) AS parent FROM xy""")
def cell_parents(spark, sf_dir):
    cells = c.cells_of(placed(spark, sf_dir, 14))
    return cells.select(geo.cell_parent(F.col("cell")).alias("parent")).distinct()


@registry.add(f"""WITH {PHOTOS_SQL}, {CENTRE_SQL},
n AS (SELECT {FINE} AS cell, count(*) AS photo_count FROM photos GROUP BY 1)
SELECT cell, 'Feature' AS type, 'Polygon' AS shape, cell AS cell_property, photo_count, 5 AS vertices,
       round(x / 16384.0 * 360 - 180, 9) AS west, round((x + 1) / 16384.0 * 360 - 180, 9) AS east,
       round({lat_sql('y')}, 9) AS north, round({lat_sql('y + 1')}, 9) AS south
FROM n JOIN xy USING (cell)""")
def cell_geojson(spark, sf_dir):
    # the feature text is taken apart again, as its numbers are printed differently elsewhere
    features = c.cell_features(c.count_cells(placed(spark, sf_dir, 14)), "photo_count")
    parsed = F.from_json(
        "feature",
        "type string, properties struct<cell: bigint, photo_count: bigint>,"
        " geometry struct<type: string, coordinates: array<array<array<double>>>>",
    )
    ring = F.col("f.geometry.coordinates")[0]
    return features.select("cell", parsed.alias("f")).select(
        "cell",
        "f.type",
        F.col("f.geometry.type").alias("shape"),
        F.col("f.properties.cell").alias("cell_property"),
        "f.properties.photo_count",
        F.size(ring).alias("vertices"),
        F.round(ring[0][0], 9).alias("west"),
        F.round(ring[2][0], 9).alias("east"),
        F.round(ring[0][1], 9).alias("north"),
        F.round(ring[2][1], 9).alias("south"),
    )


@registry.add(f"""WITH {PHOTOS_SQL}, {CENTRE_SQL}
SELECT round(avg((3 * {lat_sql('y')} + 2 * {lat_sql('y + 1')}) / 5), 6) AS lat,
       round(avg((3 * (x / 16384.0 * 360 - 180) + 2 * ((x + 1) / 16384.0 * 360 - 180)) / 5), 6) AS lon FROM xy""")
def cell_map_center(spark, sf_dir):
    return rounded(c.map_center(c.cells_of(placed(spark, sf_dir, 14))), 6, "lat", "lon")


@registry.add("""SELECT s_nationkey::BIGINT AS cell, CAST(d AS DATE) AS date
FROM (SELECT DISTINCT s_nationkey FROM supplier),
     (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-03-31', INTERVAL 7 DAY)) AS d)""")
def space_time_grid(spark, sf_dir):
    cells = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("cell")).distinct()
    return c.space_time_grid(cells, date(2024, 1, 1), date(2024, 3, 31), "7 days")


@registry.add(f"""WITH {PHOTOS_SQL},
counts AS (SELECT {cell_sql('latitude', 'longitude', 7)} AS cell, date, count(*) AS count FROM photos GROUP BY ALL),
days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM photos)
SELECT cell, date, coalesce(count, 0) AS count
FROM (SELECT DISTINCT cell FROM counts) CROSS JOIN days LEFT JOIN counts USING (cell, date)""")
def dense_grid(spark, sf_dir):
    return c.fill_cell_days(c.count_cell_days(placed(spark, sf_dir, 7)), *ship_span(spark, sf_dir))


@registry.add(f"""WITH {PHOTOS_SQL}, lookup AS (SELECT {FINE} AS cell, round(avg(l_discount), 6) AS elevation FROM photos GROUP BY 1),
counts AS (SELECT {FINE} AS cell, date, count(*) AS count FROM photos WHERE year(date) BETWEEN 1996 AND 1999
           GROUP BY ALL),
j AS (SELECT cell, date, count, elevation FROM counts JOIN lookup USING (cell)),
s AS (SELECT avg(elevation) AS m, stddev_samp(elevation) AS sd FROM j)
SELECT cell, date, count, elevation, round((elevation - m) / sd, 6) AS elevation_std FROM j, s""")
def cell_frame(spark, sf_dir):
    frame = cell_model_frame(photos(spark, sf_dir), heights(spark, sf_dir, 14), years=(1996, 1999))
    return rounded(frame, 6, "elevation_std")

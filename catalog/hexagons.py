"""Hexagon cells.

The SQL works by angles from the centres of faces, as a check of the vectors that the expressions use. What lies in
base cells and beyond is shared: the numbering of base cells and the turns between faces.
"""

from pyspark.sql import functions as F

from fieldtally.functions import hexagons as h
from fieldtally.operators import cells as c
from fieldtally.operators.audit import distinct_count

from .base import PHOTOS_SQL, Registry, load, photos, rounded

registry = Registry()

_FACES = ", ".join(f"({i}, {lat!r}::DOUBLE, {lon!r}::DOUBLE, {az!r}::DOUBLE)" for i, (lat, lon, az) in enumerate(h.FACES))
_BASES = ", ".join(
    f"({f}, {q}, {r}, {h.base_table()[f * 25 + (q + 2) * 5 + r + 2]})"
    for f in range(20) for q in range(-2, 3) for r in range(-2, 3) if h.base_table()[f * 25 + (q + 2) * 5 + r + 2] >= 0
)
_SPECIAL = ", ".join(f"({x}, {t}, {d}, {h.pentagon_turns(t, d, x == 1)})" for x in (0, 1) for t in range(6) for d in range(7))
_TURNED = ", ".join(f"({t}, {h.DIGITS[step]}, {h.DIGITS[h.turned(*step, t)]})" for t in range(6) for step in h.STEPS)
_DIGITS = " ".join(f"WHEN dq = {q} AND dr = {r} THEN {d}" for (q, r), d in h.DIGITS.items())


def hexagon_sql(points: str) -> str:
    """CTEs up to ``hexagons`` (point, resolution, cell, face, q, r), of a query that gives point, lat, lon, resolution."""
    return f"""RECURSIVE spots AS MATERIALIZED ({points}),
faces(face, flat, flon, az) AS (VALUES {_FACES}),
bases(face, q, r, entry) AS (VALUES {_BASES}),
special(corner, turns, lead, sixths) AS (VALUES {_SPECIAL}),
turned(sixths, digit, to_digit) AS (VALUES {_TURNED}),
nearest AS (
  SELECT point, resolution, any_value(radians(lat)) AS la, any_value(radians(lon)) AS lo,
         max(sin(radians(lat)) * sin(flat) + cos(radians(lat)) * cos(flat) * cos(radians(lon) - flon)) AS d,
         arg_max(face, sin(radians(lat)) * sin(flat) + cos(radians(lat)) * cos(flat) * cos(radians(lon) - flon)) AS face
  FROM spots, faces WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY point, resolution
),
polar AS (
  SELECT point, resolution, face, tan(acos(least(d, 1.0))) / ((3 - sqrt(5)) / 2) * pow(sqrt(7), resolution) AS far,
         az - atan2(cos(la) * sin(lo - flon), cos(flat) * sin(la) - sin(flat) * cos(la) * cos(lo - flon))
            - CASE WHEN resolution % 2 = 1 THEN asin(sqrt(3.0 / 28)) ELSE 0 END AS angle
  FROM nearest JOIN faces USING (face)
),
exact AS (
  SELECT point, resolution, face, far * cos(angle) + far * sin(angle) / sqrt(3) AS q, far * sin(angle) * 2 / sqrt(3) AS r FROM polar
),
whole AS (SELECT *, round(q - r) AS a, round(r) AS b, round(-q) AS c FROM exact),
off AS (SELECT *, abs(a - q + r) AS da, abs(b - r) AS db, abs(c + q) AS dc FROM whole),
placed AS (
  SELECT point, resolution, face,
         CASE WHEN da > db AND da > dc THEN -c WHEN db > dc THEN -c ELSE a + b END::BIGINT AS q,
         CASE WHEN da > db AND da > dc THEN b WHEN db > dc THEN -a - c ELSE b END::BIGINT AS r
  FROM off
),
up AS (
  SELECT point, resolution, face, q, r, resolution AS level, []::INTEGER[] AS digits FROM placed
  UNION ALL
  SELECT point, resolution, face, pq, pr, level - 1, list_prepend(CASE {_DIGITS} END, digits)
  FROM (SELECT *, q - CASE WHEN level % 2 = 1 THEN 2 * pq + pr ELSE 3 * pq - pr END AS dq,
                  r - CASE WHEN level % 2 = 1 THEN 3 * pr - pq ELSE pq + 2 * pr END AS dr
        FROM (SELECT *, round(CASE WHEN level % 2 = 1 THEN 3 * q - r ELSE 2 * q + r END / 7.0)::BIGINT AS pq,
                        round(CASE WHEN level % 2 = 1 THEN q + 2 * r ELSE 3 * r - q END / 7.0)::BIGINT AS pr
              FROM up WHERE level > 0))
),
based AS (
  SELECT point, resolution, digits, entry & 127 AS base,
         CASE WHEN entry & 1024 > 0 THEN special.sixths ELSE (entry >> 7) & 7 END AS sixths
  FROM up JOIN bases USING (face, q, r)
  LEFT JOIN special ON corner = entry >> 11 AND turns = (entry >> 7) & 7 AND lead = coalesce(list_filter(digits, lambda d: d > 0)[1], 0)
  WHERE level = 0
),
tables AS (SELECT sixths, list(to_digit ORDER BY digit) AS to_digit FROM turned GROUP BY sixths),
hexagons AS (
  SELECT point, resolution, face, placed.q, placed.r,
         576460752303423488 + (resolution::BIGINT << 52) + (base::BIGINT << 45) + (1::BIGINT << (45 - 3 * resolution)) - 1
           + coalesce(list_sum(list_transform(digits, lambda d, i: to_digit[d + 1]::BIGINT << (45 - 3 * i)::INTEGER)), 0)::BIGINT AS cell
  FROM based JOIN tables USING (sixths) JOIN placed USING (point, resolution)
)"""


ALL = hexagon_sql(
    "SELECT vec_id AS point, CAST(embedding[1] AS DOUBLE) * 80 AS lat, CAST(embedding[2] AS DOUBLE) * 170 AS lon,"
    " unnest(range(16))::INTEGER AS resolution FROM embeddings"
)


def of_embeddings(spark, sf_dir):
    """Points of the whole globe with their cells at all resolutions."""
    e = F.col("embedding")
    points = load(spark, sf_dir, "embeddings").select(
        "vec_id", (e[0].cast("double") * 80.0).alias("lat"), (e[1].cast("double") * 170.0).alias("lon"),
        F.explode(F.sequence(F.lit(0), F.lit(15))).alias("resolution"),
    )
    return c.add_hexagons(points, "lat", "lon", F.col("resolution"))


@registry.add(f"WITH {ALL} SELECT point AS vec_id, resolution, printf('%x', cell) AS cell FROM hexagons")
def hexagon_index(spark, sf_dir):
    return of_embeddings(spark, sf_dir).select("vec_id", "resolution", h.hex_text(F.col("cell")).alias("cell"))


@registry.add(f"""WITH {ALL} SELECT resolution, count(DISTINCT cell) AS cells, count(DISTINCT cell) AS centres_inside
FROM hexagons GROUP BY resolution""")
def hexagon_centres(spark, sf_dir):
    """How many cells hold their own centre: all of them."""
    cells = of_embeddings(spark, sf_dir).select("resolution", "cell").distinct()
    centres = cells.withColumn("centre", h.hex_centre(F.col("cell")))
    again = h.hex_cell(F.col("centre.lat"), F.col("centre.lon"), F.col("resolution"))
    return centres.groupBy("resolution").agg(
        F.count("*").alias("cells"), F.count(F.when(again == F.col("cell"), 1)).alias("centres_inside")
    )


@registry.add(f"""WITH {ALL}, cells AS (SELECT DISTINCT resolution, cell FROM hexagons WHERE resolution >= 4)
SELECT resolution, count(*) AS cells, count(*) AS borders_hold FROM cells GROUP BY resolution""")
def hexagon_borders(spark, sf_dir):
    """How many cells hold all points of their border moved a little inwards, and none moved outwards: all of them.

    Cells of less than a degree or so, where moves in degrees are straight."""
    cells = of_embeddings(spark, sf_dir).where("resolution >= 4").select("resolution", "cell").distinct()
    rings = cells.withColumn("centre", h.hex_centre(F.col("cell"))).withColumn("p", F.explode(h.hex_ring(F.col("cell"))))
    lon, lat = F.col("p")[0], F.col("p")[1]
    # the shorter way round the globe
    east = F.pmod(lon - F.col("centre.lon") + 180.0, F.lit(360.0)) - 180.0
    north = lat - F.col("centre.lat")

    def moved(share: float):
        return h.hex_cell(F.col("centre.lat") + north * share, F.col("centre.lon") + east * share, F.col("resolution"))

    at_pole = F.abs(lat) + F.abs(north) > 89.0  # degrees are no plane there
    kept = at_pole | ((moved(0.98) == F.col("cell")) & (moved(1.02) != F.col("cell")))
    hold = rings.groupBy("resolution", "cell").agg(F.bool_and(kept).alias("hold"))
    return hold.groupBy("resolution").agg(F.count("*").alias("cells"), F.count(F.when(F.col("hold"), 1)).alias("borders_hold"))


SITES = """SELECT DISTINCT concat_ws(' ', latitude, longitude) AS point, latitude AS lat, longitude AS lon, 7 AS resolution FROM photos"""
PLACED = f"""{hexagon_sql(SITES).replace('RECURSIVE spots', f'RECURSIVE {PHOTOS_SQL}, spots')},
seen AS (SELECT photos.*, cell, face, q, r FROM photos JOIN hexagons ON point = concat_ws(' ', latitude, longitude))"""


def placed(spark, sf_dir):
    return c.add_hexagons(photos(spark, sf_dir))


@registry.add(f"WITH {PLACED} SELECT cell, count(*) AS photo_count FROM seen GROUP BY cell")
def hexagon_counts(spark, sf_dir):
    return c.count_cells(placed(spark, sf_dir))


@registry.add(f"WITH {PLACED} SELECT cell, date, count(*) AS count FROM seen GROUP BY ALL")
def hexagon_day_counts(spark, sf_dir):
    return c.count_cell_days(placed(spark, sf_dir))


@registry.add(f"WITH {PLACED} SELECT count(DISTINCT cell) AS n FROM seen")
def hexagon_distinct(spark, sf_dir):
    return distinct_count(placed(spark, sf_dir), "cell")


@registry.add(f"""WITH {PLACED}, looked_up AS (SELECT cell, round(avg(l_discount), 6) AS elevation FROM seen WHERE l_returnflag = 'A' GROUP BY cell)
SELECT photo_url, page_url, cell, elevation FROM seen LEFT JOIN looked_up USING (cell)""")
def hexagon_enrich(spark, sf_dir):
    rows = placed(spark, sf_dir)
    heights = c.mean_by_cell(rows.where(F.col("l_returnflag") == "A").withColumn("elevation", F.col("l_discount")))
    out = c.attach_by_cell(rows, rounded(heights, 6, "elevation"))
    return out.select("photo_url", "page_url", "cell", "elevation")


# The photos lie on one face of the icosahedron, so corners follow from its plane alone. Resolution 7 is an odd one.
RINGS = f"""{PLACED},
hexes AS (SELECT DISTINCT cell, face, q, r FROM seen),
corners(k, cq, cr) AS (VALUES (0, 2, 1), (1, 1, 2), (2, -1, 1), (3, -2, -1), (4, -1, -2), (5, 1, -1)),
points AS (SELECT cell, -1 AS k, face, q::DOUBLE AS q, r::DOUBLE AS r FROM hexes
           UNION ALL SELECT cell, k, face, q + cq / 3.0, r + cr / 3.0 FROM hexes, corners),
flat AS (SELECT cell, k, face, (3 - sqrt(5)) / 2 / pow(sqrt(7), 7) * sqrt(q * q - q * r + r * r) AS far,
                az - atan2(r * sqrt(3) / 2, q - r / 2) - asin(sqrt(3.0 / 28)) AS bearing, flat AS fla, flon AS flo
         FROM points JOIN faces USING (face)),
globe AS (SELECT cell, k, degrees(asin(sin(fla) * cos(atan(far)) + cos(fla) * sin(atan(far)) * cos(bearing))) AS lat,
                 degrees(flo + atan2(sin(bearing) * sin(atan(far)) * cos(fla),
                                     cos(atan(far)) - sin(fla) * (sin(fla) * cos(atan(far)) + cos(fla) * sin(atan(far)) * cos(bearing)))) AS lon
          FROM flat)"""


@registry.add(f"WITH {RINGS} SELECT cell, round(lat, 6) AS lat, round((lon + 540) % 360 - 180, 6) AS lon FROM globe WHERE k = -1")
def hexagon_cells(spark, sf_dir):
    return rounded(rounded(c.hexagons_of(placed(spark, sf_dir)), 6, "lat"), 6, "lon")


@registry.add(f"""WITH {RINGS} SELECT cell, round(lat, 6) AS lat, round((lon + 540) % 360 - 180, 6) AS lon, count(*) AS times
FROM (SELECT * FROM globe WHERE k >= 0 UNION ALL SELECT * FROM globe WHERE k = 0) GROUP BY ALL""")
def hexagon_rings(spark, sf_dir):
    """The points of closed borders: one of them comes twice."""
    cells = placed(spark, sf_dir).select("cell").distinct()
    points = cells.select("cell", F.explode(h.hex_ring(F.col("cell"))).alias("p"))
    points = points.select("cell", F.round(F.col("p")[1], 6).alias("lat"), F.round(F.col("p")[0], 6).alias("lon"))
    return points.groupBy("cell", "lat", "lon").agg(F.count("*").alias("times"))


@registry.add(f"""WITH {RINGS}, closed AS (SELECT * FROM globe WHERE k >= 0 UNION ALL SELECT * FROM globe WHERE k = 0)
SELECT round(avg(lat), 4) AS lat, round(avg((lon + 540) % 360 - 180), 4) AS lon FROM closed""")
def hexagon_map_center(spark, sf_dir):
    centre = c.map_center(placed(spark, sf_dir).select("cell").distinct(), h.hex_ring)
    return rounded(rounded(centre, 4, "lat"), 4, "lon")


@registry.add(f"""WITH {PLACED}, counted AS (SELECT cell, count(*) AS photo_count FROM seen GROUP BY cell)
SELECT cell, 'Feature' AS type, 'Polygon' AS geometry, printf('%x', cell) AS id, photo_count, 7::BIGINT AS points FROM counted""")
def hexagon_geojson(spark, sf_dir):
    features = c.hexagon_features(c.count_cells(placed(spark, sf_dir)), "photo_count")
    shape = "type string, properties struct<cell:string,photo_count:long>, geometry struct<type:string,coordinates:array<array<array<double>>>>"
    read = features.withColumn("f", F.from_json("feature", shape))
    points = F.size(F.col("f.geometry.coordinates")[0]).cast("long")
    return read.select(
        "cell", "f.type", F.col("f.geometry.type").alias("geometry"), F.col("f.properties.cell").alias("id"), "f.properties.photo_count",
        points.alias("points"),
    )

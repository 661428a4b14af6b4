"""Hexagon cells against published ids, and their geometry at every resolution."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.functions import hexagons as h
from fieldtally.operators import cells as c

# Published examples of the grid: point, resolution, id.
KNOWN = [
    (37.775938728915946, -122.41795063018799, 9, "8928308280fffff"),
    (37.3615593, -122.0553238, 5, "85283473fffffff"),
    (37.3615593, -122.0553238, 7, "87283472bffffff"),
    (40.689167, -74.044444, 10, "8a2a1072b59ffff"),
    (37.769377, -122.388903, 9, "89283082e73ffff"),
]


@pytest.fixture(scope="module")
def points(spark):
    """Points all over the globe, and close to the corners of the icosahedron, where pentagons are."""
    rng = np.random.default_rng(1)
    globe = rng.normal(size=(150, 3))
    near = [h.base_cells()[p] + rng.normal(size=3) * 10.0**-k for p in sorted(h.pentagons()) for k in (1, 2, 3, 4, 5, 7)]
    xyz = np.concatenate([globe, near])
    xyz /= np.linalg.norm(xyz, axis=1)[:, None]
    rows = [(float(np.degrees(math.asin(z))), float(np.degrees(math.atan2(y, x)))) for x, y, z in xyz]
    df = spark.createDataFrame(rows, "lat double, lon double").repartition(4)
    return df.withColumn("resolution", F.explode(F.sequence(F.lit(0), F.lit(15))))


def test_published_ids(spark):
    df = spark.createDataFrame(KNOWN, "lat double, lon double, resolution int, id string")
    cell = h.hex_cell(F.col("lat"), F.col("lon"), F.col("resolution"))
    assert all(r.got == r.id for r in df.select("id", h.hex_text(cell).alias("got")).collect())
    found = {r.id: r for r in df.select("id", h.hex_centre(h.hex_from_text(F.col("id"))).alias("p"), h.hex_ring(h.hex_from_text(F.col("id"))).alias("ring")).collect()}
    assert tuple(found["85283473fffffff"].p) == pytest.approx((37.34579337536848, -121.97637597255124), abs=1e-11)
    assert tuple(found["8928308280fffff"].p) == pytest.approx((37.77670234943567, -122.41845932318311), abs=1e-11)
    ring = [
        (37.271355866731895, -121.91508032705622), (37.353926450852256, -121.86222328902491), (37.42834118609435, -121.92354999630156),
        (37.42012867767778, -122.03773496427027), (37.33755608435298, -122.090428929044), (37.26319797461824, -122.02910130919),
    ]
    got = [(lat, lon) for lon, lat in found["85283473fffffff"].ring]
    assert np.allclose(got, [*ring, ring[0]], atol=1e-11)


def test_numbering_of_base_cells():
    assert sorted(h.pentagons()) == [4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117]  # as published
    assert len(h.base_cells()) == 122 and all(h.home(i)[0] == face for i, face in h.HOME_FACES.items())


def test_centres_and_parents(points):
    cell = F.col("cell")
    df = points.withColumn("cell", h.hex_cell(F.col("lat"), F.col("lon"), F.col("resolution")))
    df = df.withColumn("centre", h.hex_centre(cell)).withColumn("again", h.hex_cell(F.col("centre.lat"), F.col("centre.lon"), F.col("resolution")))
    rows = df.select("*", h.hex_parent(cell, 3).alias("third"), h.hex_resolution(cell).alias("r"), h.hex_is_pentagon(cell).alias("five")).collect()
    assert all(r.cell == r.again and r.r == r.resolution for r in rows)
    assert all((r.third is None) == (r.resolution < 3) and (r.resolution != 3 or r.third == r.cell) for r in rows)
    assert {r.resolution for r in rows if r.five} >= set(range(12))
    own = {(r.lat, r.lon): r.cell for r in rows if r.resolution == 3}
    # a child's centre lies in its parent
    deep = [r for r in rows if r.resolution == 4]
    inside = sum(own[r.lat, r.lon] == r.third for r in deep)
    assert inside > 0.8 * len(deep)  # children reach over their parent's border a little


def test_rings_of_neighbours_share_their_corners(spark):
    """Round whole resolutions: every corner belongs to three cells, also next to pentagons and across faces."""
    rng = np.random.default_rng(2)
    xyz = rng.normal(size=(14000, 3))
    xyz /= np.linalg.norm(xyz, axis=1)[:, None]
    lat, lon = np.degrees(np.arcsin(xyz[:, 2])), np.degrees(np.arctan2(xyz[:, 1], xyz[:, 0]))
    spots = spark.createDataFrame(list(zip(lat.tolist(), lon.tolist())), "lat double, lon double").repartition(4)
    for resolution, cells in ((0, 122), (1, 842)):
        seen = spots.select(h.hex_cell(F.col("lat"), F.col("lon"), resolution).alias("cell")).distinct()
        rows = seen.select("cell", h.hex_ring(F.col("cell")).alias("ring"), h.hex_is_pentagon(F.col("cell")).alias("five")).collect()
        assert len(rows) == cells and sum(r.five for r in rows) == 12
        corners: dict[tuple, int] = {}
        for r in rows:
            assert r.ring[0] == r.ring[-1]
            for p in r.ring[:-1]:
                key = tuple(np.round([math.cos(math.radians(p[1])) * f(math.radians(p[0])) for f in (math.cos, math.sin)] + [p[1] / 90], 7) + 0.0)
                corners[key] = corners.get(key, 0) + 1
        times = sorted(corners.values())
        if resolution == 0:
            assert set(times) == {3} and len(times) == (110 * 6 + 12 * 5) // 3
        else:  # odd: crossings of the icosahedron's edges belong to two cells
            assert set(times) == {2, 3} and times.count(3) == (830 * 6 + 12 * 5) // 3


def test_unknown_coordinates(spark):
    rows = [(None, 1.0), (1.0, None), (float("nan"), 1.0), (91.0, 0.0), (0.0, 400.0), (90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0)]
    df = c.add_hexagons(spark.createDataFrame(rows, "latitude double, longitude double"), resolution=8)
    got = [r.cell for r in df.collect()]
    assert got[:5] == [None] * 5 and None not in got[5:] and got[7] == got[8]
    out_of_range = spark.range(1).select(h.hex_cell(F.lit(1.0), F.lit(1.0), F.lit(16)).alias("c"), h.hex_centre(F.lit(None).cast("long")).alias("p"), h.hex_ring(F.lit(None).cast("long")).alias("r")).first()
    assert tuple(out_of_range) == (None, None, None)
    with pytest.raises(ValueError):
        h.hex_cell(F.lit(1.0), F.lit(1.0), 16)


def test_features_and_centre(spark):
    df = c.add_hexagons(spark.createDataFrame([(30.2, -97.7), (30.2, -97.7), (30.4, -97.5), (None, 1.0)], "latitude double, longitude double"))
    counts = c.count_cells(df)
    feature = json.loads(c.hexagon_features(counts, "photo_count").orderBy(F.desc("feature")).first().feature)
    assert feature["geometry"]["type"] == "Polygon" and len(feature["geometry"]["coordinates"][0]) == 7
    assert len(feature["properties"]["cell"]) == 15 and feature["properties"]["photo_count"] in (1, 2)
    centre = c.map_center(counts, h.hex_ring).first()
    assert 30.2 < centre.lat < 30.4 and -97.7 < centre.lon < -97.5
    near = {round(r.lat, 1) for r in c.hexagons_of(df).collect()}
    assert near == {30.2, 30.4}


def test_cells_are_worked_out_once_a_row_whatever_is_filtered(spark):
    points = spark.createDataFrame([(30.5, -95.25), (None, 1.0), (91.0, 0.0)], "latitude double, longitude double")
    counted = c.count_cells(c.add_hexagons(points))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [r.photo_count for r in counted.collect()] == [1]


def test_batches_give_the_cells_of_the_expression(points):
    lat, lon, level = F.col("lat"), F.col("lon"), F.col("resolution")
    both = points.select(h.hex_cell(lat, lon, level).alias("a"), h.hex_cell_by_batch(lat, lon, level).alias("b"))
    assert both.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0

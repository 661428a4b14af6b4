"""Z-order keys and boxes as ranges of keys."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fieldtally.functions.geo import Box
from fieldtally.functions.zorder import KEY_ZOOM, MAX_RANGES, box_ranges, interleaved, tile_of, z_key
from fieldtally.operators.filters import filter_by_bbox, filter_by_bbox_in_order
from fieldtally.sources.sinks import write_in_z_order


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-88, 88, 6000), rng.uniform(-180, 180, 6000)))]
    rows += [(9000, None, 1.0), (9001, 1.0, None), (9002, 90.0, 180.0), (9003, -90.0, -180.0), (9004, float("nan"), 0.0)]
    return spark.createDataFrame(rows, "i int, latitude double, longitude double").repartition(3)


def test_keys(points):
    rows = points.select("*", z_key(F.col("latitude"), F.col("longitude")).alias("z")).collect()
    for r in rows:
        if r.i in (9000, 9001, 9004):
            assert r.z is None
        elif r.i < 9000:
            assert abs(r.z - interleaved(*tile_of(r.latitude, r.longitude))) < 1 << 8 or r.z == interleaved(*tile_of(r.latitude, r.longitude))


def test_ranges_hold_the_box_and_little_else():
    rng = random.Random(5)
    whole = 4**KEY_ZOOM
    for _ in range(60):
        lon, lat, size = rng.uniform(-180, 150), rng.uniform(-60, 40), rng.choice([1e-6, 0.01, 1, 20])
        box = Box(lon, lat, lon + size * rng.choice([1, 1.5]), lat + size)
        ranges = box_ranges(box)
        assert 1 <= len(ranges) <= MAX_RANGES and all(a <= b for a, b in ranges) and all(p[1] + 1 < q[0] for p, q in zip(ranges, ranges[1:]))
        for _ in range(50):
            z = interleaved(*tile_of(rng.uniform(box.min_lat, box.max_lat), rng.uniform(box.min_lon, box.max_lon)))
            assert any(a <= z <= b for a, b in ranges)
        (x0, y1), (x1, y0) = tile_of(box.min_lat, box.min_lon), tile_of(box.max_lat, box.max_lon)
        covered = sum(b - a + 1 for a, b in ranges)
        assert covered < 4 * (x1 - x0 + 3) * (y1 - y0 + 3) + whole * 1e-9
    assert box_ranges(Box(1, 1, 0, 0)) == [] and box_ranges(Box(-180, -90, 180, 90)) == [(0, whole - 1)]


@pytest.mark.parametrize("box", [Box(-95.9, 29.9, -60.0, 55.2), Box(-180, -90, 180, 90), Box(10, 10, 10.5, 10.5), Box(5, 5, 4, 4)])
def test_equal_to_the_plain_filter(spark, points, tmp_path, box):
    table = write_in_z_order(points, str(tmp_path / "t"), files=12)
    got = filter_by_bbox_in_order(table, box)
    assert sorted(r.i for r in got.collect()) == sorted(r.i for r in filter_by_bbox(points, box).collect())
    assert table.count() == points.count()


def test_ranges_reach_the_scan_and_skip_row_groups(spark, points, tmp_path):
    path = tmp_path / "t"
    table = write_in_z_order(points, str(path), files=24)
    found = filter_by_bbox_in_order(table, Box(-96.0, 29.0, -80.0, 41.0))
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", old)
    assert "GreaterThanOrEqual(z," in plan.split("PushedFilters")[1]
    groups = [pq.ParquetFile(p).metadata.row_group(0).column(3).statistics for p in path.glob("*.parquet") if pq.ParquetFile(p).metadata.num_rows]
    spans = [(s.min, s.max) for s in groups if s.has_min_max]
    ranges = box_ranges(Box(-96.0, 29.0, -80.0, 41.0))
    read = sum(any(a <= high and low <= b for a, b in ranges) for low, high in spans)
    assert 0 < read <= len(spans) / 4  # three quarters of the files and more are passed over
    assert found.count() > 0


def test_files_in_order_stay_small(spark, tmp_path):
    points = spark.range(1000).selectExpr("id / 20 AS latitude", "id / 10 AS longitude")
    write_in_z_order(points, str(tmp_path / "t"), files=2, sorted_rows=50)
    assert len(list((tmp_path / "t").glob("*.parquet"))) >= 15

"""Readers, sinks, payloads, filters, daily table, scaling, cells."""

import json
import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldtally.functions import geo
from fieldtally.operators import audit, cells, daily, filters
from fieldtally.operators import frequency as fr
from fieldtally.operators.joins import lookup_join
from fieldtally.operators.scaling import minmax, zscore
from fieldtally.sources import payload as pl
from fieldtally.sources.sinks import write_table
from fieldtally.sources.tables import read_days, read_photos, read_weather

FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
D = date(2020, 1, 1)


def day(i):
    return D + timedelta(i)


# ---- sources and sinks


def test_read_photos(spark, tmp_path):
    pd.DataFrame(
        {
            "species": ["[{'latin_name': 'A b', 'page_url': None}]", "[]", "[]"],
            "date": ["2020-05-01", "2017-12-31", "2024-12-31"],
            "full_caption": ['He said "hi",\nthen left', "x", None],
            "latitude": [30.5, None, None],
            "note": ["kept", "", ""],
        }
    ).to_csv(tmp_path / "photos.csv", index=False)
    df = read_photos(spark, str(tmp_path / "photos.csv"))
    assert dict(df.dtypes) == {"species": "string", "date": "date", "full_caption": "string", "latitude": "double", "note": "string"}
    rows = df.orderBy("date").collect()
    assert [(r.date, r.full_caption, r.latitude) for r in rows] == [
        (date(2020, 5, 1), 'He said "hi",\nthen left', 30.5), (date(2024, 12, 31), None, None)]
    assert read_photos(spark, str(tmp_path / "photos.csv"), filter_years=False).count() == 3


def test_read_days_and_weather(spark, tmp_path):
    pd.DataFrame({"date": ["2020-01-01", "2020-01-02"], "photo_count": [3.0, None]}).to_csv(tmp_path / "days.csv", index=False)
    assert [r.photo_count for r in read_days(spark, str(tmp_path / "days.csv")).orderBy("date").collect()] == [3, None]
    (tmp_path / "w.csv").write_text("date,rain_sum,wind\nbad,x,1\n2020-01-01,2.5,2\n")
    assert [r.rain_sum for r in read_weather(spark, str(tmp_path / "w.csv"), strict=False).collect()] == [None, 2.5]
    with pytest.raises(Exception):
        read_weather(spark, str(tmp_path / "w.csv")).collect()


def test_sinks(spark, tmp_path):
    df = spark.sql("select date'2020-02-01' date, array('a', \"it's\") xs union all select date'2021-02-01', null")
    write_table(df, str(tmp_path / "p"), by_year=True)
    write_table(df, str(tmp_path / "p"), by_year=True)  # replaces
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.where("year = 2020").select("xs").first()[0] == ["a", "it's"] and back.count() == 2
    write_table(df, str(tmp_path / "c"), fmt="csv")
    text = spark.read.csv(str(tmp_path / "c"), header=True, escape='"')
    from fieldtally.functions.lists import parse_list

    assert sorted(r[0] for r in text.select(parse_list(F.col("xs"))).collect()) == [[], ["a", "it's"]]


def payload(**changes):
    daily = {k: [1.5, None] for k in pl.KEYS} | {"time": ["2020-01-01", "2020-01-02"], "extra": [0, 0]} | changes
    return {k: v for k, v in daily.items() if v is not ...}


def test_payloads(spark):
    texts = [
        json.dumps({"daily": payload(), "units": "C"}), json.dumps({"hourly": {}}),
        json.dumps({"daily": payload(rain_sum=...)}), json.dumps({"daily": payload(rain_sum=[1.0])}),
    ]
    df = spark.createDataFrame([(t,) for t in texts], "payload string")
    rows = pl.unpivot_daily(df, strict=False).orderBy("date").collect()
    assert list(rows[0].asDict()) == list(pl.KEYS.values())
    assert [(r.date, r.rain_sum, r.soil_temp_mean) for r in rows] == [(D, 1.5, 1.5), (day(1), None, None)]
    assert sorted(r.error for r in pl.bad_payloads(df).collect()) == [
        "daily variables differ in length", "payload is missing daily variables: rain_sum",
        "payload is missing the 'daily' key"]
    with pytest.raises(Exception, match="rain_sum"):
        pl.unpivot_daily(df.where(F.col("payload").contains("extra") & ~F.col("payload").contains("rain_sum"))).collect()


# ---- filters


def years(spark, first, n, text=False):
    rows = [(date(first + i, 12, 31), i) for i in range(n)]
    df = spark.createDataFrame(rows, "date date, v int")
    return df.withColumn("date", F.col("date").cast("string")) if text else df


@pytest.mark.parametrize("text", [False, True])
def test_filter_by_year(spark, text):
    assert filters.filter_by_year(years(spark, 2015, 10, text)).count() == 7
    assert filters.filter_by_year(years(spark, 2010, 5, text)).count() == 0
    custom = filters.filter_by_year(years(spark, 2010, 15, text), "date", 2012, 2015)
    assert [r.v for r in custom.orderBy("date").collect()] == [2, 3, 4, 5] and custom.columns == ["date", "v"]


def test_year_filter_reaches_the_scan(spark, tmp_path):
    years(spark, 2010, 15).write.parquet(str(tmp_path / "y"))
    plan = filters.filter_by_year(spark.read.parquet(str(tmp_path / "y")))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2018-01-01)" in plan and "LessThan(date,2025-01-01)" in plan


def test_bbox(spark):
    df = spark.createDataFrame(
        [(29.9, -95.9), (31.2, -94.0), (31.3, -95.0), (None, -95.0), (float("nan"), -95.0)], "latitude double, longitude double"
    )
    assert filters.filter_by_bbox(df, geo.Box.default()).count() == 2
    assert filters.filter_by_bbox(df.drop("latitude"), geo.Box.default()).count() == 5


def test_small_filters(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (None, None)], "a int, b int")
    assert df.where(filters.differing(F.col("a"), F.col("b"))).count() == 3
    assert filters.drop_incomplete(df, ["a"]).count() == 2
    assert filters.available(df, ["b", "z", "a"]).columns == ["b", "a"]
    assert audit.null_counts(df, ["a", "b"]).first().asDict() == {"a": 2, "b": 1}
    assert audit.distinct_count(df, "b").first()[0] == 2


# ---- daily table

SERIES = st.lists(st.none() | st.floats(0, 50).map(lambda x: round(x, 2)), min_size=1, max_size=40)


@FEW
@given(SERIES)
def test_rolling_matches_pandas(spark, values):
    df = spark.createDataFrame([(day(i), v) for i, v in enumerate(values)], "date date, rain_sum double")
    s = pd.Series([np.nan if v is None else v for v in values], dtype=float)
    got = daily.rolling(daily.rolling(df, "rain_sum", {"s3": 3, "s7": 7}), "rain_sum", {"m30": 30}, "mean").orderBy("date").toPandas()
    for name, want in (("s3", s.rolling(3, min_periods=1).sum()), ("s7", s.rolling(7, min_periods=1).sum()),
                       ("m30", s.rolling(30, min_periods=1).mean())):
        np.testing.assert_allclose(got[name].astype(float), want, atol=1e-9)


def test_presence_and_features(spark):
    weather = spark.createDataFrame(
        [(day(0), 1.0, 20.0, 10.0), (day(1), None, 21.0, None), (day(3), 4.0, 22.0, 12.0)],
        "date date, rain_sum double, temperature_max double, temperature_min double",
    )
    days = spark.createDataFrame([(day(0), 2), (day(0), 3), (day(1), None), (day(9), 1)], "date date, photo_count bigint")
    photos = spark.createDataFrame(
        [(day(0), ["a", "b", None]), (day(0), ["a"]), (day(3), []), (day(9), ["z"])], "date date, species_list array<string>"
    )
    base = daily.attach_presence(daily.calendar_from(weather), days, photos)
    out = daily.add_weather_features(base, weather).orderBy("date").collect()
    assert [(r.has_mushroom, r.photo_count, r.species_count) for r in out] == [(1, 5, 2), (1, 0, 0), (0, 0, 0)]
    assert [(r.rain_1, r.rain_3, r.rain_7) for r in out] == [(1.0, 1.0, 1.0), (None, 1.0, 1.0), (4.0, 5.0, 5.0)]
    assert [(r.temperature_mean, r.temp_range) for r in out] == [(15.0, 10.0), (None, None), (17.0, 10.0)]
    assert out[2].seasonal_sin == pytest.approx(math.sin(2 * math.pi * 4 / 365.25))
    assert [r.date for r in daily.uncovered_days(days, daily.calendar_from(weather)).collect()] == [day(9)]

    repeated = daily.attach_presence(daily.calendar_from(weather), days, keep_duplicates=True)
    assert sorted(r.photo_count for r in repeated.collect()) == [0, 0, 2, 3]
    bare = daily.attach_presence(daily.calendar_from(weather), days.drop("photo_count")).orderBy("date").collect()
    assert [(r.has_mushroom, r.photo_count, r.species_count) for r in bare] == [(1, 0, 0), (1, 0, 0), (0, 0, 0)]


def test_own_mean_temperature_is_kept(spark):
    df = spark.createDataFrame([(20.0, 10.0, 1.0)], "temperature_max double, temperature_min double, temperature_mean double")
    assert daily.temperature_features(df).first().temperature_mean == 1.0
    assert daily.temperature_features(df.drop("temperature_min")).columns == ["temperature_max", "temperature_mean"]


def test_fill_calendar(spark):
    df = spark.createDataFrame([(day(0), 1), (day(3), None), (day(4), 5)], "date date, v int")
    assert [tuple(r) for r in daily.fill_calendar(df).orderBy("date").collect()] == [
        (day(0), 1), (day(1), None), (day(2), None), (day(3), None), (day(4), 5)]


def test_summary_and_span(spark):
    df = spark.createDataFrame([(day(0), 1, 3), (day(5), 0, 4)], "date date, has_mushroom int, species_count int")
    assert tuple(audit.dataset_summary(df).first()) == (2, day(0), day(5), 1, 0.5, 7)
    assert tuple(audit.date_span(df).first()) == ("2020-01-01", "2020-01-06")
    with pytest.raises(Exception, match="no valid dates"):
        audit.date_span(df.where("false")).collect()
    with pytest.raises(ValueError):
        audit.date_span(df, "day")


# ---- frequency


def test_frequency_sources(spark):
    days = spark.createDataFrame([(["a", "a", "b"],)], "identified_species_list array<string>")
    photos = spark.createDataFrame([(["x", "y"],), (["x", "x"],), ([],)], "species_list array<string>")
    rows = sorted(tuple(r) for r in fr.species_frequency(days, photos).collect())
    assert rows == [("x", 3, "photo-level"), ("y", 1, "photo-level")]
    assert sum(r[1] for r in rows) == photos.selectExpr("sum(size(species_list))").first()[0]
    none = photos.where("false")
    assert fr.species_frequency(days, none).count() == 0
    assert sorted(tuple(r) for r in fr.species_frequency_or_days(days, none).collect()) == [("a", 2, "day-level"), ("b", 1, "day-level")]
    assert fr.species_frequency(days, photos.drop("species_list").selectExpr("1 as i")).count() == 2
    assert fr.species_frequency_or_days(days, photos).count() == 2


def test_top_or_other(spark):
    df = spark.createDataFrame([(c,) for c in "aabbbcd"] + [(None,)], "s string")
    assert sorted(r.species_simplified for r in fr.top_or_other(df, "s", 2).collect()) == ["Other"] * 3 + ["a"] * 2 + ["b"] * 3


# ---- scaling


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5, 2.0), (2.0, 5, None), (4.0, 5, 4.0)], "x double, c int, n double")
    rows = minmax(zscore(df, ["x", "c"]), ["x", "n", "c"]).orderBy("x").collect()
    s = pd.Series([1.0, 2.0, 4.0])
    assert [r.x_std for r in rows] == pytest.approx(list((s - s.mean()) / s.std()))
    assert [r.c_std for r in rows] == [None] * 3 and [r.c_norm for r in rows] == [None] * 3
    assert [r.n_norm for r in rows] == [0.0, None, 1.0]


# ---- cells


def test_cells(spark):
    points = [(29.98444, -95.34139), (0.0, 0.0), (89.9, 180.0), (-89.9, -180.0), (None, 1.0), (1.0, float("nan"))]
    df = spark.createDataFrame(points, "latitude double, longitude double")
    out = cells.add_cells(df).withColumn("parent", geo.cell_parent(F.col("cell"))).collect()
    assert [r.cell is None for r in out] == [False] * 4 + [True] * 2
    up = cells.add_cells(df, zoom=13).collect()
    assert [r.parent for r in out] == [r.cell for r in up]
    one = cells.cells_of(cells.add_cells(df.limit(1))).first()
    assert abs(one.lat - points[0][0]) < 0.012 and abs(one.lon - points[0][1]) < 0.012
    back = spark.createDataFrame([(one.lat, one.lon)], df.schema)
    assert cells.add_cells(back).first().cell == one.cell
    with pytest.raises(ValueError):
        geo.cell_id(F.lit(0.0), F.lit(0.0), 30)


def test_features_and_center(spark):
    df = cells.add_cells(spark.createDataFrame([(30.0, -95.0)] * 3, "latitude double, longitude double"))
    [row] = cells.cell_features(cells.count_cells(df), "photo_count").collect()
    f = json.loads(row.feature)
    ring = f["geometry"]["coordinates"][0]
    assert (f["type"], f["geometry"]["type"], f["properties"]) == ("Feature", "Polygon", {"cell": row.cell, "photo_count": 3})
    assert len(ring) == 5 and ring[0] == ring[-1] and min(p[0] for p in ring) <= -95.0 <= max(p[0] for p in ring)
    center = cells.map_center(cells.cells_of(df)).first()
    assert center.lat == pytest.approx(np.mean([p[1] for p in ring])) and center.lon == pytest.approx(np.mean([p[0] for p in ring]))
    assert tuple(cells.map_center(cells.cells_of(df.where("false"))).first()) == cells.FALLBACK_CENTER


COUNTS = st.lists(st.tuples(st.integers(1, 3), st.integers(-3, 12)), unique=True, max_size=12)


@FEW
@given(COUNTS, st.booleans())
def test_fill_cell_days_equals_grid_join(spark, keys, given_cells):
    counts = spark.createDataFrame([(c, day(i), 1 + abs(i)) for c, i in keys], "cell bigint, date date, count bigint")
    listed = spark.createDataFrame([(2,), (3,), (5,)], "cell bigint") if given_cells else None
    got = {tuple(r) for r in cells.fill_cell_days(counts, D, day(9), listed).collect()}
    base = listed if given_cells else counts.select("cell").distinct()
    grid = cells.space_time_grid(base, D, day(9))
    want = grid.join(counts, ["cell", "date"], "left").na.fill(0, ["count"]).select("cell", "date", "count")
    assert got == {tuple(r) for r in want.collect()}
    assert len(got) == 10 * base.count()


def test_space_time_grid_steps(spark):
    df = spark.createDataFrame([(1,), (2,)], "cell bigint")
    assert cells.space_time_grid(df, D, date(2020, 12, 31), "1 month").count() == 24
    assert cells.space_time_grid(df, D, day(-1)).count() == 0
    with pytest.raises(ValueError):
        cells.fill_cell_days(df, D, day(-1))


@pytest.mark.parametrize("spread", [1, 8])
def test_lookup_join_keeps_every_row(spark, spread):
    facts = spark.range(500).selectExpr("id", "if(id % 3 = 0, 0, id) as k", "1 as same")
    lookup = spark.createDataFrame([(0, "hot"), (7, "seven")], "k bigint, v string")
    out = lookup_join(facts, lookup, "k", spread)
    assert out.count() == 500 and out.columns == ["k", "id", "same", "v"]
    assert out.where("v = 'hot'").count() == 167 and out.where("v = 'seven'").count() == 1


def test_points_on_no_globe_have_no_cell(spark):
    values = [(95.0, 0.0), (0.0, 400.0), (float("inf"), 0.0), (0.0, float("-inf")), (float("nan"), 0.0), (None, 0.0)]
    df = spark.createDataFrame([*values, (89.9, 0.0), (85.0, 180.0)], "lat double, lon double")
    cells_of = [r[0] for r in df.select(geo.cell_id(F.col("lat"), F.col("lon"), 4)).collect()]
    assert cells_of[:6] == [None] * 6 and None not in cells_of[6:]


def test_every_sentence_of_a_date_is_kept(spark):
    say = "Temperature {}.0° x min. 1°, max. 9°. Precipitation 0.0 mm".format
    df = spark.createDataFrame([(date(2020, 1, 1), "a", 1, say(5)), (date(2020, 1, 1), "b", 2, say(7)), (date(2020, 1, 2), "c", 3, None)],
                               "date date, url string, photo_count long, weather_summary string")
    own = daily.with_weather_metrics(df, keep=("url",))
    assert {(r.url, r.temp) for r in own.collect()} == {("a", 5.0), ("b", 7.0), ("c", None)}
    merged = daily.join_weather_metrics(df.select("date", "url"), own)
    assert sorted((r.url, r.temp) for r in merged.collect() if r.temp) == [("a", 5.0), ("a", 7.0), ("b", 5.0), ("b", 7.0)]
    assert merged.count() == 5


def test_payload_is_parsed_once(spark):
    one = json.dumps({"daily": {k: ["2020-01-01"] if k == "time" else [1.0] for k in pl.KEYS}})
    df = spark.createDataFrame([(one,)], "payload string")
    plan = pl.unpivot_daily(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "SortAggregate" not in plan
    assert pl.unpivot_daily(df).count() == 1


def test_csv_files_do_not_grow_with_the_table(spark, tmp_path):
    write_table(spark.range(0, 95, 1, 1), str(tmp_path / "c"), fmt="csv", csv_rows=10)
    sizes = [len(f.read_text().splitlines()) - 1 for f in (tmp_path / "c").glob("*.csv")]
    assert sum(sizes) == 95 and max(sizes) == 10


def test_only_the_tables_named_are_landed(spark):
    from pathlib import Path

    from catalog.runs import landed

    [path] = landed(spark, "/root/testdata/sf0.001", "days")
    assert [f.name for f in Path(path.removeprefix("file:")).parent.iterdir()] == ["days.csv"]


def test_landed_text_is_compressed(spark, tmp_path, monkeypatch):
    import gzip
    from pathlib import Path

    from catalog import runs

    spark.sql(
        "SELECT id AS l_orderkey, id % 7 AS l_partkey, id % 5 AS l_suppkey, CAST(id % 3 AS INT) AS l_linenumber, DOUBLE(id) AS l_quantity,"
        " DOUBLE(id) AS l_extendedprice, 0.1D AS l_discount, 'N' AS l_returnflag, TIMESTAMP '2020-01-01' AS l_shipdate FROM range(0, 3000, 1, 1)"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS p_partkey, 'red, \"x\"' AS p_name, concat('t', id) AS p_type, 'B' AS p_brand FROM range(7)").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(runs, "LANDED_ROWS", 1000)
    [path] = runs.landed(spark, str(tmp_path), "photos")
    files = [f for f in Path(path.removeprefix("file:")).iterdir() if f.name.startswith("part-")]
    texts = [gzip.decompress(f.read_bytes()) for f in files]
    assert [len(t.splitlines()) for t in texts] == [1001] * 3
    assert sum(f.stat().st_size for f in files) * 5 < sum(map(len, texts))
    want = sorted(map(tuple, runs.photos(spark, str(tmp_path)).select(*runs.PHOTO_COLUMNS).collect()))
    for split in (False, True):
        assert sorted(map(tuple, read_photos(spark, path, False, split=split).select(*runs.PHOTO_COLUMNS).collect())) == want


def test_join_by_date_is_dealt_by_a_fixed_number(spark):
    days = spark.sql("SELECT DATE '2024-01-01' + CAST(id AS INT) AS date, id AS temp, 1 AS min, 2 AS max, 3 AS precip FROM range(9)")
    merged = daily.join_weather_metrics(days.select("date"), days.hint("shuffle_merge"))
    assert merged.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert merged.count() == 9


def test_records_of_one_date_are_divided_among_tasks(spark):
    days = spark.sql("SELECT DATE '2024-01-01' + CAST(id DIV 60 AS INT) AS date, id AS n, id % 5 AS temp, 1 AS min, 2 AS max, 3 AS precip, map('k', id) AS other FROM range(60)")
    merged = daily.join_weather_metrics(days.select("date", "n", "other"), days)
    assert merged.columns == ["date", "n", "other", "temp", "min", "max", "precip"]
    held = [len(x) for x in merged.rdd.glom().collect()]
    assert sum(held) == 3600 and sum(n > 0 for n in held) > 1
    assert {r["count"] for r in merged.groupBy("n").count().collect()} == {60}

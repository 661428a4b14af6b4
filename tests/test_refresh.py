"""Refresh of some days against a full run."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from fieldtally.plans.modeling import daily_dataset
from fieldtally.plans.refresh import reach, read_daily, refresh_daily, write_daily

D = date(2021, 1, 1)


def sources(spark, edits=()):
    """Days, weather (with gaps and missing rain) and photos; edits change single dates."""
    rng = random.Random(8)
    days, weather, photos = {}, {}, {}
    for i in range(120):
        day = D + timedelta(i)
        days[day] = [rng.randrange(9) for _ in range(rng.randrange(3))]
        photos[day] = [[f"s{rng.randrange(6)}"] for _ in range(rng.randrange(4))]
        if i % 11:
            weather[day] = (rng.choice([None, float(rng.randrange(20))]), float(rng.randrange(10, 30)), float(rng.randrange(10)))
    for kind, day, value in edits:
        {"days": days, "weather": weather, "photos": photos}[kind][day] = value
    frames = (
        spark.createDataFrame([(d, n) for d, ns in days.items() for n in ns], "date date, photo_count long"),
        spark.createDataFrame([(d, *w) for d, w in weather.items() if w], "date date, rain_sum double, temperature_max double, temperature_min double"),
        spark.createDataFrame([(d, s) for d, ss in photos.items() for s in ss], "date date, species_list array<string>"),
    )
    return frames


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    "edits",
    [
        [("days", D + timedelta(40), [7, 7]), ("weather", D + timedelta(58), (99.0, 30.0, 1.0)), ("photos", D + timedelta(58), [["new", "s1"]])],  # reaches the next month
        [("weather", D + timedelta(44), (5.0, 20.0, 2.0)), ("weather", D + timedelta(20), None)],  # a date more and one less
        [("weather", D + timedelta(125), (3.0, 9.0, 1.0)), ("weather", D + timedelta(-3), (8.0, 9.0, 1.0))],  # before and after all
        [],
    ],
)
def test_equal_to_a_full_run(spark, tmp_path, edits):
    path = str(tmp_path / "daily")
    days, weather, photos = sources(spark)
    write_daily(daily_dataset(days, weather, photos), path)
    days, weather, photos = sources(spark, edits)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "daily").rglob("*.parquet")}
    got = refresh_daily(spark, path, days, weather, photos, [d for _, d, _ in edits])
    assert rows_of(got) == rows_of(daily_dataset(days, weather, photos))
    untouched = [p for p, t in files.items() if p.exists() and p.stat().st_mtime_ns == t]
    assert untouched  # months that no change reaches are the files they were


def test_only_changed_dates_are_asked_of_the_sources(spark, tmp_path):
    path = str(tmp_path / "daily")
    days, weather, photos = sources(spark)
    write_daily(daily_dataset(days, weather, photos), path)
    # sources that hold nothing but the changed date give the same
    day = D + timedelta(40)
    edited = sources(spark, [("days", day, [3, 4, 5])])
    only = [x.where(F.col("date") == F.lit(day)) for x in edited]
    assert rows_of(refresh_daily(spark, path, *only, [day])) == rows_of(daily_dataset(*edited))


def test_reach():
    calendar = [D + timedelta(i) for i in range(0, 40, 2)]
    affected, inputs = reach(calendar, [D + timedelta(11)])
    assert sorted(affected) == calendar[6:13] and sorted(inputs) == calendar[0:13]
    assert reach(calendar, [D + timedelta(99)]) == (set(), set(calendar[14:]))


def test_a_month_without_rows_is_an_error(spark, tmp_path):
    path = str(tmp_path / "daily")
    days, weather, photos = sources(spark, [("weather", D + timedelta(200), (1.0, 2.0, 1.0))])
    write_daily(daily_dataset(days, weather, photos), path)
    with pytest.raises(ValueError, match="2021-07"):
        refresh_daily(spark, path, *sources(spark), [D + timedelta(200)])
    assert read_daily(spark, path).count() == weather.count()

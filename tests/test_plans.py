"""Pipelines from files to files."""

from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldtally.functions.geo import Box, cell_id
from fieldtally.functions.rules import RuleSet
from fieldtally.plans import modeling as m
from fieldtally.plans import preprocess as pre


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    """Three years of days and photos, and weather for the middle one."""
    root = tmp_path_factory.mktemp("raw")
    names = ["Amanita muscaria", "Trametes versicolor", "Boletus edulis", "Ganoderma lucidum"]
    photos, days = [], []
    for i in range(0, 1095, 5):
        d = (date(2017, 6, 1) + timedelta(i)).isoformat()
        first, second = names[i // 5 % 4], names[i // 5 % 3]
        days.append({"date": d, "url": f"u{i}", "identified_species": repr([first]), "photo_count": 1 + i % 2})
        photos.append(
            {
                "date": d, "page_url": f"u{i}", "photo_url": f"p{i}", "index_on_page": 1,
                "full_caption": f'{first}, "on\nwood"' if i % 15 else "a lichen",
                "species": repr([{"latin_name": first, "page_url": None}, {"latin_name": second, "page_url": "x"}]),
                "latitude": None if i % 20 == 0 else 30.0 + i / 1000, "longitude": -95.0 + i % 10 / 100,
            }
        )
    pd.DataFrame(days).to_csv(root / "days.csv", index=False)
    pd.DataFrame(photos).to_csv(root / "photos.csv", index=False)
    weather = [
        {
            "date": (date(2018, 1, 1) + timedelta(i)).isoformat(), "temperature_max": 20.0 + i % 9, "temperature_min": 10.0,
            "temperature_mean": 15.0 + i % 7, "rain_sum": float(i % 4), "relative_humidity_mean": 60.0 + i % 13,
            "soil_moisture_mean": 0.1 * (i % 5),
        }
        for i in range(365)
    ]
    pd.DataFrame(weather).to_csv(root / "weather.csv", index=False)
    return root, pd.DataFrame(photos)


@pytest.mark.parametrize("out_fmt", ["parquet", "csv"])
def test_full_run(spark, raw, tmp_path, out_fmt):
    root, photos = raw
    box = Box(-96.0, 30.0, -94.0, 31.0)
    out = m.run_full(
        spark, f"{root}/days.csv", f"{root}/photos.csv", f"{root}/weather.csv", str(tmp_path), rules=RuleSet.from_yaml(),
        box=box, out_fmt=out_fmt,
    )
    photos = photos[(photos.date >= "2018-01-01") & photos.latitude.between(30, 31)]
    first = photos.species.map(lambda s: eval(s)[0]["latin_name"])
    keep = photos[(first != "Trametes versicolor") & ((photos.full_caption != "a lichen") | (first == "Ganoderma lucidum"))]
    assert out["photos_cleaned"].count() == len(keep) == out["photo_geospatial"].count()
    total = sum(r.occurrences for r in out["species_frequency"].collect())
    assert total == 2 * len(keep)
    # other species of a kept photo still count
    assert "Trametes versicolor" in {r.species for r in out["species_frequency"].collect()}
    report = {r.species: r.exclusion_reason for r in out["exclusion_report"].collect()}
    assert report["Trametes versicolor"] == "genus excluded: Trametes" and "Ganoderma lucidum" not in report

    rows = out["daily"].orderBy("date").collect()
    assert len(rows) == 365 and sum(r.has_mushroom for r in rows) == 73
    in_2018 = keep[keep.date < "2019-01-01"]
    assert sum(r.species_count for r in rows) == sum(len({x["latin_name"] for x in eval(s)}) for s in in_2018.species)
    assert rows[6].rain_7 == sum(i % 4 for i in range(7))
    written = spark.read.format(out_fmt).option("header", True).load(f"{tmp_path}/daily")
    assert written.count() == 365 and "year" in written.columns
    for name in ("photos_cleaned", "photo_geospatial", "species_frequency"):
        kwargs = {"multiLine": True, "escape": '"'} if out_fmt == "csv" else {}
        back = spark.read.format(out_fmt).options(header=True, **kwargs).load(f"{tmp_path}/{name}")
        assert back.count() == out[name].count()


def test_lazy_tables_agree_with_the_run(spark, raw):
    from fieldtally.sources.tables import read_days, read_photos

    root, _ = raw
    days, photos = read_days(spark, f"{root}/days.csv"), read_photos(spark, f"{root}/photos.csv")
    out = pre.preprocess_tables(days, photos, RuleSet.from_yaml())
    assert out["photos"].count() == out["photos_cleaned"].count()
    assert out["days"].first().identified_species_count == 1
    assert out["exclusion_report"].count() >= 1
    assert pre.photo_geospatial(photos.drop("species")).first().label_species == "Unidentified"


def test_weather_model(spark, raw):
    root, _ = raw
    from fieldtally.sources.tables import read_days, read_weather

    data = m.daily_dataset(read_days(spark, f"{root}/days.csv"), read_weather(spark, f"{root}/weather.csv"))
    frame, target = m.weather_model_frame(data.drop("species_count"))
    assert target == "photo_count" and frame.count() == 365
    means = frame.agg(*[F.avg(f"{c}_std") for c in m.STANDARDISED]).first()
    assert list(means) == pytest.approx([0.0] * 4, abs=1e-9)
    model, summary = m.run_weather_model(data.drop("species_count"))
    assert summary.count() == 8 and 0.2 < model.psi < 0.7  # one day in five has photos


def test_spatial_model(spark, raw):
    root, _ = raw
    from fieldtally.sources.tables import read_photos

    photos = pre.photo_geospatial(pre.process_photos(read_photos(spark, f"{root}/photos.csv")))
    cell = cell_id(F.col("latitude"), F.col("longitude"), 9)
    heights = photos.select(cell.alias("cell")).distinct().withColumn("elevation", (F.col("cell") % 7).cast("double"))
    model, summary, frame = m.run_spatial_model(photos, heights, zoom=9, rules=RuleSet(exclude_genera=("Boletus",)))
    assert frame.columns == ["cell", "date", "count", "elevation", "elevation_std"]
    assert summary.count() == 3 and model.psi > 0.9  # without zero rows the share is one
    filled = m.cell_model_frame(photos, heights, zoom=9, fill=(date(2018, 1, 1), date(2018, 12, 31)))
    assert filled.count() == 365 * heights.count()
    with pytest.raises(ValueError):
        m.cell_model_frame(photos, heights, rules=RuleSet.empty(), species_col="species")


def test_weather_table_run(spark, tmp_path):
    import json

    from fieldtally.sources.payload import KEYS

    times = [(date(2020, 1, 1) + timedelta(i)).isoformat() for i in range(10)]
    body = {"daily": {k: times if k == "time" else list(range(10)) for k in KEYS}}
    (tmp_path / "p.json").write_text(json.dumps(body))
    (tmp_path / "days.csv").write_text("date\n2020-01-03\n2020-01-05\n\n")
    m.run_weather_table(spark, f"{tmp_path}/days.csv", f"{tmp_path}/p.json", str(tmp_path / "out"))
    rows = spark.read.parquet(f"{tmp_path}/out/daily_weather").orderBy("date").collect()
    assert [r.rain_sum for r in rows] == [2.0, 3.0, 4.0]


def test_models_use_the_checkpoint_folder(spark, tmp_path):
    from fieldtally.session import reusable

    df = spark.range(5)
    assert reusable(df).count() == 5
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    plan = reusable(df)._jdf.queryExecution().toString()
    assert "ExistingRDD" in plan or "RDD" in plan

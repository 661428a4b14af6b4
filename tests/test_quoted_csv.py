"""Quoted CSV in pieces, against the reader that takes a file as a whole."""

import csv
import random

import pytest

from fieldtally.sources.quoted_csv import IN, OUT, ends, first_states, read_quoted_csv
from fieldtally.sources.tables import read_photos


def whole(spark, path):
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def set_size(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield set_size
    for k, v in old.items():
        spark.conf.set(k, v)


def test_states_of_lines():
    cases = {
        "a,b": (OUT, IN), 'a,"b': (IN, OUT), 'a,"b",c': (OUT, OUT), '"': (IN, OUT), '""': (OUT, IN), '"a""b': (IN, OUT), "": (OUT, IN),
        'x",y': (OUT, OUT), 'x","y': (IN, IN), '5" pipe,b': (OUT, OUT), 'a,5" pipe,"b': (IN, IN), '","': (OUT, IN), 'end"': (OUT, OUT),
        'x"",y': (OUT, IN),
    }
    assert {line: ends(line) for line in cases} == cases


def test_states_are_put_together_in_file_order():
    class Row:
        def __init__(self, *v):
            self.file, self.start, self.out, self.inside = v

    maps = [Row("b", 0, IN, IN), Row("a", 20, OUT, IN), Row("a", 0, IN, OUT), Row("a", 10, OUT, IN), Row("b", 5, OUT, OUT)]
    assert first_states(maps) == {("a", 0): OUT, ("a", 10): IN, ("a", 20): IN, ("b", 0): OUT, ("b", 5): IN}


@pytest.mark.parametrize("size", [150, 3000])
def test_equal_to_the_single_reader(spark, tmp_path, small_splits, size):
    """Line breaks, separators and doubled quotes inside quotes, values longer than many splits, and split ends anywhere."""
    rng = random.Random(size)
    parts = ["a", "b c", ",", "\n", '"', "\r\n", "é", "line\n\nline", "", "日本", " , "]
    for f in range(3):
        with open(tmp_path / f"{f}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator="\r\n" if f == 1 else "\n")
            writer.writerow(["id", "text, ""quoted""", "note"])
            for i in range(60):
                text = "".join(rng.choices(parts, k=rng.randrange(8)))
                writer.writerow([f"{f}-{i}", text if i % 20 else text + "long\n" * 60, rng.choice(["", "x", 'say ""hi""', "\n"])])
            if f == 2:
                out.write('plain,5" pipe,x\n\n"closed" late,"y"\n')
    small_splits(size)
    path = str(tmp_path)
    want = whole(spark, [f"{path}/0.csv", f"{path}/2.csv"])
    got = read_quoted_csv(spark, path)
    assert got.columns == want.columns
    if size == 150:
        assert got.rdd.getNumPartitions() > 40
    with open(tmp_path / "1.csv", newline="", encoding="utf-8") as f:  # Spark's reader puts line ends of quoted text in one form
        other = [tuple(v or None for v in row) for row in list(csv.reader(f))[1:]]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([*map(tuple, want.collect()), *other], key=repr)


def test_photos_in_pieces(spark, tmp_path, small_splits):
    with open(tmp_path / "photos.csv", "w", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(["date", "species", "full_caption", "latitude"])
        for i in range(300):
            writer.writerow([f"20{18 + i % 8}-05-01", "[{'latin_name': 'A b'}]", f'He said "{i}",\nthen left', i / 7 if i % 3 else ""])
    small_splits(500)
    path = str(tmp_path / "photos.csv")
    got, want = read_photos(spark, path, split=True), read_photos(spark, path)
    assert got.schema == want.schema and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_headers_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n")
    assert read_quoted_csv(spark, str(tmp_path)).columns == ["id", "text"] and read_quoted_csv(spark, str(tmp_path)).count() == 0

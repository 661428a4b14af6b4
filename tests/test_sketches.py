"""Mergeable distinct counts and exact frequent items."""

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import frequent_items as fi
from fieldtally.operators import sketches as sk

D = date(2020, 1, 1)


@pytest.fixture(scope="module")
def seen(spark):
    rng = random.Random(7)
    rows = [(f"c{rng.randrange(3)}", D + timedelta(rng.randrange(20)), f"s{int(rng.paretovariate(0.7)) % 30000}") for _ in range(30000)]
    rows += [("c0", D, None), (None, D, "s1")]
    return spark.createDataFrame(rows, "cell string, date date, species string").repartition(5), rows


def test_distinct_counts_over_spans(seen, spark, tmp_path):
    df, rows = seen
    sk.distinct_sketches(df, ["cell", "date"], "species").write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    bound = 4 * sk.standard_error()
    for first, days in ((0, 20), (3, 7), (5, 1)):
        span = sk.between(stored, D + timedelta(first), D + timedelta(first + days - 1))
        inside = [r for r in rows if first <= (r[1] - D).days < first + days and r[2] is not None]
        exact = {c: len({s for cell, _, s in inside if cell == c}) for c in ("c0", "c1", "c2")}
        got = {r.cell: r.n_distinct for r in sk.distinct_over(span, ["cell"]).collect()}
        assert all(abs(got[c] - n) <= bound * n + 1 for c, n in exact.items())
        whole = sk.distinct_over(span, []).first().n_distinct
        assert abs(whole - len({r[2] for r in inside})) <= bound * whole + 1


def test_late_records_change_the_stored_sketches(seen):
    df, rows = seen
    early, late = df.where("species < 's2'"), df.where("NOT species < 's2'")
    parts = [sk.distinct_sketches(x, ["cell", "date"], "species") for x in (early, late)]
    both = sk.refreshed(*parts, ["cell", "date"])
    whole = sk.distinct_sketches(df.where("species IS NOT NULL"), ["cell", "date"], "species")
    one, other = (sorted(map(tuple, sk.distinct_over(x, ["cell", "date"]).collect()), key=repr) for x in (both, whole))
    assert one == other


def top(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("counters", [40, 300, 4096])
def test_exact_top(seen, counters):
    df, rows = seen
    got = fi.exact_top(df, "species", 25, counters)
    assert [(r.species, r.occurrences) for r in got.collect()] == top([r[2] for r in rows], 25)


def test_summaries_bound_the_counts(seen):
    df, rows = seen
    found = fi.summaries(df, "species", 50).groupBy("value").agg(F.sum("low").alias("low")).collect()
    taken = next(r.low for r in found if r.value is None)
    exact = Counter(r[2] for r in rows if r[2] is not None)
    low = {r.value: r.low for r in found if r.value is not None}
    assert all(low.get(v, 0) <= n <= low.get(v, 0) + taken for v, n in exact.items()) and taken > 0


def test_flat_counts_and_few_values(spark, monkeypatch):
    monkeypatch.setattr(fi, "MOST_COUNTERS", 64)
    flat = spark.createDataFrame([(f"v{i % 500:03}",) for i in range(2000)], "v string").repartition(3)
    assert [tuple(r) for r in fi.exact_top(flat, "v", 4, 32).collect()] == [(f"v{i:03}", 4) for i in range(4)]
    few = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "v string")
    assert [tuple(r) for r in fi.exact_top(few, "v", 25).collect()] == [("a", 2), ("b", 1)]
    assert fi.exact_top(few.limit(0), "v", 3).count() == 0

from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldtally.llm import sharding


@pytest.mark.parametrize("total", [1, 2, 3, 7, 100, 4097])
def test_permutation(spark, total):
    df = spark.range(total).select(sharding.permuted(F.col("id"), total, 5).alias("p"))
    assert sorted(r.p for r in df.collect()) == list(range(total))


def result(df, count=7, key=3):
    return sorted((tuple(r) for r in sharding.shards(df, count, key).collect()), key=repr)


def test_shards_do_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 3 as string) s")
    one = result(df.repartition(1))
    assert one == result(df.repartition(9, "s")) and one != result(df, key=4)
    sizes = Counter(r[-2] for r in one)
    assert set(sizes.values()) <= {71, 72} and len(sizes) == 7
    assert all(sorted(r[-1] for r in one if r[-2] == s) == list(range(n)) for s, n in sizes.items())
    order = [r[3] for r in sorted(one)]
    assert order != sorted(order) and sorted(order) == list(range(500))


def test_copies_nulls_and_empty_tables(spark):
    rows = [(1, "a")] * 400 + [(None, None)] * 3 + [(2, None)]
    df = spark.createDataFrame(rows, "`row_id` long, `shard key` string")
    got = result(df.repartition(5))
    assert Counter(r[:2] for r in got) == Counter(rows)
    assert sorted(r[3] for r in got) == list(range(404))
    assert got == result(df.repartition(2))
    assert result(df.limit(0)) == []

"""Rules as a table, against the expressions made of the same rules."""

import random

import pytest
from pyspark.sql import functions as F

from fieldtally.functions.rules import RuleSet
from fieldtally.operators import rule_tables as rt

RULES = RuleSet(
    exclude_genera=("Aaa", " bbb ", "ccc", ""),
    exclude_species=("aaa x", "Ddd y ", "eee"),
    include_species=("AAA X", "bbb kept", "eee z"),
    exclude_caption_keywords=("turkey tail", "Turkey", "dup", "dup"),
)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    names = [None, "", " ", "aaa x", " AAA  x", "Aaa q", "bbb kept", "bbb", "Ddd Y", "ddd", "eee", "eee z", "\tccc z", "fff"]
    captions = [None, "", "a TURKEY tail", "the turkey", "dup", "plain"]
    made = [(i, rng.choice(names), rng.choice(captions), "x") for i in range(400)] + [(1000 + i, "Aaa hot", None, "x") for i in range(300)]
    return spark.createDataFrame(made, "i int, first_species string, full_caption string, `rank` string").repartition(3)


@pytest.mark.parametrize("spread", [1, 4])
@pytest.mark.parametrize("caption", ["full_caption", None])
def test_equal_to_the_expressions(spark, rows, spread, caption):
    shown = F.col(caption) if caption else None
    want = rows.select("i", RULES.keep(F.col("first_species"), shown).alias("keep"), RULES.reason(F.col("first_species"), shown).alias("why"))
    got = rt.judge_by_table(rows, RULES.to_frame(spark), caption_col=caption, spread=spread)
    assert got.columns == [*rows.columns, "keep", "exclusion_reason"]
    assert sorted(map(tuple, got.select("i", "keep", "exclusion_reason").collect())) == sorted(map(tuple, want.collect()))


def test_a_million_rules(spark):
    """Name rules by join: the plan holds none of them, and rows with equal names are resolved once."""
    many = spark.range(0, 500_000, 1, 4)
    rules = many.selectExpr("'exclude_species' AS kind", "concat('genus', id % 1000, ' Species', id) AS value").union(
        many.selectExpr("'include_species'", "concat('Genus', id % 1000, ' species', id * 10)")
    )
    rules = rules.union(spark.createDataFrame([("exclude_genera", "GENUS7"), ("other", "x"), ("exclude_species", None)], "kind string, value string"))
    df = spark.range(0, 20_000, 1, 4).selectExpr("id", "concat('genus', id % 1000, ' species', id) AS first_species", "'c' AS full_caption")
    got = rt.judge_by_table(df, rules, spread=3)
    kept = {r.id for r in got.where("keep").collect()}
    # the tenth id's include rule has the genus of a tenth of it
    want = {i for i in range(20_000) if i % 10 == 0 and (i // 10) % 1000 == i % 1000}
    assert kept == want
    reasons = {r.exclusion_reason.split(":")[0]: r.n for r in got.where("NOT keep").groupBy("exclusion_reason").agg(F.count("*").alias("n")).limit(5).collect()}
    assert set(reasons) == {"species in exclude list"}


def test_no_rules_and_too_many_keywords(spark, rows, monkeypatch):
    assert rt.judge_by_table(rows, RuleSet.empty().to_frame(spark)).where("keep").count() == rows.count()
    monkeypatch.setattr(rt, "MAX_KEYWORDS", 2)
    with pytest.raises(ValueError, match="keywords"):
        rt.judge_by_table(rows, RULES.to_frame(spark))

from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldtally.functions.rules import RuleSet
from fieldtally.operators import taxonomy as t

ROWS = [
    ("Rosa canina", "hedge, in FLOWER"), ("Acer campestre", "by the mill"), ("Fagus sylvatica", "old beech"),
    ("Acer rubrum", "planted; in flower"), ("Quercus ilex", None), ("Tilia cordata", "lime avenue"),
]


DAY = date(2018, 1, 1)


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(date(2018, 1, 1) + timedelta(i), s, c) for i, (s, c) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "date date, species string, caption string")


def kept(df):
    return [r.species for r in df.orderBy("date").collect()]


ALL = [s for s, _ in ROWS]


@pytest.mark.parametrize(
    "rules, dropped",
    [
        ({}, ""),
        ({"exclude_genera": ["acer "]}, "Acer campestre, Acer rubrum"),
        ({"exclude_genera": ["ACER"], "include_species": [" acer Rubrum"]}, "Acer campestre"),
        ({"exclude_species": ["TILIA cordata"]}, "Tilia cordata"),
        ({"exclude_caption_keywords": ["In Flower", "mill"]}, "Rosa canina, Acer campestre, Acer rubrum"),
        ({"exclude_species": ["fagus sylvatica"], "exclude_caption_keywords": ["lime"]}, "Fagus sylvatica, Tilia cordata"),
        ({"exclude_genera": None, "exclude_caption_keywords": ["absent"]}, ""),
    ],
)
def test_rule_sets(sample, rules, dropped):
    gone = set(dropped.split(", "))
    assert kept(t.apply_rules(sample, RuleSet.from_mapping(rules))) == [s for s in ALL if s not in gone]


def test_missing_column(spark, sample):
    df = sample.drop("species")
    assert t.apply_rules(df).columns == ["date", "caption"] and t.apply_rules(df).count() == len(ROWS)
    with pytest.raises(ValueError, match="species"):
        t.filter_by_rules(df, RuleSet.empty(), "species", missing="error")
    assert t.exclusion_stats(df, RuleSet.empty()).count() == 0


def test_default_rules(spark, sample):
    rules = RuleSet.from_yaml()
    assert [len(x) for x in (rules.exclude_groups, rules.exclude_genera, rules.exclude_species, rules.include_species,
                             rules.exclude_caption_keywords)] == [4, 58, 0, 6, 9]
    assert rules.to_frame(spark).count() == 77
    genus, keyword = rules.exclude_genera[0], rules.exclude_caption_keywords[0]
    rows = [(f"{genus} alba", "x"), ("Rosa canina", f"a {keyword.upper()} here"), (rules.include_species[0], keyword), ("Rosa alba", "x")]
    df = spark.createDataFrame([(DAY, *r) for r in rows], "date date, species string, caption string")
    assert {r.species for r in t.apply_rules(df).collect()} == {rules.include_species[0], "Rosa alba"}
    with pytest.raises(FileNotFoundError):
        RuleSet.from_yaml("/no/such/file.yaml")


def test_description_stands_in_for_caption(sample):
    df = sample.withColumnRenamed("caption", "description")
    assert len(kept(t.apply_rules(df, RuleSet(exclude_caption_keywords=("AVENUE",))))) == len(ROWS) - 1


#: rules, name, caption, reason (None: kept)
OUTCOMES = [
    ({"exclude_genera": ("aa",)}, "AA b", None, "genus excluded: Aa"),
    ({"exclude_genera": ("aa",)}, " aa", "x", "genus excluded: Aa"),
    ({"exclude_genera": ("aa",)}, "aab c", "aa", None),
    ({"exclude_genera": ("aa",)}, None, "aa", None),
    ({"exclude_species": ("Aa B",), "exclude_genera": ("aa",)}, "aa b", None, "species in exclude list: aa b"),
    ({"include_species": ("aa b",), "exclude_species": ("aa b",), "exclude_genera": ("aa",)}, "Aa b", None, None),
    ({"include_species": ("aa b",), "exclude_caption_keywords": ("x",)}, "AA B ", "x", None),
    ({"exclude_caption_keywords": ("yz", "X")}, "c", "xyZ", "caption keyword: 'yz'"),
    ({"exclude_caption_keywords": ("q", "X")}, None, "xyz", "caption keyword: 'x'"),
    ({"exclude_caption_keywords": ("q",)}, "c", None, None),
]


def judged(spark, rules, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, c string")
    n, c = F.col("n"), F.col("c")
    return df, [(r[1], r[2]) for r in df.select("i", rules.keep(n, c), rules.reason(n, c)).orderBy("i").collect()]


def test_reasons(spark):
    for rules, name, caption, reason in OUTCOMES:
        assert judged(spark, RuleSet(**rules), [(name, caption)])[1] == [(reason is None, reason)], (rules, name, caption)


def test_long_keyword_lists_are_judged_alike(spark):
    rows = [("a", "w17 here"), ("b", None), ("c", "w1999 and w250"), ("d", "none")]
    long = RuleSet(exclude_caption_keywords=tuple(f"w{i} " for i in range(3000)))
    rows = [(n, c and f"{c} ") for n, c in rows]
    assert [r for _, r in judged(spark, long, rows)[1]] == ["caption keyword: 'w17 '", None, "caption keyword: 'w250 '", None]


NAMES = st.lists(st.sampled_from(["Aa", "bB", " Cc", "\tdd", "e"]), max_size=3).map(" ".join)
CAPTIONS = st.text("xyzXYq ", max_size=4)
LISTS = {
    "exclude_genera": st.lists(st.sampled_from(["AA", "cc", "Dd"]), max_size=3).map(tuple),
    "exclude_species": st.lists(NAMES.filter(bool), max_size=2).map(tuple),
    "exclude_caption_keywords": st.lists(st.sampled_from(["x", "Yz", "q"]), max_size=3).map(tuple),
}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.fixed_dictionaries(LISTS), st.sampled_from(sorted(LISTS)), st.data())
def test_order_of_rules(spark, lists, which, data):
    rows = data.draw(st.lists(st.tuples(st.none() | NAMES, st.none() | CAPTIONS), min_size=20, max_size=20))
    whole = RuleSet(**lists)
    df, got = judged(spark, whole, rows)
    assert all(keep == (reason is None) for keep, reason in got)
    # a rule more never brings a row back
    fewer = judged(spark, RuleSet(**{k: v[:1] if k == which else v for k, v in lists.items()}), rows)[1]
    assert all(few or not all_ for (few, _), (all_, _) in zip(fewer, got))
    # a listed name stays under every other rule
    listed = tuple(n for n, _ in rows if n and n.strip())
    saved = judged(spark, RuleSet(**lists, include_species=listed), rows)[1]
    assert all(s == (True, None) for s, (n, _) in zip(saved, rows) if n in listed)
    audit = t.filter_audit(df, whole.keep(F.col("n"), F.col("c"))).first()
    assert (audit.rows_before, audit.rows_after) == (20, sum(k for k, _ in got))


def test_exclusion_stats_take_the_first_caption(spark):
    rows = [
        (date(2020, 1, 3), "Aa b", "a lichen"), (date(2020, 1, 1), "Aa b", None), (date(2020, 1, 2), "Aa b", "plain"),
        (date(2020, 1, 1), "Cc d", "crust on wood"), (date(2020, 1, 2), "Cc d", "plain"),
        (date(2020, 1, 1), "Fomes x", None), (date(2020, 1, 1), None, "lichen"),
    ]
    df = spark.createDataFrame(rows, "date date, first_species string, full_caption string")
    rules = RuleSet.from_yaml()
    assert {tuple(r) for r in t.exclusion_stats(df, rules).collect()} == {
        ("Cc d", 2, "caption keyword: 'crust on'"), ("Fomes x", 1, "genus excluded: Fomes")}
    assert {tuple(r) for r in t.exclusion_stats_by_row(df, rules).collect()} == {
        ("Aa b", 1, "caption keyword: 'lichen'"), ("Cc d", 1, "caption keyword: 'crust on'"),
        ("Fomes x", 1, "genus excluded: Fomes"), (None, 1, "caption keyword: 'lichen'")}
    assert [r.species for r in t.exclusion_stats(df, rules, caption_col=None).collect()] == ["Fomes x"]
    assert t.exclusion_stats(df, RuleSet.empty()).collect() == []
    assert t.exclusion_report(t.exclusion_stats(df, rules), 1).count() == 1

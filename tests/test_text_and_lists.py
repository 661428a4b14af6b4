"""Text and list expressions against known values."""

from datetime import date

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldtally.functions import dates, lists, text

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
WORDS = st.text(alphabet="aB'\"\\ ,[]{}:éN .x0", max_size=8)


def test_parse_list_forms(column_of):
    expected = {
        "['Rana b', \"it's\"]": ["Rana b", "it's"],
        "['none: None, x', 'y']": ["none: None, x", "y"],
        "['caf\\xe9', 'a\\'b']": ["café", "a'b"],
        "['say \"hi\"', \"don't\"]": ['say "hi"', "don't"],
        "  ['a',]  ": ["a"],
        "['back\\\\slash', 'two\\nlines']": ["back\\slash", "two\nlines"],
        "['True', 'x']": ["True", "x"],
        "['a', None]": ["a", None],
        "[]": [],
    }
    assert column_of(list(expected), lists.parse_list) == list(expected.values())
    for broken in ("", "   ", None, "no list at all", "('a', 'b')", "{'a': 1}", "['a', b]", "['a' 'b'"):
        assert column_of([broken], lists.parse_list) == [[]]


@FEW
@given(st.lists(st.lists(WORDS, max_size=4), min_size=20, max_size=20))
def test_parse_list_property(column_of, many):
    assert column_of([repr(xs) for xs in many], lists.parse_list) == many


def record(name, url=None):
    return {"latin_name": name, "page_url": url}


def test_parse_record_names_forms(column_of):
    expected = [
        (repr([record("Hyla e", "u"), record("Bufo c")]), ["Hyla e", "Bufo c"]),
        (repr([record("", "u"), record(None)]), []),
        (repr([{"page_url": "x: None}"}, record("O'Brien: None}")]), ["O'Brien: None}"]),
        (repr(["plain", "{text}"]), ["plain", "{text}"]),
        (repr([record("a"), "b"]), ["a"]),
        ("[]", []), (None, []), ("broken [", []),
    ]
    assert column_of([text for text, _ in expected], lists.parse_record_names) == [names for _, names in expected]


@FEW
@given(st.lists(st.lists(st.tuples(st.none() | WORDS, st.none() | WORDS), max_size=3), min_size=20, max_size=20))
def test_parse_record_names_property(column_of, many):
    """Names go in, the text of their records is parsed, and the names that are not empty come out."""
    texts = [repr([record(*r) for r in records]) for records in many]
    assert column_of(texts, lists.parse_record_names) == [[n for n, _ in records if n] for records in many]


def test_typed_columns_pass_through(spark):
    df = spark.sql(
        "select array('a', 'b') xs, array(named_struct('latin_name', 'A b', 'page_url', 'u'),"
        " named_struct('latin_name', '', 'page_url', 'u')) refs"
        " union all select null, null"
    )
    rows = df.select(lists.as_list(df, "xs"), lists.as_record_names(df, "refs"), lists.as_record_names(df, "xs")).collect()
    assert [tuple(r) for r in rows] == [(["a", "b"], ["A b"], ["a", "b"]), ([], [], [])]


def test_list_summaries(spark):
    df = spark.sql("select * from values (array('a', null, 'b')), (array()), (null) as t(xs)")
    xs = F.col("xs").cast("array<string>")
    got = df.select(lists.list_to_text(xs), lists.first_item(xs), lists.list_length(xs)).collect()
    assert [tuple(r) for r in got] == [("a;b", "a", 3), ("", "Unidentified", 0), ("", "Unidentified", 0)]


def test_normalize_name(column_of):
    values = [" Rana cf. temporaria ", "Bufo (aff.) sp. ", "A {b}\t[c]", None, "Hyla var.nigra", "Hyla SPP."]
    assert column_of(values, text.normalize_name) == ["Rana temporaria", "Bufo", "A b c", "", "Hyla nigra", "Hyla"]
    # the narrow form takes a qualifier only if a letter follows its full stop
    assert column_of(values, lambda c: text.normalize_name(c, strict_compat=True)) == [
        "Rana cf. temporaria", "Bufo aff. sp.", "A b c", "", "Hyla nigra", "Hyla SPP."]


def test_genus(column_of):
    values = ["Amanita muscaria", "  \tBOLETUS edulis", "", "   ", None]
    assert column_of(values, text.genus) == ["amanita", "boletus", "", "", ""]
    assert column_of(values, text.genus_label) == ["Amanita", "Boletus", "", "", ""]


def test_truncate_label(column_of):
    values = ["x" * 30, "x" * 31, "y" * 45, "y" * 46, None]
    assert column_of(values, text.truncate_label) == ["x" * 30, "x" * 30 + "…", "y" * 30 + "…", "y" * 30 + "…", None]
    assert column_of(values, lambda c: text.truncate_label(c, 45, 40)) == [
        "x" * 30, "x" * 31, "y" * 45, "y" * 40 + "…", None]


def test_weather_metrics(spark):
    df = spark.createDataFrame(
        [("Weather: temperature 25.5° (avg), min. -3°, max. 31°. Wind 2. precipitation 12.0 mm.",), ("dry",), (None,)],
        "s string",
    )
    got = df.select(*text.weather_metrics(F.col("s")).values()).collect()
    assert [tuple(r) for r in got] == [(25.5, -3.0, 31.0, 12.0), (None,) * 4, (None,) * 4]


def test_seasons(spark):
    df = spark.createDataFrame([(date(2020, m, 28),) for m in range(1, 13)], "d date")
    assert [r[0] for r in df.select(dates.season(F.col("d"))).collect()] == (
        ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Fall"] * 3 + ["Winter"]
    )

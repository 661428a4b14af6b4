from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldtally.functions import html, urls

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
BASES = ["https://a.org/x/y.htm", "http://a.org", "https://a.org/", "https://a.org/x/y/?q=1#f"]
REFS = [
    "b.htm", "/b/c.htm", "//c.net/d", "http://z.com/../q", "", "?k=v", "#top", "../b.htm", "../../../b", "./b", ".",
    "..", "../", "b/../c/./d/", "b//c", "/x//y", "mailto:someone", "b.htm?u=/../x#y", "/..", "x/..", "../en/a_b.htm", "/..//", "/../x", "/a/../..//b",
]


def joined(spark, pairs):
    df = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(pairs)], "i int, b string, r string")
    return [r[0] for r in df.select(urls.join_url(F.col("b"), F.col("r")).alias("u"), "i").orderBy("i").select("u").collect()]


def test_join_url_table(spark):
    pairs = [(b, r) for b in BASES for r in REFS]
    got = joined(spark, pairs)
    assert {p: g for p, g in zip(pairs, got)} == {p: urljoin(*p) for p in pairs}


@FEW
@given(st.lists(st.text(alphabet="a./b", max_size=10), min_size=30, max_size=30))
def test_join_url_property(spark, refs):
    pairs = [("https://a.org/x/y/z.htm", r) for r in refs if not r.startswith("//")]
    assert joined(spark, pairs) == [urljoin(*p) for p in pairs]


def test_image_key(spark):
    df = spark.sql("select date'2023-01-05' d, 7 i, 'https://a.org/p/05b.jpg?w=1' u")
    assert df.select(urls.image_key(F.col("d"), F.col("i"), F.col("u"))).first()[0] == "2023-01-05/007_05b.jpg"


@pytest.mark.parametrize(
    "fragment, text",
    [
        ("<p> a <b>b</b>\n c</p>", "a b c"),
        ("x<br>&nbsp;<br/>y &amp; z", "x y & z"),
        ("25&#176; &#x20AC; &deg; &unknown; &#xD800;", "25° € ° &unknown; &#xD800;"),
        ("<i></i>", ""),
        ("a < b", "a < b"),
    ],
)
def test_text_of(column_of, fragment, text):
    assert column_of([fragment], html.text_of) == [text]


def test_visible_drops_comments_and_scripts(column_of):
    page = "a<!-- <a href='x'>x</a> -->b<script>var t='<p>';</script>c<STYLE>p{}</STYLE>d"
    assert column_of([page], html.visible) == ["abcd"]


def test_href_forms(column_of):
    tags = [
        "<a href=\"x y.htm\" class=c>", "<A class='c' HREF='x.htm'>", "<a href=x.htm>", "<a data-href=\"n\" href=\"y\">",
        "<a href=\"a&amp;b\">", "<a name=\"n\">",
    ]
    assert column_of(tags[:5], html.href) == ["x y.htm", "x.htm", "x.htm", "y", "a&b"]
    assert column_of(tags, lambda c: F.size(html.hrefs(c))) == [1, 1, 1, 1, 1, 0]

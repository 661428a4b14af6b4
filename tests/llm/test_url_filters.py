import random

import pytest
from pyspark.sql import functions as F

from fieldtally.llm import url_filters as uf
from fieldtally.llm.graph import components

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def judged(spark, rows, redirects=None):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, verdict string")
    return {r.page_id: r for r in uf.judge(df, RULES, redirects).collect()}


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://A.B.Net/x?y#z", "a.b.net", "/x", "net/", "block"),
        ("http://m.example.net/en/a", "m.example.net", "/en/a", "example.net/en/", "allow"),
        ("http://example.net/fr/", "example.net", "/fr/", "net/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/", "block"),
        ("http://x.org/fr/?q=://b.net/", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("x://É.NET?a", "É.net", "", None, "allow"),
        ("://net/", "net", "/", "net/", "block"),
        ("no host", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    r = judged(spark, [(1, url, None)])[1]
    assert (r.url, r.host, r.path, r.rule, r.verdict) == (url, host, path, rule, verdict)


def link(target):
    return f"<head><LINK rel='canonical' href=\"{target}\"></head>"


def test_aliases(spark):
    rows = [
        (1, "http://a.com/1", link("http://bad.net/z")),  # blocked by its canonical link
        (2, "http://b.com/2?utm_source=f", "<meta http-equiv=refresh content='0; URL=http://a.com/1#top'>"),
        (3, "http://b.com/2", None),  # an alias of 2 without its tracking parameter
        (4, "http://c.com/4", link("/5")),
        (5, "http://c.com/5", link("http://bad.net/5")),
        (6, "http://c.com/6", link("http://x.org/fr/6")),
        (7, "http://x.org/fr/6", link("http://bad.net/6")),  # its own rule allows, and so its aliases
        (8, "http://bad.net/8", link("http://c.com/8")),
        (9, "http://c.com/8?utm_medium=a&p=2", None),
        (10, "http://d.com/10", "<body><a rel=x href='http://bad.net/'>canonical</a>"),
        (11, "http://e.com/11", None),
        (12, "HTTP://A.com/1#here", ""),
        (None, "http://a.com/1", link("http://bad.net/z")),
    ]
    moved = spark.createDataFrame([("http://e.com/11", "http://a.com/1"), (None, "http://q.com/")], "source string, target string")
    got = judged(spark, rows, moved)
    blocked = {k for k, r in got.items() if r.verdict == "block"}
    assert blocked == {1, 2, 3, 4, 5, 8, 11, 12, None}
    assert got[8].decided_by == "rule" and got[1].decided_by == "alias" and got[7].decided_by == "rule" and got[6].decided_by == "default"
    assert judged(spark, rows)[11].verdict == "allow"
    assert judged(spark, []) == {}


def test_repeated_pages_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/", None)] * 3, "page_id long, url string, html string")
    assert [r.verdict for r in uf.judge(df, RULES).collect()] == ["block"] * 3


def roots(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b and a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(1)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    star = [("hub", f"s{i}") for i in range(80)]
    loose = [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(35)]
    pairs = chain + star + loose + [("x", "x"), (None, "y"), ("hub", "s1")]
    got = components(spark.createDataFrame(pairs, "a string, b string")).collect()
    assert {r.node: r.root for r in got} == roots(pairs) and len(got) == len(roots(pairs))
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_targets_are_resolved(spark):
    html = "<link rel=stylesheet href=s.css><link href='../x?a=1&amp;b=2' rel=\"canonical\"><meta http-equiv='Refresh' content=\"5;url='/y'\">"
    df = spark.createDataFrame([("http://h.com/a/b", html)], "u string, h string")
    assert df.select(uf.targets(F.col("u"), F.col("h"))).first()[0] == ["http://h.com/x?a=1&b=2", "http://h.com/y"]


def test_unclosed_tags_take_linear_time(spark):
    import time

    pages = [(i, "http://a.example.org/x", mark + tag * 60_000) for i, (mark, tag) in enumerate([("canonical", "<link "), ("http-equiv", "<meta ")])]
    began = time.perf_counter()
    got = uf.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), [("block", "net", "/")]).collect()
    assert time.perf_counter() - began < 30 and {r.verdict for r in got} == {"allow"}

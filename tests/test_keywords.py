"""Many keywords at once, against one search for each."""

import random
import time

import pytest
from pyspark.sql import functions as F

from fieldtally.functions.keywords import any_listed, first_listed
from fieldtally.functions.rules import LONG_LIST, RuleSet


def plain(text, keywords):
    return None if text is None else next((i for i, k in enumerate(keywords, 1) if k in text), 0)


@pytest.mark.parametrize("alphabet, longest", [("ab", 4), ("abc .()[]*+?|^$\\{}-&#", 3), ("aéß日🙂\n\t", 3)])
def test_as_one_by_one(spark, alphabet, longest):
    rng = random.Random(len(alphabet))
    word = lambda n: "".join(rng.choices(alphabet, k=n))
    for keywords in (tuple(word(rng.randrange(1, longest + 1)) for _ in range(30)), (word(longest), ""), ("",), (), (word(3) * 400, word(2))):
        texts = [None, "", *[word(rng.randrange(0, 12)) for _ in range(150)], *[word(2) + k + word(1) for k in keywords]]
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        rows = df.select("t", first_listed(F.col("t"), keywords).alias("first"), any_listed(F.col("t"), keywords).alias("any")).collect()
        for r in rows:
            want = plain(r.t, keywords)
            assert (r.first, bool(r["any"])) == (want or 0, bool(want)), (r.t, keywords)


def test_rules_with_long_lists_equal_short_ones(spark):
    """The first of the list decides, not the first of the text, also where one keyword begins with another."""
    keywords = tuple(f"word{i} x" for i in range(3 * LONG_LIST)) + ("word1", "turkey tail", "turkey")
    captions = ["A Word7 X and word2 x", "word1", "TURKEY", "a turkey tail", "word", None, "word11 x word1"]
    df = spark.createDataFrame([("Some name", c) for c in captions], "n string, c string")
    rows = df.select(RuleSet(exclude_caption_keywords=keywords).reason(F.col("n"), F.col("c")).alias("why"),
                     RuleSet(exclude_caption_keywords=keywords).keep(F.col("n"), F.col("c")).alias("keep")).collect()
    want = ["word2 x", "word1", "turkey", "turkey tail", None, None, "word11 x"]
    assert [r.why for r in rows] == [w and f"caption keyword: '{w}'" for w in want]
    assert [r["keep"] for r in rows] == [w is None for w in want]


def test_cost_does_not_grow_with_the_list(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    many = tuple(word() for _ in range(5000))
    df = spark.range(0, 40000, 1, 4).select(F.concat_ws(" ", *[F.md5((F.col("id") * k).cast("string")) for k in range(1, 7)]).alias("t")).cache()
    df.count()

    def seconds(keywords):
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            df.where(any_listed(F.col("t"), keywords)).count()
            best = min(best, time.perf_counter() - began)
        return best

    few = seconds(many[:50])
    assert seconds(many) < 4 * few + 0.5

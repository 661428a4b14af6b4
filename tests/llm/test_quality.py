import random
import re
from collections import Counter

import numpy as np
import pytest

from fieldtally.llm import quality
from fieldtally.llm.common import table

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(grams)
    again = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 20 or 100 * len(again) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


TEXTS = [None, "", " \n\x0b\f", "a b", "a b c d e f g h " * 3, "é\u00a0ß\x1c# |<>\n\n x\n x\nx", "w " * 20000, "one two\n" * 30,
         " ".join(map(str, range(200)))]


def test_counts(documents_of):
    rng = random.Random(2)
    rows = [*enumerate(TEXTS), (3, "a b"), (None, "a b")]
    rows += [(50 + i, "".join(rng.choices("ab \n#", k=rng.randrange(300)))) for i in range(60)]
    got = quality.judge(documents_of(rows), quality.KEEP_ALL).collect()
    wanted = [(d, *counts(t), not counts(t)[-1]) for d, t in rows]
    assert sorted(((*r[:7], r.kept) for r in map(lambda r: r, got)), key=repr) == sorted(wanted, key=repr)


def test_held_out_accuracy(spark):
    """Fitted on a fifth of the labelled rows, judged on the rest."""
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.train(documents, labels, rows=160)
    rows = quality.judge(documents, model).join(labels, "doc_id").orderBy(quality.F.xxhash64("doc_id"), "doc_id").collect()[160:]
    good = [r.probability >= quality.MIN_PROBABILITY for r in rows if r.quality == 1]
    bad = [r.probability < quality.MIN_PROBABILITY for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) > 0.6
    kept = [r.kept for r in rows if r.quality == 0]
    assert np.mean(kept) < 0.15


def test_probabilities_are_calibrated(spark):
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.train(documents, labels)
    rows = quality.judge(documents, model).join(labels, "doc_id").collect()
    assert abs(np.mean([r.probability for r in rows]) - np.mean([r.quality for r in rows])) < 0.08


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (None, 0)], [(1, 0), (99, 1)]])
def test_without_two_classes_all_is_kept(spark, documents_of, labels):
    df = documents_of([(1, " ".join(f"w{i}" for i in range(40))), (2, None)])
    model = quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert [(r.doc_id, r.kept) for r in quality.judge(df, model).sort("doc_id").collect()] == [(1, True), (2, False)]


def test_keep_gives_whole_rows(documents_of):
    df = documents_of([(1, " ".join(f"w{i}" for i in range(40))), (2, None), (3, "x " * 50)])
    out = quality.judge(df, quality.KEEP_ALL, keep=True)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [1]
    assert quality.judge(documents_of([]), quality.KEEP_ALL).count() == 0


def test_one_row_for_each_label_is_fitted_on(documents_of, spark, monkeypatch):
    """However many rows hold a labelled doc_id."""
    rows = [(i % 2, f"text {i} of a repeated id") for i in range(300)] + [(2, "clean text"), (3, None)]
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    seen = []
    whole = quality.shares
    monkeypatch.setattr(quality, "shares", lambda df: seen.append(df.count()) or whole(df))
    quality.train(documents_of(rows), labels)
    assert seen == [5]


def test_characters_of_any_script_are_one_each():
    assert len(quality.char_features("дом")) == 1 == len(quality.char_features("日本語")) and len(quality.char_features("🙂🙂")) == 0
    assert len(set(quality.char_features("abcabd").tolist())) == 4

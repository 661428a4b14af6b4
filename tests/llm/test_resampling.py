import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fieldtally.llm import resampling as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = words + [" ".join(words[i : i + 2]) for i in range(len(words) - 1)]
    return len(words), [zlib.crc32(g.encode()) % 10000 for g in grams]


def brute(rows, target, percent=25):
    found = [(d, *features(t)) for d, t in rows]
    source, wanted = (Counter(b for f in fs for b in f) for fs in ([f for _, _, f in found], [features(t)[1] for t in target]))
    S, T = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (S + 10000) / ((source[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for d, words, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    eligible = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    place = {}
    for i, r in enumerate(eligible, 1):
        place.setdefault(r, []).append(i if i <= percent * len(eligible) // 100 else None)
    return sorted(((r[0], *r[2:], place[r].pop() if r in place else None) for r in out), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    words = [*"abcdefgh", "straße", "Über", "日本", "x-y", "don\u2019t", "q" * 63, "r" * 64, "s" * 200, "007", "\x7f", "E\u0301"]
    out = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 80)))) for i in range(150)]
    out += [(1000 + i, "one text of more than twenty words " * 4) for i in range(60)]
    out += [(2000, None), (2001, ""), (2002, " \t.,"), (2003, "one"), (2004, "\u0000a" * 30), (2005, " ".join(rng.choices(words, k=20000)))]
    return out + [out[3]] * 30 + [(None, "no id " * 15)] * 5 + [(7, "another text of a repeated id " * 5)]


TARGET = ["a b c d e f straße", None, "", "Über 日本 g", "a b c d e f straße"]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(list(enumerate(TARGET)), "item_id long, text string")


def test_as_by_brute_force(documents_of, rows, target, monkeypatch):
    monkeypatch.setattr(rs, "CHUNK", 7)
    got = rs.resampled(documents_of(rows, "key").repartition(3), target).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, TARGET)


def test_drawn_rows_keep_all_columns(documents_of, rows, target):
    df = documents_of(rows, "rank")
    got = rs.drawn(df, target, 40)
    assert got.columns == df.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in brute(rows, TARGET, 40) if r[-1])


def test_crc_of_substrings_from_prefixes():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 256, 3_000_000, dtype=np.uint8).tobytes()
    for start, stop in [(0, 0), (0, 1), (5, 68), (5, 69), (5, 70), (100, 100), (77, 2_999_999), (1, 3_000_000)]:
        before, after = (np.array([zlib.crc32(text[:x])], np.uint32) for x in (start, stop))
        assert (after ^ rs.shifted(before, np.array([stop - start])))[0] == zlib.crc32(text[start:stop])


def test_draws_follow_the_target(documents_of, spark):
    """Documents of the target's kind are drawn far more often than in proportion."""
    rng = random.Random(3)
    kinds = ["apple pear plum fig date lime".split(), "iron zinc gold lead tin cobalt".split()]
    rows = [(i, " ".join(rng.choices(kinds[i % 10 == 0], k=30))) for i in range(1000)]
    metal = spark.createDataFrame([(i, " ".join(rng.choices(kinds[1], k=30))) for i in range(50)], "item_id long, text string")
    drawn = [r.doc_id for r in rs.drawn(documents_of(rows), metal, 10).collect()]
    assert len(drawn) == 100 and sum(d % 10 == 0 for d in drawn) > 60


def test_empty_tables(documents_of, spark, target):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert rs.resampled(documents_of([]), target).count() == 0 and rs.drawn(documents_of([]), empty).count() == 0
    rows = [(1, "a " * 25), (2, None), (3, "b " * 25), (4, "c " * 25), (5, "d " * 25)]
    assert sorted(map(tuple, rs.resampled(documents_of(rows), empty).select(*COLUMNS).collect()), key=repr) == brute(rows, [])

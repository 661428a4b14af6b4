import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from fieldtally.llm import simhash as sh


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in combinations(parent, 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(a)] = find(b)
    return {f: find(f) for f in parent}


def brute(rows):
    rows = [(d, plain_fingerprint(t)) for d, t in rows]
    root = brute_components({f for _, f in rows})
    least = {}
    for d, f in rows:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    return sorted(((d, f"{f:016x}", least.get(root[f])) for d, f in rows), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(n))

    def near(t, edits):
        w = t.split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = text(1)
        return " ".join(w)

    base, hot = text(900), text(60)
    out = [(i, text(rng.randrange(1, 90))) for i in range(150)]
    out += [(1000 + i, near(base, rng.randrange(1, 3))) for i in range(120)]  # near copies, linked in part
    out += [(2000 + i, hot.upper() if i % 2 else hot) for i in range(80)]
    out += [(3000, None), (3001, ""), (3002, " \t\r\n"), (3003, "one"), (3004, "ONE"), (3005, "one two"), (3006, "É ÀB straße"), (3007, text(40000))]
    return out + [(5, text(20)), (None, hot), (None, text(30)), (7, out[7][1])]


def test_as_by_brute_force(documents_of, rows):
    got = sh.near_duplicates(documents_of(rows, "fp").repartition(4))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("most", [sh.MOST, 5])
def test_links_of_crowded_fingerprints(spark, monkeypatch, most):
    """Clusters round a few centres, whole partitions in common, and independent values; with and without the way out by all bits."""
    monkeypatch.setattr(sh, "MOST", most)
    rng = np.random.default_rng(8)
    some = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    centres = some(3)
    flips = lambda n, k: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, k)).astype(np.uint64), axis=1)
    crowd = np.concatenate([c ^ flips(150, k) for c in centres for k in (1, 2, 4)])
    half = (some(300) & np.uint64(0xFFFFFFFF)) | (centres[0] & np.uint64(0xFFFFFFFF00000000))
    values = np.unique(np.concatenate([crowd, half, half[:50] ^ flips(50, 2), some(400), np.array([0, 1, 3, 2**64 - 1], np.uint64)]))
    fps = sh.stored(spark.createDataFrame([(v,) for v in values.view(np.int64).tolist()], "fp long").repartition(3), "fps")
    got = {tuple(r) for r in sh.links(fps).collect()}
    far = np.bitwise_count(values[:, None] ^ values[None, :])
    signed = values.view(np.int64)
    want = {(max(a, b), min(a, b)) for a, b in ((int(signed[i]), int(signed[j])) for i, j in zip(*np.nonzero((far <= 2) & (far > 0))))}
    assert len(want) > 1000 and got == want


def test_thresholds_add_up_and_follow_the_counts(spark):
    """Partitions that many share get lower thresholds than those that few share."""
    rng = np.random.default_rng(9)
    values = rng.integers(0, 2**64, 30000, dtype=np.uint64)
    values[:20000] &= np.uint64((1 << 64) - (1 << 22))  # the lowest 22 bits hardly vary
    fps = sh.stored(spark.createDataFrame([(v,) for v in np.unique(values).view(np.int64).tolist()], "fp long"), "fps")
    parts = sh.partitions(fps, fps.count())
    assert [sorted(sum((parts.bits[p] for p in g), [])) for g in sh.groupings()] == [list(range(64))] * 3
    low = [p for p in sh.groupings()[0] if sum(b < 22 for b in parts.bits[p]) > 15]
    assert low  # correlated bits lie together
    bits = sh.bits_of(values[:1000])
    cost, chosen = parts.thresholds(sh.groupings()[0], bits)
    assert (chosen.sum(axis=1) == sh.RADIUS + 1 - 3).all() and (cost > 0).all()
    assert (chosen[:, low[0]] == -1).mean() > 0.9
    exact = (sh.bits_of(values) != bits[0]).astype(int)
    part = next(p for p in sh.groupings()[0] if p not in low)
    near = int((exact[:, parts.bits[part]].sum(axis=1) <= 2).sum())
    assert 0.2 * near <= parts.candidates(part, bits[:1])[0, 2] <= 5 * near + 5


def test_empty_table(documents_of):
    assert sh.near_duplicates(documents_of([])).count() == 0
    assert [tuple(r) for r in sh.near_duplicates(documents_of([(1, None)])).collect()] == [(1, "0" * 16, 1)]

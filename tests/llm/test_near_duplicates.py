import random
from itertools import combinations

import pytest

from fieldtally.llm import near_duplicates as nd


def grams(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """class_id, n_copies, n_links and group_id by set, from all pairs of sets."""
    sets = {}
    for d, t in rows:
        sets.setdefault(grams(t), []).append(d)
    names = {s: min((d for d in ds if d is not None), default=None) for s, ds in sets.items()}
    links = {s: 0 for s in sets}
    parent = {s: s for s in sets}

    def find(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for a, b in combinations([s for s in sets if s], 2):
        if len(a & b) >= 0.8 * len(a | b):
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    groups = {}
    for s in sets:
        groups.setdefault(find(s), []).append(names[s])
    group = {s: min((n for n in groups[find(s)] if n is not None), default=None) for s in sets}
    return sorted(((d, names[grams(t)], len(sets[grams(t)]), links[grams(t)], group[grams(t)]) for d, t in rows), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))

    def near(t, edits):
        w = t.split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = text(1)
        return " ".join(w)

    hot, big = text(150), text(200)
    out = [(i, text(rng.randrange(1, 120))) for i in range(120)]
    out += [(1000 + i, hot) for i in range(80)]  # exact copies
    out += [(2000 + i, near(big, rng.randrange(1, 5))) for i in range(60)]  # near copies, linked in part
    out += [(3000 + i, near(out[i % 120][1], 1)) for i in range(50)]
    out += [(3500, hot.replace(" ", "\n ")), (4000, None), (4001, ""), (4002, " \t"), (4003, "one two"), (4004, "one  two"), (4005, text(6000))]
    return out + [(0, out[0][1]), (None, hot), (None, text(40)), (5, text(30))]


@pytest.mark.parametrize("tile", [500, 16])
def test_as_by_brute_force(documents_of, rows, monkeypatch, tile):
    monkeypatch.setattr(nd, "TILE", tile)
    got = nd.joined(documents_of(rows, "key").repartition(4)).select("doc_id", "class_id", "n_copies", "n_links", "group_id")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_one_of_each(documents_of, rows):
    rows = rows[:-1]  # without two different texts of one doc_id
    df = documents_of(rows, "key")
    out = nd.one_of_each(df)
    assert out.columns == df.columns
    kept = [r.doc_id for r in out.collect()]
    assert sorted(kept, key=repr) == sorted({r[4] for r in brute(rows)}, key=repr)


def test_empty_table(documents_of):
    assert nd.joined(documents_of([])).count() == 0 and nd.one_of_each(documents_of([])).count() == 0
    assert [tuple(r) for r in nd.joined(documents_of([(1, None)])).collect()] == [(1, 1, 1, 0, 1)]


def test_bands_reach_their_recall():
    import numpy as np

    rng = np.random.default_rng(3)
    found = 0
    for _ in range(300):
        both = rng.integers(0, 2**63, 80).astype(np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, 10).astype(np.uint64)]) for _ in range(2))  # similarity 0.8
        found += bool(np.any(nd.band_hashes(a) == nd.band_hashes(b)))
    assert found >= 0.97 * 300


def test_a_group_holds_two_tiles_at_most(documents_of, monkeypatch):
    import pyarrow as pa

    def sizes(group):
        return pa.table({"same": ["x"], "n_links": pa.array([group.num_rows], pa.int64()), "forest": [str(len(set(group.column("tile").to_pylist())))]})

    monkeypatch.setattr(nd, "TILE", 16)
    monkeypatch.setattr(nd, "verified", sizes)
    words = [f"w{i}" for i in range(200)]
    df = documents_of([(i, " ".join([*words, f"end{i}"])) for i in range(320)])
    found = nd.links_of(df, nd.stored(nd.signatures(df), "signatures")).collect()
    assert sum(r.n_links for r in found) == 320 * 20 and len(found) == 20 * 21 // 2
    assert max(r.n_links for r in found) < 80 and {r.forest for r in found} == {"1", "2"}

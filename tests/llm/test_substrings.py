import hashlib
import random

import pytest

from fieldtally.llm import substrings as ss

N = ss.LENGTH


def brute(rows):
    words = [(float("inf") if d is None else d, d, [w for w in (t or "").encode().split()]) for d, t in rows]
    first = {}
    for key, _, w in words:
        for i in range(len(w) - N + 1):
            g = tuple(w[i : i + N])
            first[g] = min(first.get(g, key), key)
    out = []
    for key, d, w in words:
        gone = set()
        for i in range(len(w) - N + 1):
            if first[tuple(w[i : i + N])] < key:
                gone.update(range(i, i + N))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in ss.deduplicated(df).collect()), key=repr)


@pytest.mark.parametrize("seed, letters", [(1, "ab"), (2, "abcdefghij"), (3, "abcdefghijklmnopqrstuvwxyz")])
def test_as_by_brute_force(documents_of, seed, letters):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(letters) + rng.choice("xyz") for _ in range(n))
    shared = [text(n) for n in (12, 13, 14, 30, 90)]
    rows = []
    for i in range(120):
        parts = [text(rng.randrange(0, 25)), rng.choice(shared), text(rng.randrange(0, 9)), rng.choice(shared)[: rng.randrange(5, 200)]]
        rows.append((rng.randrange(90), " ".join(parts)))
    rows += [(1000 + i, shared[4]) for i in range(60)]  # copies: a third of all rows
    rows += [(2000 + i, f"{shared[3]} {i} {shared[4]}") for i in range(40)]
    rows += [(7, None), (7, ""), (8, " \n\t"), (3, shared[4]), (3, shared[4]), (-4, "a\x0bb\x1cc\u00a0d " * 20), (None, shared[4]), (None, shared[4])]
    rows += [(5000, f"{text(4000)} {shared[4]}")]
    rng.shuffle(rows)
    assert got(documents_of(rows, "n_words").repartition(5)) == brute(rows)


def test_empty_table(documents_of):
    assert got(documents_of([])) == []
    assert got(documents_of([(1, None)])) == brute([(1, None)])


def test_anchors_depend_on_their_window_alone():
    import numpy as np

    rng = np.random.default_rng(0)
    words = rng.integers(0, 5, 400).astype(np.uint64)
    grams = ss.gram_hashes(words, ss.SEED)
    width = N - ss.SEED + 1
    place = ss.anchors(grams, width)
    for i in range(len(place)):
        window = grams[i : i + width]
        assert place[i] - i == width - 1 - int(np.argmin(window[::-1]))


def test_rows_without_doc_id_get_their_own_contexts(documents_of, monkeypatch):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    passages = [text(20) for _ in range(60)]
    rows = [(i, p) for i, p in enumerate(passages)] + [(None, f"{text(5)} {p} {text(5)}") for p in passages * 2] + [(None, passages[0])] * 9
    sizes, extended = [], ss.extended

    def spy(documents, lists, *rest):
        sizes.extend(sum(len(x or []) for x in r) for r in lists.select("marks", "asks", "tells").collect())
        return extended(documents, lists, *rest)

    monkeypatch.setattr(ss, "extended", spy)
    assert got(documents_of(rows).repartition(5)) == brute(rows)
    assert 0 < max(sizes) < 40


def test_settled_rows_without_doc_id_are_spread(documents_of):
    """Copies without doc_id in many batches do not meet in one bucket."""
    rng = random.Random(10)
    passage = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))
    rows = [(i, passage) for i in range(300)] + [(None, passage)] * 4000
    dealt = ss.dealt(documents_of(rows).repartition(16), 64)
    sizes = [r.n for r in dealt.filter("bucket < 0").groupBy("bucket").agg(ss.F.sum(ss.F.size("contexts")).alias("n")).collect()]
    assert len(sizes) > 6 and max(sizes) < 0.4 * sum(sizes)

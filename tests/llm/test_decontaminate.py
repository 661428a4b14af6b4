import random

import pytest

from fieldtally.llm import decontaminate as dc

rng = random.Random(4)
COMMON = "the of and to in is that it".split()


def prose(n, seed):
    own = random.Random(seed)
    return " ".join(own.choice(COMMON) if own.random() < 0.4 else "".join(own.choices("abcdefgh", k=6)) for _ in range(n))


def edited(text, every):
    return " ".join("changed" if i % every == every - 1 else w for i, w in enumerate(text.split()))


ITEMS = [(i, prose(40, i)) for i in range(12)] + [(90, "too short"), (91, None), (92, "the of and to in is that it the of")]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, score string")


@pytest.fixture(scope="module")
def corpus():
    clean = [(100 + i, prose(120, 1000 + i)) for i in range(80)]
    hit = [(1, ITEMS[0][1]), (2, f"{prose(50, 907)} {ITEMS[1][1].upper()} {prose(30, 908)}"), (3, f"{prose(20, 909)}\n{edited(ITEMS[2][1], 6)}")]
    hit += [(4, f"{ITEMS[3][1]} {prose(10, 903)} {ITEMS[4][1]}"), (5, ITEMS[5][1].replace(" ", ", "))]
    hit += [(200 + i, f"{prose(9, 950 + i)} {ITEMS[6][1]}") for i in range(60)]  # a passage in a third of all documents
    odd = [(300, None), (301, ""), (302, "the of and"), (303, " ".join(ITEMS[7][1].split()[:8])), (1, ITEMS[0][1])]
    return clean, hit, odd


def test_matches(documents_of, benchmark, corpus):
    clean, hit, odd = corpus
    got = dc.matches(documents_of(clean + hit + odd, "score"), benchmark).collect()
    pairs = sorted((r.doc_id, r.item_id) for r in got)
    wanted = [(1, 0), (1, 0), (2, 1), (3, 2), (4, 3), (4, 4), (5, 5), *[(200 + i, 6) for i in range(60)]]
    assert pairs == sorted(wanted)
    scores = {(r.doc_id, r.item_id): r.score for r in got}
    assert scores[1, 0] == scores[2, 1] == scores[5, 5] == 1.0 and 0.5 < scores[3, 2] < 0.95
    where = {(r.doc_id, r.item_id): (r.first_word, r.end_word) for r in got}
    assert where[1, 0] == (0, 40) and where[2, 1] == (50, 90) and where[4, 4] == (50, 90)


def test_clean_keeps_the_rest(documents_of, benchmark, corpus):
    clean, hit, odd = corpus
    df = documents_of(clean + hit + odd, "score")
    out = dc.clean(df, benchmark)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, _ in clean + odd if d != 1)


def test_blocks_of_items_give_the_same(documents_of, benchmark, corpus, monkeypatch):
    clean, hit, _ = corpus
    df = documents_of(clean + hit)
    whole = sorted(map(tuple, dc.matches(df, benchmark).collect()))
    monkeypatch.setattr(dc, "BLOCK_SEEDS", 100)
    assert len(dc.blocks(df, benchmark)) > 3
    assert sorted(map(tuple, dc.matches(df, benchmark).collect())) == whole


def test_empty_tables(documents_of, benchmark):
    assert dc.matches(documents_of([]), benchmark).count() == 0
    assert dc.matches(documents_of([(1, "a b c")]), benchmark.limit(0)).count() == 0
    assert dc.clean(documents_of([(1, "a b c")]), benchmark.limit(0)).count() == 1


def plain_alignment(a, b, penalty):
    best, h = 0.0, [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -penalty), h[i - 1][j] - penalty, h[i][j - 1] - penalty)
            best = max(best, h[i][j])
    return best


def test_alignment_is_smith_waterman():
    import numpy as np

    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        score, _ = dc.align(np.array(a), np.array(b))
        assert abs(score - plain_alignment(a, b, dc.PENALTY)) < 1e-9


def test_seeds_do_not_thin_out_with_the_corpus():
    words = [f"w{i}" for i in range(40)]
    counts = {w: 1 if i in (20, 21, 22) else 4_000_000 for i, w in enumerate(words)}
    for total in (4_000_000, 4_000_000_000, 4_000_000_000_000):
        items = dc.Items([(1, words)], counts, total)
        assert set(range(5)) <= {p // 8 for p in items.place.tolist()} and len(items.place) >= 10
        changed = [f"x{w}" if w in ("w20", "w21", "w22") else w for w in words]
        assert [r[0] for r in dc.find(items, " ".join(changed))] == [1]


def found_in(item, text):
    words = dc.words_of(item.lower())
    return [r[:2] for r in dc.find(dc.Items([(1, words)], dict.fromkeys(words, 5), 10_000), text)]


def test_short_items_match_whole():
    short = "What is the capital of Peru?"
    assert found_in(short, f"{prose(30, 1)} what is the capital of PERU {prose(30, 2)}") == [(1, 1.0)]
    assert found_in(short, "what is the capital of Chile, not of Peru") == []
    assert found_in("too short", "Too short!") == [(1, 1.0)] and found_in("too short", "it is too short a text") == []


def test_scripts_without_spaces():
    chinese, thai = "请问秘鲁的首都是哪一座城市它位于哪里", "เมืองหลวงของประเทศเปรูคือเมืองอะไร"
    for item in (chinese, thai, chinese[:6]):
        assert found_in(item, f"前文很长{item}后面还有别的内容 and more") == [(1, 1.0)]
        assert found_in(item, "今天天气很好我们一起去公园散步吧 and more") == []


def test_parts_of_long_items():
    words = prose(59, 77).split()
    assert len(found_in(" ".join(words), f"{prose(30, 1)} {' '.join(words[20:45])} {prose(30, 2)}")) == 1
    cut = [w if i % 20 not in (3, 4, 8, 12, 13, 17, 18) else f"new{i}" for i, w in enumerate(words)]  # 35 %
    assert len(found_in(" ".join(words), f"{prose(30, 1)} {' '.join(cut)} {prose(30, 2)}")) == 1
    assert found_in(" ".join(words), f"{prose(30, 1)} {' '.join(words[20:32])} {prose(30, 2)}") == []

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from fieldtally.llm import alignment as al

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def paths(tokenizers):
    return tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["tokenizer", "straße", "the", "of", "日本語", "naïve", "don't", "12345", "zygote", "🙂", "\t", "\n\n", "  ", "Ελλάδα", "<0x41>", "x" * 40]
    out = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(60)]
    out += [(100 + i, "one hot text of which there are many copies") for i in range(40)]
    out += [(200, None), (201, ""), (202, " "), (203, "a ▁ b"), (204, "<s> </s> <unk> <|endoftext|>"), (205, "\u0000"), (206, "z" * 3000)]
    return out + [(300, " ".join(rng.choices(words, k=600))), (7, "other text of a repeated id"), (7, "other text of a repeated id"), (None, "no id"), (None, "no id")]


def brute(rows, paths):
    """The whole report from every pair of tokens, with the bytes as both libraries tell them."""
    import sentencepiece

    a_tok, b_tok = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a_tok.encode_special_tokens = True
    unit = {c: b for b, c in enumerate(al.byte_alphabet())}

    def spans(tokens):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    docs = []
    for d, text in rows:
        a, b = a_tok.encode(" " + (text or ""), add_special_tokens=False), b_tok.encode(text or "")
        a_tokens = [bytes(unit[c] for c in t) for t in a.tokens]
        pieces = [b_tok.id_to_piece(i) for i in b]
        b_tokens = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in zip(b, pieces)]
        if not text or b"".join(a_tokens) != (raw := b" " + text.encode()) or b"".join(b_tokens) != raw:
            docs.append((d, [], [], [], []))
            continue
        x, y = spans(a_tokens), spans(b_tokens)
        links, first = [], 0
        for i, (s, e) in enumerate(x):
            while y[first][1] <= s:
                first += 1
            j = first
            while j < len(y) and y[j][0] < e:
                links.append((a.ids[i], b[j]))
                j += 1
        cuts = sorted({e for _, e in x} & {e for _, e in y})
        groups = []
        for s, e in zip([0, *cuts], cuts):
            groups.append([[i for i, (_, q) in zip(ids, where) if s < q <= e] for ids, where in ((a.ids, x), (b, y))])
        docs.append((d, a.ids, b, links, groups))
    held = Counter(pair for doc in docs for pair in set(doc[3]))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for d, a, b, links, groups in docs:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        tops = sum(held[x] == best[x[0]] for x in links)
        out.append((d, len(a), len(b), len(groups), len(links), tops, sum(held[x] for x in links), digest))
    return out


@pytest.mark.parametrize("pack_rows", [512, 7])
def test_report_as_by_brute_force(documents_of, rows, paths, monkeypatch, pack_rows):
    monkeypatch.setattr(al, "PACK_ROWS", pack_rows)
    got = al.report(documents_of(rows, "codes").repartition(3), *paths).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, paths), key=repr)


def test_groups_join_to_the_same_bytes(documents_of, rows, paths):
    own = al.Vocabularies(*paths)
    for r in al.aligned(documents_of(rows).repartition(2), *paths).collect():
        assert len(r.a_cuts) == len(r.b_cuts) and (not r.a_cuts or (r.a_cuts[-1], r.b_cuts[-1]) == (len(r.a_ids), len(r.b_ids)))
        for i in range(len(r.a_cuts)):
            a = r.a_ids[r.a_cuts[i - 1] if i else 0 : r.a_cuts[i]]
            b = r.b_ids[r.b_cuts[i - 1] if i else 0 : r.b_cuts[i]]
            assert a and b and b"".join(own.a_bytes[k] for k in a) == b"".join(own.b_bytes[k] for k in b)


def test_parts_get_the_ids_of_the_whole_text(paths):
    """Of texts cut at spaces, of those that can't be, and beyond what is remembered."""
    rng = random.Random(5)
    own = al.Vocabularies(*paths)
    marks = [" ", " ", " ", " ", "  ", "\n", " \n", "\n ", "\t", "\u00a0", "\u3000", "\x1c", "\r\n", ""]
    words = ["word", "don't", "I'll", "'s", "3rd", "12.5%", "日本", "é", "_x_", "--", "🙂", "<|endoftext|>", "<s>", "\u200b", "zyxwv", "▁"]
    texts = ["".join(rng.choice(words[:-1]) + rng.choice(marks) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    texts += [" lead", "trail ", " ", "  ", "\n", "a ▁ b", "new words " + " ".join(f"w{i}é" for i in range(5000))]
    want = [own.library([t])[0] for t in texts]
    assert own.encode(texts) == want and len(own.known[0]) == len(own.known[1]) > 5000
    own.older, own.known = own.known, ({}, {})
    assert own.encode(texts[:50] + [""]) == [*want[:50], (b"", b"")]


def test_galloping_finds_what_a_binary_search_finds():
    rng = np.random.default_rng(2)
    for size in (1, 5, 64, 65, 4000):
        long = np.unique(rng.integers(0, 20000, 3 * size + 5))
        short = np.unique(np.append(rng.choice(long, size // 2), rng.integers(0, long[-1], size)))
        short = np.append(short[short < long[-1]], long[-1])
        assert (al.places(short, long) == np.searchsorted(long, short)).all()


def test_empty_table(documents_of, paths):
    empty = al.report(documents_of([]), *paths)
    assert empty.columns == list(COLUMNS) and empty.count() == 0
    assert [tuple(r) for r in al.report(documents_of([(1, None)]), *paths).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]

import base64
import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldtally.llm import bpe

TEXTS = [None, "", " ", "a", "the the  the\n\n\tthe", "don't I'LL 12345 ½ ß é́ 日本語 🙂🙂", "x" * 3000, "ab " * 2000, " \n \n", "\x00\x1c\x85 z"]


@pytest.fixture(scope="module")
def codec(tokenizers):
    tokens = bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.Codec(tokens, bpe.PerfectHash(tokens), tokenizers.PATTERN, limit=50)


@pytest.fixture(scope="module")
def known(tokenizers):
    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(codec):
    hashed = codec.hashed
    assert sorted(hashed.slots) == list(range(len(codec.tokens)))
    assert [hashed.find(t) for t in codec.tokens] == list(range(len(codec.tokens)))
    assert hashed.find(b"no such token at all") == -1
    assert bpe.PerfectHash([]).find(b"a") == -1 and bpe.PerfectHash([b"a"]).find(b"a") == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("ab' \n.19é", max_size=200))
def test_ids_are_those_of_the_library(codec, known, text):
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text)
    assert codec.decode(ids).decode() == text


def test_round_trip_table(spark, documents_of, tokenizers, known):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (3, "b"), (None, "c")]
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    got = bpe.round_trip(documents_of(rows, "ids"), path, tokenizers.PATTERN).collect()

    def expected(doc, text):
        ids = known.encode_ordinary(text or "")
        return (doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())

    assert sorted(map(tuple, got), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert bpe.round_trip(documents_of([]), path, tokenizers.PATTERN).count() == 0


def test_encode_then_decode(spark, documents_of, tokenizers):
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(documents_of(list(enumerate(TEXTS))), path, tokenizers.PATTERN)
    back = bpe.decode(coded, path, tokenizers.PATTERN).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}
    broken = spark.createDataFrame([(1, [220, 107]), (2, None)], "doc_id long, ids array<int>")
    assert [r.text for r in bpe.decode(broken, path, tokenizers.PATTERN).sort("doc_id").collect()][1] == ""

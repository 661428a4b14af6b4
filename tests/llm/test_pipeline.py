import base64
import hashlib

import numpy as np
import tiktoken

import corpus_pipeline
from fieldtally.llm import decontaminate as dc
from fieldtally.llm import quality
from fieldtally.llm.common import WordHashes, table

from .test_near_duplicates import brute as near_groups
from .test_pii import PLAIN, brute as spans_of
from .test_quality import counts

SF = "/root/testdata/sf0.001"


def hidden(text):
    out, at = [], 0
    for span in spans_of(text):
        kind, start, end = span.split(":")
        if int(start) >= at:
            out += [text[at : int(start)], f"[{kind.upper()}]"]
            at = int(end)
    return "".join(out) + text[at:]


def holds_an_item(text, items):
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in dc.words_of(text.lower())])
    for item in items:
        wanted = np.array([number.get(w, -2) for w in item])
        if len(ids) and dc.align(wanted, ids)[0] >= dc.MIN_SCORE * len(item):
            return True
    return False


def expected(spark, tokenizers):
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    model, hashes = quality.train(documents, labels), WordHashes()
    rows = [(d, t) for d, t in rows if not counts(t)[-1] and model.probability(hashes.of(t.encode().split()), t) >= 0.5]
    keep = {d for d, _, _, _, group in near_groups(rows) if d == group}
    rows = [(d, t) for d, t in rows if d in keep]
    items = [dc.words_of((r.text or "").lower()) for r in table(spark, SF, "benchmark").collect()]
    rows = [(d, t) for d, t in rows if not holds_an_item(t, [i for i in items if len(i) >= dc.MIN_WORDS])]
    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [(d, encoding.encode_ordinary(hidden(t))) for d, t in rows]


def test_run_is_as_by_brute_force(spark, tokenizers):
    got = corpus_pipeline.run(spark, SF).collect()
    wanted = expected(spark, tokenizers)
    assert sorted((r.doc_id, list(r.ids)) for r in got) == wanted
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert 100 < len(got) < 200 and list(PLAIN)


def test_stages_take_odd_and_empty_tables(spark, documents_of):
    text = " ".join(f"word{i} of the" for i in range(30))
    rows = [(1, text), (1, text), (None, text + " more"), (2, None), (3, ""), (4, "a@b.cc " + " ".join(f"other{i} in the" for i in range(30)))]
    for given, kept in ((rows, {1, 4}), ([], set())):
        docs = documents_of(given, "bands")
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, SF)
            assert name == "token_ids" or docs.columns == columns
        assert {r.doc_id for r in docs.collect()} == kept

import zlib

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from fieldtally.llm import token_files as tf

TEXTS = [None, "", "Hello, world!", "don't  I'LL ''s 3rd 12.5% ---..!a", "<|endoftext|>x <|startoftext|> <| a", "İ ΣΑΣ ŉ ſ ẞ é ٣ 日本",
         "z" * 5000, "a\tb×c ÀÉ " * 300, "\x1c\x85 z", "same", "same"]


def expected(tokenizer, texts):
    out, start = [], 0
    for t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def written(spark, df, tokenizers, tmp_path, name, **options):
    folder = str(tmp_path / name)
    tf.write(df, folder, tokenizers.path("word_bpe_49k.json"), **options)
    return folder, [tuple(r)[1:] for r in tf.checksums(tf.read_positions(spark, folder)).sort("doc_id", "start").collect()]


def test_files_hold_the_ids_in_order(spark, documents_of, tokenizers, tmp_path):
    tokenizer = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    rows = list(enumerate(TEXTS))
    folder, got = written(spark, documents_of(rows[::-1], "ids"), tokenizers, tmp_path, "a", meta=("lang", "ids"))
    assert got == expected(tokenizer, TEXTS)
    middle = tf.read(spark, folder, 3, 5).select("doc_id", "n_tokens", "meta.ids").sort("doc_id").collect()
    assert [(r.doc_id, r.n_tokens, r.ids) for r in middle] == [(i, got[i][1], "x") for i in (3, 4, 5)]
    plan = tf.read(spark, folder).select("n_tokens")._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[-1].split("\n")[0]
    file = next(p for p in (tmp_path / "a").glob("*.parquet") if pq.ParquetFile(p).metadata.num_rows)
    column = pq.ParquetFile(file).metadata.row_group(0)
    kinds = {column.column(i).path_in_schema: set(column.column(i).encodings) for i in range(column.num_columns)}
    assert any("DICTIONARY" in e for e in kinds["ids.list.element"]) and "DELTA_BINARY_PACKED" in kinds["doc_id"]
    assert all(column.column(i).has_offset_index for i in range(column.num_columns))


def test_ties_nulls_and_empty_tables(spark, documents_of, tokenizers, tmp_path):
    rows = [(5, "b c"), (None, "first"), (5, "b c"), (5, "a"), (2, None)]
    _, got = written(spark, documents_of(rows).repartition(4), tokenizers, tmp_path, "b")
    assert [s for s, _, _ in got] == [0] + [sum(n for _, n, _ in got[:i]) for i in range(1, 5)]
    assert got[1][1] == 1 and len(got) == 5
    assert written(spark, documents_of([]), tokenizers, tmp_path, "c")[1] == []


def test_other_makes_go_to_the_library(tokenizers):
    t = tf.WordTokenizer(tokenizers.path("byte_bpe_50k.json"))
    assert t.cut is None
    assert np.frombuffer(t.encode(["a b"])[0], "<u4").tolist() == t.tokenizer.encode("a b").ids


def test_words_are_coded_by_the_model_alone(tokenizers):
    """Whatever leaves the memory, and with no run of the whole library for words it has not seen."""
    texts = [t for t in TEXTS[1:] if t.isascii() and "<|" not in t and "\x1c" not in t]
    texts += ["Éclair-ñandú's ÀÉ×b÷ß œuvre,žluť!", "it'll don''t 'rex x'S 9a9 __a_b__ \x0b\x0c\ty", "one two three four one five two"]
    library = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    for limit in (1, 3, 1000):
        t = tf.WordTokenizer(tokenizers.path("word_bpe_49k.json"), limit)
        t.tokenizer = None
        got = [np.frombuffer(c, "<u4").tolist() for c in t.encode(texts * 2)]
        assert got == [library.encode(x, add_special_tokens=False).ids for x in texts * 2]
        assert len(t) <= limit

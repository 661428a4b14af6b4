"""Token ids as Parquet files: list columns, controlled pages and row groups, selective reads.

Layout of a row: ``doc_id``, ``part`` (number of the file), ``start_in_part``
(ids of the part before it), ``n_tokens``, ``meta`` (a struct of the columns
asked for) and ``ids``. Files are in ascending ``doc_id`` order, so their
statistics and page indexes lead a read of some documents to some pages.
``ids`` are dictionary-coded (16 bits or fewer for vocabularies of this size),
the ascending columns delta-coded, and a reader that wants lengths or metadata
never touches the ids.

The texts are dealt by ranges of ``doc_id``; rows that share a ``doc_id`` are
told apart by a hash of their text, so that one id with a large part of the rows
is spread as well. Null text counts as empty and becomes the end id alone; null
``doc_id`` comes first. An empty table gives no rows. Only columns named in
``meta`` are kept besides doc_id, inside a struct, so their names clash with none.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from fieldtally.llm.common import list_array, pieces, texts_of

PAGE_OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",  # delta coding where there is no dictionary
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_part": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(64 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


#: Texts in which case, composition and classes of characters are beyond doubt.
_ODD = re.compile(r"[^\t-\r -~\u00C0-\u012F\u0139-\u0148\u014A-\u017E]").search
_LATIN = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x180)) if unicodedata.category(chr(c)).startswith("L")]


class WordTokenizer(dict):
    """The library's ids of each text. As a dict it holds those of words (what white space parts);
    when full it keeps one older generation, from which those still in use return.

    If the tokenizer file puts text in NFC and lower case and cuts it by a pattern, texts
    in Latin letters, digits and ASCII signs are cut at white space, and each new word by that pattern, its
    classes written out; the library's model codes the pre-tokens. Other texts, those that may hold a
    special token, and all texts for files of another make go to the library in whole.
    """

    def __init__(self, path: str, limit: int = 800_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.older: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pattern = self.split_pattern(config)
        written = pattern.replace(r"\p{L}", "".join(_LATIN)).replace(r"\p{N}", "0-9")
        self.cut = re.compile(written, re.ASCII).findall if pattern else None
        before, letters, _ = pattern.partition(r"[\p{L}]+")  # whether nothing else can take the start of a word of letters
        self.whole = str.isalpha if letters and all(x.startswith("'") for x in before.split("|")[:-1]) else lambda word: False
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = str.maketrans({c: byte_level.pre_tokenize_str(c)[0][0] for c in {*_LATIN, *map(chr, range(0x80, 0x180))}})
        self.coded = [i.to_bytes(4, "little") for i in range(1 + max(config["model"]["vocab"].values()))] if pattern else []
        self.tokenize = self.tokenizer.model.tokenize

    @staticmethod
    def split_pattern(config: dict) -> str:
        """The pattern of pre-tokens, or nothing if the file is of another make."""
        normal = [x.get("type") for x in (config.get("normalizer") or {}).get("normalizers", [])]
        cuts = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if normal != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in cuts] != ["Split", "ByteLevel"]:
            return ""
        split, last = cuts
        plain = split["behavior"] == "Removed" and split["invert"] and not last["add_prefix_space"] and not last["use_regex"]
        pattern = split["pattern"].get("Regex", "")
        crosses = " " in pattern or r"[^\s" not in pattern or pattern.count(r"\s") > 1 or "(?" in pattern or r"\b" in pattern
        return pattern if plain and not crosses else ""

    def library(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in coded]

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            parts = (word,) if self.whole(word) else self.cut(word)
            if len(parts) == 1:
                text = parts[0] if word.isascii() else parts[0].translate(self.table)
                coded = self.coded
                ids = b"".join([coded[t.id] for t in self.tokenize(text)])
            else:
                ids = b"".join([self[p] for p in parts])
        if len(self) >= self.limit:  # what is asked for from now on returns
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.cut:
            return self.library(texts)
        get = self.__getitem__
        return [self.library([t])[0] if "<|" in t or _ODD(t) else b"".join(map(get, t.lower().split())) for t in texts]


IN_WORKER: dict[str, WordTokenizer] = {}


def encoded(df: DataFrame, path: str, end_id: int, meta: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the files, in file order within each partition."""
    name = uuid.uuid4().hex
    kind = T.StructType([df.schema[c] for c in meta])
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie")]
    columns += [F.struct(*meta).alias("meta")] if meta else []
    ordered = df.select(*columns).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        if name not in IN_WORKER:
            IN_WORKER.clear()
            IN_WORKER[name] = WordTokenizer(path)
        tokenizer, part, start = IN_WORKER[name], TaskContext.get().partitionId(), 0
        for batch in pieces(batches):
            coded = [c + end for c in tokenizer.encode(texts_of(batch))]
            counts = np.array([len(c) // 4 for c in coded], np.int64)
            starts = start + np.cumsum(counts) - counts
            start += int(counts.sum())
            ids = list_array(np.frombuffer(b"".join(coded), "<i4"), counts, pa.int32())
            values = [batch.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)), pa.array(starts), pa.array(counts)]
            names = ["doc_id", "part", "start_in_part", "n_tokens"]
            if meta:
                values, names = [*values, batch.column("meta")], [*names, "meta"]
            yield pa.RecordBatch.from_arrays([*values, ids], [*names, "ids"])

    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("start_in_part", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            *([T.StructField("meta", kind)] if meta else []),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
        ]
    )
    return ordered.drop("tie").mapInArrow(run, schema)


def write(df: DataFrame, folder: str, path: str, end_id: int = 1, meta: tuple[str, ...] = (), **options: str) -> None:
    """Encode texts with the tokenizer file at ``path`` and write them. ``options`` replace PAGE_OPTIONS."""
    encoded(df, path, end_id, meta).write.options(**(PAGE_OPTIONS | options)).parquet(folder)


def read(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The rows of the files, or those of documents ``first`` to ``last``. Select only what is needed."""
    df = spark.read.parquet(folder)
    if first is not None:
        df = df.filter(F.col("doc_id") >= first)
    return df if last is None else df.filter(F.col("doc_id") <= last)


def part_starts(spark: SparkSession, folder: str) -> DataFrame:
    """For each part, the ids of all parts before it: one row per file, made of the lengths alone."""
    lengths = read(spark, folder).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return lengths.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))


def read_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with ``start``: the ids of all documents before. The broadcast side has one row per file."""
    rows = read(spark, folder).join(F.broadcast(part_starts(spark, folder)), "part")
    return rows.withColumn("start", F.col("part_start") + F.col("start_in_part")).drop("part_start", "start_in_part")


def checksums(df: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
            sums = [zlib.crc32(x.tobytes()) for x in np.split(flat, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return df.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, schema)

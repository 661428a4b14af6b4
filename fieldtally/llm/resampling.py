"""Importance resampling of documents towards a target distribution.

Features are the runs of 1 to ``N_MAX`` consecutive words, hashed into ``BUCKETS`` buckets by CRC-32.

1. Separator-normalised documents (lower case, one space between words) are scanned once: the running
   CRC after each word is kept. A run of words is a substring; its CRC follows from those of two
   prefixes. Over GF(2) the CRC of a text followed by another is the first one, shifted by the length of the second, plus the
   second one, so the shifted CRC of the prefix before the run cancels out of that after it. Shifting is linear:
   tables by byte and length do it for all runs of a batch.
2. Feature counts by bucket of the documents and of the target texts are summed over all rows. A bucket's gain is
   floor(1000 * ln of the ratio of its smoothed shares), a document's weight the floored mean of its features' gains.
3. score = weight + floor(1000 * Gumbel noise of doc_id): the highest scores are a sample without
   replacement in proportion to exp(weight / 1000). Of the documents with ``MIN_WORDS`` words or more, ``PERCENT`` in a
   hundred are drawn, in the order of score, doc_id and number of features.

Ranks come from a sort by ranges: equal rows are counted before it and told apart after it, so copies of one
row, however many, are one row in between. Sent to tasks are ``BUCKETS`` gains and one number per range.

Null texts have no words, weight 0 and are not drawn; null doc_ids share one noise value and come
first among ties. Repeated rows are documents each and take ranks of their own. An empty table gives an empty
result; without target texts all gains still follow from the formula. Other columns are kept by
``drawn`` and left out by ``resampled``.
"""

from __future__ import annotations

import math
import zlib
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldtally.llm.common import pieces, row_key, stored, texts_of

N_MAX, BUCKETS, MIN_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7
BATCH_BYTES = 4_000_000

#: Bytes that are no part of words are spaces, A-Z are lower case.
_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
NORMAL = bytes(b + 32 if 0x41 <= b < 0x5B else b if b in _KEPT else 32 for b in range(256))

NEAR = 64  # lengths that have a table of their own
CHUNK = 1_000_000  # ranks of alike rows dealt at once
NAMES = ["doc_id", "key", "n_words", "n_features", "weight"]


@cache
def byte_table() -> np.ndarray:
    """The CRC-32 register after one byte, for each low byte: eight divisions by the (reflected) polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (table & np.uint32(1)) * np.uint32(0xEDB88320)
    return table


@cache
def shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """[length][place of byte][byte] of a register shifted by that many zero bytes, for all lengths below NEAR; then for NEAR doubled again and again."""
    step = byte_table()
    values = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
    near = [values]
    for _ in range(NEAR):
        near.append(step[near[-1] & np.uint32(255)] ^ (near[-1] >> np.uint32(8)))
    far = [near.pop()]
    for _ in range(25):
        far.append(looked_up(far[-1], far[-1]))
    return np.array(near), np.array(far)


def looked_up(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0][crc & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ table[k][(crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs as if so many zero bytes followed, up to conditioning: what they add to the CRC of a longer text."""
    near, far = shift_tables()
    low = length % NEAR
    out = near[low, 0, crc & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ near[low, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    rest, k = length // NEAR, 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = looked_up(far[k], out[odd])
        rest, k = rest >> 1, k + 1
    return out


def normalised(texts: list[str]) -> list[list[bytes]]:
    return [t.encode().translate(NORMAL).split() for t in texts]


def gram_buckets(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document number of every run of words of normalised documents."""
    sizes = np.array([len(d) for d in documents], np.int64)
    words = list(chain.from_iterable(documents))
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    crc32 = zlib.crc32
    # one scan of each document; a space before its first word changes no substring
    running = chain.from_iterable(accumulate(map(b" ".__add__, d), lambda c, w: crc32(w, c), initial=0) for d in documents)
    after = np.fromiter(running, np.uint32, len(words) + len(documents))
    of = np.repeat(np.arange(len(documents)), sizes)
    end = np.arange(len(words)) + of + 1  # places of running CRCs, one more than words in each document
    before = after[end - 1] ^ np.uint32(0xFFFFFFFF)
    before = byte_table()[(before ^ np.uint32(32)) & np.uint32(255)] ^ (before >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)  # past the space
    length = np.fromiter(map(len, words), np.int64, len(words))
    total = np.concatenate([[0], np.cumsum(length + 1)])
    found, owner = [], []
    for n in range(1, N_MAX + 1):
        first = np.flatnonzero(of[: len(words) - n + 1] == of[n - 1 :]) if len(words) >= n else np.empty(0, np.int64)
        span = total[first + n] - total[first] - 1
        found.append((after[end[first + n - 1]] ^ shifted(before[first], span)) % np.uint32(BUCKETS))
        owner.append(of[first])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


def by_size(batches):
    """Batches of about BATCH_BYTES of text or one row."""
    for batch in pieces(batches):
        sizes = np.cumsum([len(t) for t in texts_of(batch)])
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + BATCH_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """Features by bucket over all texts: one sum of BUCKETS numbers a task, and BUCKETS rows to the driver."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in by_size(batches):
            counts += np.bincount(gram_buckets(normalised(texts_of(batch)))[0], minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "n"])

    total = np.zeros(BUCKETS, np.int64)
    found = rows.select("text").mapInArrow(run, "bucket int, n long")
    for bucket, n in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        total[bucket] = n
    return total


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(smoothed share in the target / smoothed share in the source)) of each bucket."""
    all_target, all_source = float(target.sum()) + BUCKETS, float(source.sum()) + BUCKETS
    pairs = zip(target.tolist(), source.tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target))) for t, s in pairs], np.int64)


def noise(doc_id: Column) -> Column:
    """floor(1000 * Gumbel noise), the same for the same doc_id."""
    mark = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(mark, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def weighed(documents: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, key (see row_key), n_words, n_features, weight and score of each row."""
    sent = documents.sparkSession.sparkContext.broadcast(gains(bucket_counts(target), bucket_counts(documents)))
    kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(documents).alias("key"), "text")

    def run(batches):
        for batch in by_size(batches):
            words = normalised(texts_of(batch))
            bucket, of = gram_buckets(words)
            features = np.bincount(of, minlength=len(words))
            total = np.bincount(of, sent.value[bucket], len(words)).astype(np.int64)  # whole numbers far below 2**53
            weight = total // np.maximum(features, 1)
            numbers = [pa.array(x) for x in (np.array([len(w) for w in words], np.int64), features, weight)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *numbers], NAMES)

    rows = kept.mapInArrow(run, "doc_id long, key string, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id")))


def ranked(rows: DataFrame, percent: int) -> DataFrame:
    """The rows with ``rank``: 1, 2, 3... by descending score for so many in a hundred of those with MIN_WORDS, else null.

    ``rows`` are read more than once: store them first.
    """
    eligible = rows.filter(F.col("n_words") >= MIN_WORDS)
    draws = eligible.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), "n_features", "key"]
    # rows alike in all columns are one until ranks are dealt
    alike = eligible.groupBy(rows.columns).agg(F.count("*").alias("n"))
    dealt = stored(alike.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    before = F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))  # over a row per range
    firsts = dealt.groupBy("range").agg(F.sum("n").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("first"))
    within = F.sum("n").over(W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    placed = dealt.join(F.broadcast(firsts), "range")
    placed = placed.withColumn("start", F.col("first") + F.coalesce(within, F.lit(0)))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))
    place = F.sequence(F.col("chunk") * CHUNK + 1, F.least(F.col("chunk") * CHUNK + CHUNK, "n"))
    placed = placed.withColumn("chunk", chunk).withColumn("place", F.explode(place))
    rank = F.col("start") + F.col("place")
    placed = placed.select(*rows.columns, F.when(rank <= draws, rank).alias("rank"))
    return placed.union(rows.filter(F.col("n_words") < MIN_WORDS).withColumn("rank", F.lit(None).cast("long")))


def resampled(documents: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row; the rank is null for those not drawn."""
    rows = stored(weighed(documents, target), "weights")
    return ranked(rows, percent).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(documents: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows that are drawn, with all their columns. Of rows equal in doc_id and text as many stay as are drawn; which, if their other columns differ, is open."""
    rows = stored(weighed(documents, target), "weights")
    taken = ranked(rows, percent).filter("rank IS NOT NULL").groupBy("key").agg(F.count("*").alias("taken"))
    wanted = stored(taken, "taken").select(F.col("key").alias("taken_key"), "taken")
    held = documents.select(row_key(documents).alias("key"), F.struct("*").alias("row"))
    return held.join(wanted, F.col("key") == F.col("taken_key")).transform(first_of_each)


def first_of_each(rows: DataFrame) -> DataFrame:
    """Rows up to the number ``taken`` of their key. A key has more only where copies of a row are drawn in part."""
    place = F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("row")))
    return rows.withColumn("place", place).filter("place <= taken").select("row.*")

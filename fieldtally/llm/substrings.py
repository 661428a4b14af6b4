"""Substring deduplication: seed and extend.

A word sequence of ``LENGTH`` words that also starts in a document with a smaller
doc_id is removed, whatever else surrounds it.

Seeds. Of each window of ``LENGTH`` words the run of ``SEED`` words with the least hash is the
anchor (winnowing), so two equal windows have the same anchor in the same place.
A document's windows fall into stretches that share an anchor; a stretch is
extended both ways over all its windows, and the hash of what it covers is its context.

Join. Anchors are dealt into buckets by hash, many to a row, and each bucket is
solved for itself. Where a context occurs in a smaller document, all of
its windows go. That settles the inside of every repeat, however many copies
there are, without looking at pairs. What remains are the ends of
repeats, where one anchor has different contexts.

Extend. For those, one document for each context (the smallest) sends the hashes of the
context's windows; a window goes if it also comes from a smaller document. The
words covered by the windows that go are the maximal repeats of LENGTH words or more.

Copies that meet in one batch of a task are settled there: only the smallest
document of a context goes on, so a passage held by a third of all documents
sends one seed per batch. Words are runs without ASCII white space, unchanged. Hashes
have 64 bits. Null texts have no words; texts under LENGTH words lose none. Rows that share
a doc_id, and those without one, do not remove each other's words; each of them gets its own contexts only. Null doc_ids count as larger than all others.
An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import WordHashes, gram_hashes, list_array, mix, pieces, stored, texts_of

LENGTH, SEED = 13, 7
BATCH_ROWS, BUCKET_BYTES = 2000, 8 << 20
NO_ID = (1 << 63) - 1
MARK, ASK, TELL = 0, 1, 2


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, the place of the least one, the last of equals."""
    count = len(grams) - width + 1
    best = np.arange(count)
    least = grams[:count].copy()
    for i in range(1, width):
        later = grams[i : i + count]
        take = later <= least
        least[take] = later[take]
        best[take] = (np.arange(count) + i)[take]
    return best


def stretches(words: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows that share an anchor: the anchor's hash, the context, the first window and the last."""
    empty = np.empty(0, np.int64)
    if len(words) < length:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    grams = gram_hashes(words, seed)
    place = anchors(grams, length - seed + 1)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    # a context is told by its first and last window and its width: these hold all its words
    windows = gram_hashes(words, length)
    with np.errstate(over="ignore"):
        context = windows[first] * np.uint64(0x9E3779B97F4A7C15) + windows[last] * np.uint64(0xC2B2AE3D27D4EB4F)
        context += (last - first).astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        context ^= context >> np.uint64(29)
    return grams[place[first]], context, first, last


def ids_of(batch: pa.RecordBatch) -> list[int]:
    return [NO_ID if d is None else d for d in batch.column("doc_id").to_pylist()]


def dealt(documents: DataFrame, buckets: int) -> DataFrame:
    """bucket, anchors, contexts, docs: what a batch has in a bucket. Negative buckets hold contexts settled in the batch."""

    def run(batches):
        hashes, part = WordHashes(), TaskContext.get().partitionId() << 32
        for number, batch in enumerate(pieces(batches, BATCH_ROWS), start=part):
            found = []
            for doc, text in zip(ids_of(batch), texts_of(batch)):
                anchor, context, _, _ = stretches(hashes.of(text.encode().split()))
                found.append((anchor, context, np.full(len(anchor), doc, np.int64)))
            anchor, context, doc = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((doc, context, anchor))
            anchor, context, doc = anchor[order], context[order], doc[order]
            if not len(anchor):
                continue
            same = np.r_[False, (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1])]
            group = np.flatnonzero(~same)
            least = np.repeat(doc[group], np.diff(np.r_[group, len(doc)]))
            settled = doc > least
            bucket = ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            # a document is in one batch, rows without id or of one id are in many: the batch has a say
            dealt_by = mix(doc[settled].view(np.uint64) ^ mix(np.array([number], np.uint64)))
            bucket[settled] = -1 - (dealt_by % np.uint64(buckets)).astype(np.int32)
            use = ~same | settled  # once for each document
            bucket, anchor, context, doc = bucket[use], anchor[use], context[use], doc[use]
            order = np.lexsort((doc, bucket))
            bucket, anchor, context, doc = bucket[order], anchor[order], context[order], doc[order]
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            lengths = np.diff(np.r_[start, len(bucket)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[start], pa.int32()),
                    list_array((anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), lengths, pa.int32()),
                    list_array(context.view(np.int64), lengths, pa.int64()),
                    list_array(doc, lengths, pa.int64()),
                ],
                ["bucket", "anchors", "contexts", "docs"],
            )

    schema = "bucket int, anchors array<int>, contexts array<long>, docs array<long>"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def lists_by_doc(doc: np.ndarray, context: np.ndarray, kind: int) -> pa.Table:
    order = np.argsort(doc, kind="stable")
    doc, context = doc[order], context[order]
    start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
    lists = list_array(context, np.diff(np.r_[start, len(doc)]), pa.int64())
    kinds = pa.array(np.full(len(start), kind, np.int8))
    return pa.Table.from_arrays([pa.array(doc[start], pa.int64()), kinds, lists], ["doc", "kind", "contexts"])


def solved(bucket: pa.Table) -> pa.Table:
    """doc, kind, contexts of each document: those that go (MARK), those whose windows may go or
    make others go (ASK), and those that may only make others go, as no smaller document has the anchor (TELL)."""
    context = bucket.column("contexts").combine_chunks().flatten().to_numpy()
    doc = bucket.column("docs").combine_chunks().flatten().to_numpy()
    if bucket.column("bucket")[0].as_py() < 0:
        return lists_by_doc(doc, context, MARK)
    anchor = bucket.column("anchors").combine_chunks().flatten().to_numpy()
    order = np.lexsort((doc, context, anchor))
    anchor, context, doc = anchor[order], context[order], doc[order]
    new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
    new_context = new_anchor | np.r_[True, context[1:] != context[:-1]]
    group = np.flatnonzero(new_context)
    least = np.repeat(doc[group], np.diff(np.r_[group, len(doc)]))
    goes = doc > least
    number = np.cumsum(new_anchor[group]) - 1  # of the anchor, for each context
    several = np.bincount(number)[number] > 1
    smallest = np.minimum.reduceat(doc, np.flatnonzero(new_anchor))[number] == doc[group]
    ask, tell = group[several & ~smallest], group[several & smallest]
    marks = lists_by_doc(doc[goes], context[goes], MARK)
    return pa.concat_tables([marks, lists_by_doc(doc[ask], context[ask], ASK), lists_by_doc(doc[tell], context[tell], TELL)])


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All window numbers of stretches."""
    lengths = last - first + 1
    return np.repeat(first - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum()) if len(first) else first


def outcome(raw: list[bytes], gone: np.ndarray) -> tuple[int, int, str]:
    """n_words, n_removed, kept_sha256, with the windows that go."""
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, gone, 1)
    np.subtract.at(edge, gone + LENGTH, 1)
    out = np.cumsum(edge[:-1]) > 0
    kept = b" ".join([w for w, o in zip(raw, out.tolist()) if not o]) if out.any() else b" ".join(raw)
    return len(raw), int(out.sum()), kept


def lists_of(rows: DataFrame, key: str) -> DataFrame:
    """key, marks, asks, tells, of rows with contexts by kind."""
    of_kind = lambda k: F.flatten(F.collect_list(F.when(F.col("kind") == k, F.col("contexts"))))
    return rows.groupBy(key).agg(of_kind(MARK).alias("marks"), of_kind(ASK).alias("asks"), of_kind(TELL).alias("tells"))


def lists_by_row(documents: DataFrame, lists: DataFrame) -> DataFrame:
    """row, marks, asks, tells of documents that share their doc: of the lists of a doc, a row gets the contexts it holds."""

    def run(batches):
        hashes = WordHashes()
        for batch in pieces(batches):
            found = [np.unique(stretches(hashes.of(t.encode().split()))[1].view(np.int64)) for t in texts_of(batch)]
            contexts = list_array(np.concatenate(found), [len(f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc"), contexts], ["row", "doc", "contexts"])

    held = documents.select("row", "doc", "text").mapInArrow(run, "row long, doc long, contexts array<long>")
    held = held.select("row", "doc", F.explode("contexts").alias("context")).distinct()
    known = lists.select("doc", "kind", F.explode("contexts").alias("context")).distinct()
    return lists_of(held.join(known, ["doc", "context"]).select("row", "kind", F.array("context").alias("contexts")), "row")


def extended(documents: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """Each document with its result, or, if windows of it are in question, with its text and what goes already; and
    the windows it was asked for."""
    joined = documents.join(lists, key, "left")

    def run(batches):
        hashes = WordHashes()
        for batch in pieces(batches):
            rows = []
            lists = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "marks", "asks", "tells")))
            for (doc, row, mark, ask, tell), text in zip(lists, texts_of(batch)):
                raw = text.encode().split()
                if not mark and not ask and not tell:
                    rows.append((doc, len(raw), 0, b" ".join(raw), None, None, row))
                    continue
                words = hashes.of(raw)
                _, context, first, last = stretches(words)
                known = context.view(np.int64)
                goes = np.isin(known, np.array(mark or [], np.int64))
                asked = np.isin(known, np.array([*(ask or []), *(tell or [])], np.int64)) & ~goes
                gone, windows = spread(first[goes], last[goes]), None
                if asked.any():
                    windows = np.unique(gram_hashes(words, LENGTH).view(np.int64)[spread(first[asked], last[asked])]).tolist()
                if ask:
                    rows.append((doc, len(raw), 0, text.encode(), gone.tolist(), windows, row))
                else:
                    rows.append((doc, *outcome(raw, gone), None, windows, row))
            columns = list(zip(*rows)) or [()] * 7
            columns[3] = [hashlib.sha256(k).hexdigest() if g is None else k.decode() for k, g in zip(columns[3], columns[4])]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_words", "n_removed", "result", "gone", "windows", "row"]
            )

    schema = "doc_id long, n_words long, n_removed long, result string, gone array<long>, windows array<long>, row long"
    return joined.select("doc_id", "row", "text", "marks", "asks", "tells").mapInArrow(run, schema)


def finished(pending: DataFrame) -> DataFrame:
    """Results of the documents with windows in question, of their text and all windows that go."""

    def run(batches):
        hashes = WordHashes()
        for batch in pieces(batches):
            rows = []
            for doc, text, gone, more in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "result", "gone", "more"))):
                raw = text.encode().split()
                windows = gram_hashes(hashes.of(raw), LENGTH).view(np.int64)
                also = np.flatnonzero(np.isin(windows, np.array(more or [], np.int64)))
                n, removed, kept = outcome(raw, np.union1d(np.array(gone, np.int64), also).astype(np.int64))
                rows.append((doc, n, removed, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return pending.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    lists = dealt(documents, buckets).groupBy("bucket").applyInArrow(solved, "doc long, kind byte, contexts array<long>")
    doc = F.coalesce("doc_id", F.lit(NO_ID))
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("doc", doc)
    documents = documents.withColumn("row", F.xxhash64("doc", "text"))
    shared = stored(documents.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select("doc"), "shared")
    if shared.isEmpty():
        rows = extended(documents, lists_of(lists, "doc"), "doc")
    else:
        lists = stored(lists, "lists")
        several = documents.join(shared, "doc", "left_semi")
        single = extended(documents.join(shared, "doc", "left_anti"), lists_of(lists.join(shared, "doc", "left_anti"), "doc"), "doc")
        rows = single.unionAll(extended(several, lists_by_row(several, lists.join(shared, "doc", "left_semi")), "row"))
    rows = stored(rows, "repeats")
    keyed = rows.withColumn("doc", doc)
    pending = keyed.filter(F.col("gone").isNotNull())
    told = keyed.select("doc", F.explode("windows").alias("window"))
    least = told.groupBy("window").agg(F.min("doc").alias("least"))
    asked = pending.select("doc", "row", F.explode("windows").alias("window"))
    if not shared.isEmpty():
        asked = asked.distinct()  # equal rows ask once
    more = asked.join(least, "window").filter("doc > least").groupBy("row").agg(F.collect_list("window").alias("more"))
    done = rows.filter(F.col("gone").isNull()).select("doc_id", "n_words", "n_removed", F.col("result").alias("kept_sha256"))
    rest = pending.join(more, "row", "left").select("doc_id", "result", "gone", "more")
    return done.unionAll(finished(rest))

"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The words of the test items are counted over all documents (sums per word of
   the benchmark's vocabulary). A seed is a run of ``SEED`` words of an item
   whose expected number of chance occurrences in the corpus, its words taken
   as independent, is at most ``MAX_CHANCE``. Frequent copies of an item do not
   make its seeds frequent in this sense. Whatever the size of the corpus, the
   rarest quarter of an item's runs are seeds as well, and the rarest of every ``SPREAD`` runs.
2. The seeds are sent to the documents (at most ``BLOCK_SEEDS`` at a time; larger
   benchmarks take several passes over blocks of items) and matched there, so no
   text is shuffled and a hot passage costs each document its own hits only.
3. Around each hit the item is aligned with the passage. The score is that of the
   best local alignment (match 1, other word or gap -0.6) per word of the item. It counts from
   ``MIN_SCORE`` on, and a part of an item counts from ``PART`` words on with ``PART_SCORE`` per word of the passage.

Words are runs of letters, digits and underscores in lower case; in scripts without spaces each
character is a word. Items of fewer than ``MIN_WORDS`` words match where they stand whole and unchanged, those
of fewer than ``SEED`` words, which any text may hold, match a text of nothing else. Null and
empty texts match nothing. Repeated rows and items give a row each. Without items
or documents the result is empty. Other columns are kept in ``clean`` only.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import MULT, mix, pieces, texts_of

SEED, MAX_CHANCE, SPREAD, BLOCK_SEEDS = 3, 0.01, 8, 1_000_000
MIN_WORDS, MIN_SCORE, PENALTY = 8, 0.5, 0.6
PART, PART_SCORE = 20, 0.4

#: Thai to Tibetan, Myanmar, Khmer, kana, Han: scripts without spaces between words.
UNSPACED = r"\u0e01-\u0e4e\u0e81-\u0eff\u0f40-\u0fbc\u1000-\u109f\u1780-\u17d3\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_unspaced = re.compile(f"[{UNSPACED}]").search
_spaced_words = re.compile(r"\w+").findall
_all_words = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+").findall


def words_of(text: str) -> list[str]:
    return _spaced_words(text) if text.isascii() or not _unspaced(text) else _all_words(text)


def codes(ids: np.ndarray, n: int = SEED) -> np.ndarray:
    """Hashes of runs of n word numbers."""
    count = len(ids) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    x = ids.astype(np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * MULT + x[i : i + count] + np.uint64(1)
    return mix(out)


def word_counts(documents: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """Occurrences of each word of the vocabulary in all texts, and the number of all words."""
    sent = documents.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})
    size = len(vocabulary)

    def run(batches):
        number = sent.value
        totals = np.zeros(size + 1, np.int64)  # the last one: of all other words
        for batch in pieces(batches):
            for text in texts_of(batch):
                ids = [number.get(w, size) for w in words_of(text.lower())]
                totals += np.bincount(ids, minlength=size + 1) if ids else 0
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(totals[at], pa.int64())], ["word", "n"])

    sums = documents.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for word, n in sums.collect():  # a row per word of the benchmark
        counts[word] = n
    return counts[:size], int(counts.sum())


class Items:
    """A block of test items as word numbers, with their seeds in order of hash."""

    def __init__(self, items: list[tuple[int, list[str]]], counts: dict[str, int], total: int) -> None:
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
        self.ids = [i for i, _ in items]
        self.words = [np.array([self.number[w] for w in words], np.int64) for _, words in items]
        rate = np.array([max(counts.get(w, 0), 1) / max(total, 1) for w in self.number])
        self.whole = defaultdict(list)
        found, item, place = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, words in enumerate(self.words):
            if len(words) < SEED:
                self.whole[tuple(items[k][1])].append(k)
                continue
            log = np.log(rate[words])
            chance = sum(log[i : len(log) - SEED + 1 + i] for i in range(SEED)) + np.log(max(total, 1))
            rare = (chance <= np.log(MAX_CHANCE)) | (chance <= np.quantile(chance, 0.25))
            for i in range(0, len(chance), SPREAD):
                rare[i + int(chance[i : i + SPREAD].argmin())] = True
            at = np.flatnonzero(rare)
            found.append(codes(words)[at])
            item.append(np.full(len(at), k))
            place.append(at)
        self.seeds, self.item, self.place = (np.concatenate(x) for x in (found, item, place))
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.item, self.place = self.seeds[order], self.item[order], self.place[order]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Score of the best local alignment and where it ends in the passage."""
    steps = np.arange(len(passage) + 1) * PENALTY
    row = np.zeros(len(passage) + 1)
    best, end = 0.0, 0
    for word in item:
        new = np.empty_like(row)
        new[0] = 0
        np.maximum(row[:-1] + np.where(passage == word, 1.0, -PENALTY), row[1:] - PENALTY, out=new[1:])
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + steps) - steps  # gaps in the item, of any length
        at = int(new.argmax())
        if new[at] > best + 1e-9:
            best, end = float(new[at]), at
        row = new
    return best, end


def find(items: Items, text: str) -> list[tuple[int, float, int, int, int]]:
    """item_id, score, first word, word after the last, seeds hit: the best passage for each item found."""
    words = words_of(text.lower())
    get = items.number.get
    ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    if len(ids) < SEED:
        return [(items.ids[k], 1.0, 0, len(ids), 0) for k in items.whole.get(tuple(words), [])]
    known = ids >= 0
    at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
    if not len(at):
        return []
    runs = codes(ids)[at]
    left, right = np.searchsorted(items.seeds, runs, "left"), np.searchsorted(items.seeds, runs, "right")
    hits = defaultdict(list)
    for k in np.flatnonzero(left < right):
        for s in range(left[k], right[k]):
            hits[int(items.item[s])].append(int(at[k]) - int(items.place[s]))
    out = []
    for k, starts in sorted(hits.items()):
        item = items.words[k]
        if len(item) < MIN_WORDS:
            at_all = [a for a in sorted(set(starts)) if a >= 0 and np.array_equal(ids[a : a + len(item)], item)]
            if at_all:
                out.append((items.ids[k], 1.0, at_all[0], at_all[0] + len(item), len(starts)))
            continue
        slack = len(item) // 4 + 5
        best = (0.0, 0, 0)
        done = -1
        for start in sorted(set(starts)):
            if start <= done:
                continue
            # one window for all starts within the slack
            lo, hi = max(0, start - slack), min(len(ids), start + len(item) + 2 * slack)
            done = start + slack
            score, end = align(item, ids[lo:hi])
            if score > best[0] + 1e-9:
                best = (score, lo, lo + end)
        score, lo, end = best
        if score < min(MIN_SCORE * len(item), PART_SCORE * PART):
            continue
        _, back = align(item[::-1], ids[lo:end][::-1])
        if score < MIN_SCORE * len(item) and (back < PART or score < PART_SCORE * back):
            continue
        out.append((items.ids[k], round(score / len(item), 4), end - back, end, len(starts)))
    return out


def blocks(documents: DataFrame, benchmark: DataFrame) -> list[Items]:
    """The items in blocks of bounded size. The benchmark itself must fit the driver; it does not grow with the corpus."""
    items = []
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), "text").sort("item_id", "text").toLocalIterator():
        words = words_of((text or "").lower())
        if words:
            items.append((item_id, words))
    if not items:
        return []
    vocabulary = sorted({w for _, words in items for w in words})
    counts, total = word_counts(documents, vocabulary)
    known = dict(zip(vocabulary, counts.tolist()))
    out, block, size = [], [], 0
    for item in items:
        if block and size + len(item[1]) > BLOCK_SEEDS:
            out.append(Items(block, known, total))
            block, size = [], 0
        block.append(item)
        size += len(item[1])
    return [*out, Items(block, known, total)]


SCHEMA = "doc_id long, item_id long, score double, first_word long, end_word long, n_seeds long"


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item it holds: score, words of the passage (end exclusive), seeds hit."""
    spark = documents.sparkSession
    result = None
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for block in blocks(documents, benchmark):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            items = sent.value
            for batch in pieces(batches):
                rows = [
                    (doc_id, *row)
                    for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch))
                    for row in find(items, text)
                ]
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
        result = found if result is None else result.unionAll(found)
    return spark.createDataFrame([], SCHEMA) if result is None else result


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no item, with all their columns."""
    for block in blocks(documents, benchmark):
        sent = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            items = sent.value
            for batch in pieces(batches):
                yield batch.filter(pa.array([not find(items, t) for t in texts_of(batch)], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents

"""Quality rules: fixed counts, and logistic regression on hashed word and character n-grams.

Features are the shares of hashed word 1- and 2-grams and of character 3-grams, so
long and short texts are alike and a score is two means of weights. The model is
fitted on labelled rows, at most ``SAMPLE_ROWS`` of them (those of the lowest
hashes of doc_id), and its score is turned into a probability on the part of
the sample that the fit didn't see (``HELD_OUT``). Every text is scored in whole,
in Arrow batches; only the weights, of fixed size, are sent out.

Null text has no words and fails the base rules, as a text of white space does.
Repeated rows are judged alike. Without labels (or with one class only) the
model keeps all. Labels without text, and null labels, are not used. Of
clashing labels for a document each counts as a row; of rows that share a labelled doc_id one is used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import WordHashes, gram_hashes, map_batches, mix, texts_of

BITS = 17  # of each of the two feature blocks
SAMPLE_ROWS = 3000
HELD_OUT = 4  # one row of so many calibrates
MIN_WORDS, MAX_REPEATED_PERCENT, MIN_PROBABILITY = 20, 30, 0.5
REPEAT_WINDOW = 8
SPACES, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"  # fixed values


def word_features(words: np.ndarray) -> np.ndarray:
    """Feature numbers of word 1- and 2-grams, of the words' hashes."""
    return (np.concatenate([words, gram_hashes(words, 2)]) >> np.uint64(64 - BITS)).astype(np.int64)


def char_features(text: str) -> np.ndarray:
    """Feature numbers of character 3-grams."""
    x = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(x) < 3:
        return np.empty(0, np.int64)
    code = (x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:]  # code points have 21 bits
    return (mix(code) >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS)


@dataclass
class QualityModel:
    """weights: of both blocks. probability = 1 / (1 + exp(-(slope * score + offset)))."""

    weights: np.ndarray
    slope: float
    offset: float

    def probability(self, words: np.ndarray, text: str) -> float:
        score = 0.0
        for found in (word_features(words), char_features(text)):
            if len(found):
                score += float(self.weights[found].mean())
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * score + self.offset))))


KEEP_ALL = QualityModel(np.zeros(2 << BITS, np.float32), 0.0, 50.0)


def shares(documents: DataFrame) -> DataFrame:
    """quality, feature numbers and their shares, of each text."""

    def make():
        hashes = WordHashes()

        def f(batch):
            numbers, values = [], []
            for text in texts_of(batch):
                raw = text.encode()
                index, share = [], []
                for found in (word_features(hashes.of(raw.split())), char_features(text)):
                    if len(found):
                        own, counts = np.unique(found, return_counts=True)
                        index.append(own)
                        share.append(counts / len(found))
                numbers.append(np.concatenate(index).astype(np.int32) if index else [])
                values.append(np.concatenate(share).astype(np.float32) if share else [])
            return pa.RecordBatch.from_arrays(
                [batch.column("quality"), pa.array(numbers, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                ["quality", "numbers", "values"],
            )

        return f

    return map_batches(documents.select("text", "quality"), make, "quality int, numbers array<int>, values array<float>", 128)


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on at most ``rows`` labelled documents."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .dropna()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(rows)
    )
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # of at most ``rows`` rows
    # of rows that share a labelled doc_id one counts, that of the least text hash
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = shares(texts).toArrow()
    target = np.array(found.column("quality").to_pylist(), np.float64)
    if len(set(target)) < 2:
        return KEEP_ALL
    lengths = np.array([len(x) for x in found.column("numbers")])
    index = np.concatenate([c.flatten().to_numpy() for c in found.column("numbers").chunks])
    value = np.concatenate([c.flatten().to_numpy() for c in found.column("values").chunks]).astype(np.float64)
    row = np.repeat(np.arange(len(target)), lengths)
    # rows come in any order: who is held out follows from the features
    mark = np.bincount(row, value * ((index * 40503) % 1009), len(target))
    held = np.argsort(np.argsort(mark, kind="stable")) % HELD_OUT == 0
    weights = fit(index, value, row, target, ~held)
    score = np.bincount(row, value * weights[index], len(target))
    slope, offset = calibrate(score[held], target[held])
    return QualityModel(weights.astype(np.float32), slope, offset)


def fit(index, value, row, target, use, steps: int = 120, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression by accelerated gradient descent, classes weighted alike."""
    used, small = np.unique(index, return_inverse=True)
    n = len(target)
    weight = np.where(use, np.where(target > 0, 0.5 / max(1, (target[use] > 0).sum()), 0.5 / max(1, (target[use] <= 0).sum())), 0.0)
    squares = np.bincount(row, value * value, n)
    step = 4.0 / max(float(squares.max(initial=0.0)), 1e-12)
    w = ahead = np.zeros(len(used))
    bias = 0.0
    for k in range(steps):
        score = np.bincount(row, value * ahead[small], n) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(score, -40, 40))) - target)
        new = ahead - step * (np.bincount(small, value * error[row], len(used)) + ridge * ahead)
        bias -= float(error.sum())
        w, ahead = new, new + (k / (k + 3)) * (new - w)
    full = np.zeros(2 << BITS)
    full[used] = w
    return full


def calibrate(score: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability (Platt's targets), by Newton's method."""
    if not len(score):
        return 1.0, 0.0
    good, bad = float((target > 0).sum()), float((target <= 0).sum())
    wanted = np.where(target > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    spread = float(score.std()) or 1.0
    x = np.stack([score / spread, np.ones(len(score))], 1)
    a = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
        gradient = x.T @ (p - wanted) + 1e-3 * a
        a = a - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
    return float(a[0]) / spread, float(a[1])


def repeated(words: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words inside windows that occur twice or more in the text."""
    grams = gram_hashes(words, window)
    if len(grams) < 2:
        return 0
    _, place, counts = np.unique(grams, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[place] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[starts] += 1
    np.subtract.at(edge, starts + window, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(raw: bytes) -> int:
    seen: set[bytes] = set()
    count = 0
    for line in raw.split(b"\n"):
        if line in seen:
            count += 1
        elif line.strip(SPACES):
            seen.add(line)
    return count


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
KINDS = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
TYPES = ["long"] * 5 + ["boolean", "double", "boolean"]


def judge(documents: DataFrame, model: QualityModel, keep: bool = False) -> DataFrame:
    """doc_id, the counts, base_failed, probability and kept, of each row.

    ``keep``: instead of that, the rows of ``documents`` that are kept, with all their columns.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        own, hashes = sent.value, WordHashes()

        def verdict(text: str) -> tuple:
            raw = text.encode()
            words = hashes.of(raw.split())
            n, again = len(words), repeated(words)
            failed = n < MIN_WORDS or 100 * again > MAX_REPEATED_PERCENT * n
            p = own.probability(words, text)
            chars = len(text) - len(raw) + len(raw.translate(None, SPACES))
            symbols = len(raw) - len(raw.translate(None, SYMBOLS))
            return n, chars, symbols, repeated_lines(raw), again, failed, p, not failed and p >= MIN_PROBABILITY

        def f(batch):
            rows = [verdict(t) for t in texts_of(batch)]
            if keep:
                return batch.filter(pa.array([r[-1] for r in rows], pa.bool_()))
            columns = list(zip(*rows)) or [()] * len(NAMES)
            values = [pa.array(c, k) for c, k in zip(columns, KINDS)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *values], ["doc_id", *NAMES])

        return f

    if keep:
        return map_batches(documents, make, documents.schema)
    schema = "doc_id long, " + ", ".join(f"{n} {t}" for n, t in zip(NAMES, TYPES))
    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema)

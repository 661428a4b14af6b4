"""SimHash near duplicates by the general pigeonhole principle.

A fingerprint has bit k set if more than half of the XXH64 (seed 42) hashes of a text's runs of ``GRAM`` words have it, repeats
included. Fingerprints link at ``RADIUS`` or fewer differing bits.

1. Bits are grouped into partitions, correlated bits together (``BITS_IN``: three, two or one of them); the
   correlations are sums over all fingerprints.
2. If the thresholds of the partitions add up to RADIUS + 1 - partitions (-1 skips one), every linked pair
   agrees with one partition up to its threshold. For each fingerprint dynamic programming finds the thresholds of least cost: a
   probe for each value within the threshold, and the candidates estimated from counts of values of bit
   ranges of up to ``RANGE`` bits, over all fingerprints.
3. Probes meet the numbers of fingerprints by partition value first; those that meet none end there. A fingerprint that
   would meet more candidates than the one partition of all bits costs probes (that one meets but linked fingerprints)
   is probed by that one instead. So no fingerprint takes more than ``MOST`` comparisons, however many share a value.
4. The other probes meet the fingerprints themselves, and differing bits are counted.

Equal fingerprints are one before all this, however many rows have them. Links join fingerprints to components.

A-Z are lower-cased, words are runs without ASCII white space; a text of fewer than GRAM words is one run, one
without words (as null is) has fingerprint zero, which links like any other. Null doc_ids are kept and never name a
component that has others. Repeated rows get a row each. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import map_batches, pieces, stored, texts_of
from fieldtally.llm.graph import components

GRAM, RADIUS, SEED = 3, 2, 42
BITS_IN = [(22, 21, 21), (32, 32), (64,)]
RANGE = 11
PROBE_COST = 8  # comparisons that cost as much as a probe
BLOCK = 1 << 15  # runs of words, or probes, made at once


def fingerprint(text: str) -> int:
    words = text.encode().lower().split()  # of bytes: ASCII letters and white space only
    joined, n = b" ".join(words), max(0, len(words) - GRAM + 1) or (len(words) > 0)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends + 1).tolist()][:n]
    stops = ends[min(GRAM, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    set_in = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])]
        set_in += bits_of(np.array(part, np.uint64)).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def bits_of(values: np.ndarray) -> np.ndarray:
    """A row of 64 bits for each value, the lowest first."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed number, of each row."""

    def make():
        def f(batch):
            found = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

        return f

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, fp long")


def values_of(batches):
    for batch in pieces(batches, BLOCK):
        yield batch.column("fp").to_numpy().view(np.uint64)


def correlations(fps: DataFrame) -> np.ndarray:
    """Absolute correlation of each pair of bits: 64 x 64 sums from the tasks."""

    def run(batches):
        both, count = np.zeros((64, 64)), 0
        for values in values_of(batches):
            x = bits_of(values).astype(np.float32)
            both += x.T @ x
            count += len(x)
        cells = np.append(both.ravel(), count).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "n"])

    found = np.zeros(64 * 64 + 1)
    for cell, n in fps.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 4,097 rows
        found[cell] = n
    share = found[:-1].reshape(64, 64) / max(1.0, found[-1])
    own = np.diag(share)
    spread = np.sqrt(np.maximum(own * (1 - own), 1e-12))
    return np.abs(share - np.outer(own, own)) / np.outer(spread, spread)


def grouped_bits(related: np.ndarray, sizes: tuple[int, ...]) -> list[list[int]]:
    """Bits by partition: each starts with the most related pair left and takes what is most related to what it has."""
    left, out = list(range(64)), []
    for size in sizes:
        if size == len(left):
            out.append(left)
            break
        _, own = max((related[i, j], [i, j]) for i, j in combinations(left, 2))
        while len(own) < size:
            own.append(max((b for b in left if b not in own), key=lambda b: (related[b, own].mean(), -b)))
        out.append(own)
        left = [b for b in left if b not in own]
    return out


@cache
def masks(width: int, most: int) -> np.ndarray:
    """All values of up to ``most`` set bits, by rising number of them."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(width), n)], np.uint64)


@dataclass
class Partitions:
    """bits: of each partition of all groupings. nearby: by partition and bit range, the share of fingerprints at 0, 1, 2.. bits from each value."""

    bits: list[list[int]]
    nearby: list[list[np.ndarray]]
    total: int

    def value(self, part: int, bits: np.ndarray, start: int = 0, stop: int = 64) -> np.ndarray:
        out = np.zeros(len(bits), np.uint64)
        for k, b in enumerate(self.bits[part][start:stop]):
            out |= bits[:, b].astype(np.uint64) << np.uint64(k)
        return out

    def candidates(self, part: int, bits: np.ndarray) -> np.ndarray:
        """Estimated fingerprints at 0, 1.. RADIUS bits from each row in this partition, as if bit ranges were independent."""
        shares = np.zeros((len(bits), RADIUS + 1))
        shares[:, 0] = 1
        for k, near in enumerate(self.nearby[part]):
            own = near[self.value(part, bits, k * RANGE, (k + 1) * RANGE).astype(np.int64)]
            shares = np.stack([sum(shares[:, i] * own[:, d - i] for i in range(d + 1)) for d in range(RADIUS + 1)], 1)
        return shares.cumsum(axis=1) * self.total

    def thresholds(self, parts: range, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least cost of each row over the partitions of a grouping, and their thresholds."""
        budget = RADIUS + 1  # of thresholds plus one
        cost = np.full((len(bits), budget + 1), np.inf)
        cost[:, 0] = 0
        choices = []
        for part in parts:
            width, met = len(self.bits[part]), self.candidates(part, bits)
            price = np.zeros((len(bits), budget + 1))
            for t in range(RADIUS + 1):
                price[:, t + 1] = PROBE_COST * len(masks(width, t)) + met[:, t]
            options = np.full((len(bits), budget + 1, budget + 1), np.inf)  # [row][spent][spent here]
            for spent in range(budget + 1):
                for here in range(spent + 1):
                    options[:, spent, here] = cost[:, spent - here] + price[:, here]
            choices.append(options.argmin(axis=2))
            cost = options.min(axis=2)
        spent, chosen = np.full(len(bits), budget), []
        for choice in reversed(choices):
            here = choice[np.arange(len(bits)), spent]
            chosen.append(here - 1)
            spent = spent - here
        return cost[:, budget], np.stack(chosen[::-1], 1)


def groupings() -> list[range]:
    ends = np.cumsum([len(sizes) for sizes in BITS_IN]).tolist()
    return [range(a, b) for a, b in zip([0, *ends], ends)]


ALL_BITS = sum(map(len, BITS_IN)) - 1  # the partition of all bits
MOST = PROBE_COST * len(masks(64, RADIUS))


def partitions(fps: DataFrame, total: int) -> Partitions:
    """Groups of bits and counts of values by bit range; no more than 2**RANGE rows for each range reach the driver."""
    related = correlations(fps)
    out = Partitions([bits for sizes in BITS_IN for bits in grouped_bits(related, sizes)], [], total)
    ranges = [(p, k) for p, bits in enumerate(out.bits) if p != ALL_BITS for k in range(0, len(bits), RANGE)]

    def run(batches):
        counts = np.zeros((len(ranges), 1 << RANGE), np.int64)
        for values in values_of(batches):
            bits = bits_of(values)
            for i, (part, k) in enumerate(ranges):
                counts[i] += np.bincount(out.value(part, bits, k, k + RANGE).astype(np.int64), minlength=1 << RANGE)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(counts.ravel()[cells])], ["cell", "n"])

    counts = np.zeros(len(ranges) << RANGE)
    for cell, n in fps.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[cell] = n
    out.nearby = [[] for _ in out.bits]
    for (part, k), own in zip(ranges, counts.reshape(len(ranges), -1) / max(1, total)):
        width = min(RANGE, len(out.bits[part]) - k)
        place = np.arange(1 << width)
        shells = [sum(own[place ^ int(m)] for m in masks(width, d)[len(masks(width, d - 1)) if d else 0 :]) for d in range(RADIUS + 1)]
        out.nearby[part].append(np.stack(shells, 1))
    return out


def index_rows(fps: DataFrame, parts: Partitions) -> DataFrame:
    """part, value and fp: each fingerprint's value in each partition but that of all bits."""

    def run(batches):
        for values in values_of(batches):
            bits = bits_of(values)
            for part in range(ALL_BITS):
                yield probe_batch(part, parts.value(part, bits), values, ["part", "value", "fp"])

    return fps.mapInArrow(run, "part int, value long, fp long")


def probe_batch(part: int, value: np.ndarray, fp: np.ndarray, names: list[str]) -> pa.RecordBatch:
    columns = [np.full(len(fp), part, np.int32), value.view(np.int64), fp.view(np.int64)]
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names)


def probes(fps: DataFrame, parts: Partitions) -> DataFrame:
    """part, value and of: the values that a fingerprint is looked for under."""

    def run(batches):
        for values in values_of(batches):
            bits = bits_of(values)
            plans = [(g, *parts.thresholds(g, bits)) for g in groupings()]
            best = np.stack([cost for _, cost, _ in plans]).argmin(axis=0)
            for i, (group, _, chosen) in enumerate(plans):
                for k, part in enumerate(group):
                    for t in range(RADIUS + 1):
                        rows = np.flatnonzero((best == i) & (chosen[:, k] == t))
                        yield from around(part, parts.value(part, bits[rows]) if part != ALL_BITS else values[rows], values[rows], len(parts.bits[part]), t)

    return fps.mapInArrow(run, "part int, value long, of long")


def around(part: int, value: np.ndarray, fp: np.ndarray, width: int, threshold: int):
    near = masks(width, threshold)
    step = max(1, BLOCK // len(near))
    for at in range(0, len(fp), step):
        own = value[at : at + step]
        yield probe_batch(part, (own[:, None] ^ near[None, :]).ravel(), np.repeat(fp[at : at + step], len(near)), ["part", "value", "of"])


def links(fps: DataFrame) -> DataFrame:
    """a, b: every pair of linked fingerprints, a above b as signed numbers. ``fps`` are distinct and stored."""
    total = fps.count()
    parts = partitions(fps, total)
    index = stored(index_rows(fps, parts).union(fps.select(F.lit(ALL_BITS).alias("part"), F.col("fp").alias("value"), "fp")), "index")
    sizes = stored(index.groupBy("part", "value").agg(F.count("*").alias("size"), F.min("fp").alias("one")), "sizes")
    # the probes that meet a fingerprint other than their own
    met = probes(fps, parts).join(sizes, ["part", "value"]).filter("size > 1 OR one <> of")
    met = stored(met.select("part", "value", "of", "size"), "met")
    heavy = met.groupBy("of").agg(F.sum("size").alias("met")).filter(F.col("met") > MOST).select(F.col("of").alias("fp"))
    heavy = stored(heavy, "heavy")

    def by_all_bits(batches):
        for values in values_of(batches):
            yield from around(ALL_BITS, values, values, 64, RADIUS)

    again = heavy.mapInArrow(by_all_bits, "part int, value long, of long")
    light = met.join(heavy, met["of"] == heavy["fp"], "left_anti").select("part", "value", "of")
    found = light.union(again).join(index, ["part", "value"])
    found = found.filter((F.col("fp") < F.col("of")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("of"))) <= RADIUS))
    return found.select(F.col("of").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id: the smallest doc_id reachable over links, of each row."""
    rows = stored(fingerprints(documents), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    placed = stored(fps.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    names = stored(placed.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = stored(placed.select("fp", "root").join(names, "root").select("fp", "component_id"), "components")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(named, "fp").select("doc_id", digits, "component_id")

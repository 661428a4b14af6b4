"""N-gram Jaccard join by MinHash banding.

1. Each text becomes the set of its runs of ``GRAM`` words (64-bit hashes; a text of fewer
   words is one run). Texts with equal sets are one class, named by its
   smallest doc_id, however many copies it has.
2. ``BANDS`` bands of ``ROWS`` MinHash values each: two sets of similarity ``SIMILARITY`` share a
   band with probability 1 - (1 - s^ROWS)^BANDS, 0.9977 for the values here. Band
   hashes are shuffled; each class is linked to the least one with the same band hash,
   which is one edge a band, not all pairs. Connected components of these edges
   hold all candidate pairs.
3. Components are divided by hash into tiles of about ``TILE`` classes, and each pair of tiles is one
   group by itself; components of one tile share groups. Texts meet in them and pairs are verified on their full sets. A group gives the
   number of links of each class and a spanning forest of its links, never the pairs. All
   pairs of a tile pair are verified, so pairs that share no band but whose component does count as well.

The result has a row per document: class_id, n_copies (documents of the class), n_links (other classes
with similarity of SIMILARITY or more) and group_id, the smallest doc_id among
documents connected by links. Words are runs without ASCII white space, unchanged. Null
texts, and those of white space, have the empty set: one class without links. Null
doc_ids are kept and never name a class that has others. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import WordHashes, gram_hashes, map_batches, pieces, row_key, stored, texts_of
from fieldtally.llm.graph import components

GRAM, SIMILARITY, BANDS, ROWS, TILE = 5, 0.8, 20, 6, 500
COLUMNS = 8192  # n-grams a step of the verification takes at once

_random = np.random.default_rng(20)
FACTORS = _random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def gram_set(text: str, hashes: WordHashes) -> np.ndarray:
    """The sorted hashes of the runs of words of a text."""
    words = hashes.of(text.encode().split())
    if 0 < len(words) < GRAM:
        return gram_hashes(words, len(words))
    return np.unique(gram_hashes(words, GRAM))


def band_hashes(grams: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(grams), 2048):
        part = grams[at : at + 2048, None] * FACTORS[None, :] + SHIFTS[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    bands = least.reshape(BANDS, ROWS)
    return gram_hashes_by_row(bands)


def gram_hashes_by_row(bands: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = (out ^ (bands[:, i] >> np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15) + bands[:, i]
    return out ^ (out >> np.uint64(31))


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, key, same (equal for equal sets) and bands (none for the empty set), of each row."""

    def make():
        hashes = WordHashes()

        def f(batch):
            same, bands = [], []
            for text in texts_of(batch):
                grams = gram_set(text, hashes)
                same.append(xxhash.xxh3_128_hexdigest(grams.tobytes()))
                bands.append(band_hashes(grams).view(np.int64) if len(grams) else None)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(same, pa.string()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "key", "same", "bands"],
            )

        return f

    kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(documents).alias("key"), "text")
    return map_batches(kept, make, "doc_id long, key string, same string, bands array<long>")


def candidate_edges(classes: DataFrame) -> DataFrame:
    """a, b: each class with the least class that has the same hash in a band."""
    bands = classes.select("same", F.explode("bands").alias("band"))
    # written, as the other aggregates below: the join's sides are then plain exchanges, which Spark splits at a hot key
    least = bands.groupBy("band").agg(F.min("same").alias("least"), F.max("same").alias("most")).filter("least < most")
    least = stored(least, "least-of-bands")
    return bands.join(least, "band").filter("same > least").select(F.col("same").alias("a"), F.col("least").alias("b")).distinct()


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float = SIMILARITY):
    """Pairs (i, j), i of ``left`` and j of ``right``, whose sets have the similarity. Counts common n-grams by products of 0/1 blocks."""
    sizes = np.array([len(s) for s in sets], np.float64)
    grams = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    _, column, counts = np.unique(grams, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    names, column = np.unique(column[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(left), len(right)), np.float32)
    at_left = np.full(len(sets), -1)
    at_left[left] = np.arange(len(left))
    at_right = np.full(len(sets), -1)
    at_right[right] = np.arange(len(right))
    for low in range(0, len(names), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        own, col = owner[a:b], column[a:b] - low
        width = min(COLUMNS, len(names) - low)
        x = np.zeros((len(left), width), np.float32)
        y = np.zeros((len(right), width), np.float32)
        use = at_left[own] >= 0
        x[at_left[own[use]], col[use]] = 1
        use = at_right[own] >= 0
        y[at_right[own[use]], col[use]] = 1
        common += x @ y.T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    i, j = np.nonzero(common >= similarity * union - 1e-6)
    return left[i], right[j]


def verified(group: pa.Table) -> pa.Table:
    """same, n_links and forest: for each class its links in this group, and one class it is connected with."""
    hashes = WordHashes()
    columns = ("root", "low", "high", "same", "tile", "text")
    rows = sorted(zip(*(group.column(c).to_pylist() for c in columns)))
    out: list[tuple[str, int, str]] = []
    for (_, low, high), part in groupby(rows, key=lambda r: r[:3]):
        own = list(part)
        sets = [gram_set(r[5] or "", hashes) for r in own]
        tiles = np.array([r[4] for r in own])
        i, j = linked(sets, np.flatnonzero(tiles == low), np.flatnonzero(tiles == high))
        if low == high:
            i, j = i[i < j], j[i < j]
        links = np.bincount(i, minlength=len(own)) + np.bincount(j, minlength=len(own))
        parent = list(range(len(own)))
        for a, b in zip(i.tolist(), j.tolist()):
            a, b = find(parent, a), find(parent, b)
            parent[max(a, b)] = min(a, b)
        out += [(own[k][3], int(links[k]), own[find(parent, k)][3]) for k in np.flatnonzero(links).tolist()]
    values = list(zip(*out)) or [()] * 3
    kinds = [pa.string(), pa.int64(), pa.string()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(values, kinds)], ["same", "n_links", "forest"])


def find(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def meetings(placed: DataFrame, groups: int) -> DataFrame:
    """The rows of ``placed`` once for each pair of tiles they meet in, with tile, low, high and group.

    A pair of tiles of a larger component has group -1 and is told by the root, low and high. Components of one
    tile are hashed into ``groups``."""
    met = placed.withColumn("tile", F.pmod(F.xxhash64("same"), "tiles").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    alone = F.col("tiles") == 1
    group = F.when(alone, F.pmod(F.xxhash64("root"), F.lit(groups))).otherwise(-1)
    return met.select("*", group.alias("group"), F.when(~alone, F.col("root")).alias("of")).drop("other", "tiles")


def links_of(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """same, n_links, forest: a row or more for each class that has links."""
    classes = rows.filter(F.col("bands").isNotNull()).groupBy("same").agg(F.first("bands").alias("bands"), F.min("key").alias("key"))
    members = components(candidate_edges(classes))
    tiles = F.ceil(F.count("*") / TILE).cast("int").alias("tiles")
    sizes = stored(members.groupBy("root").agg(tiles), "component-sizes")
    placed = members.join(sizes, "root").withColumnRenamed("node", "same")
    placed = stored(placed.join(classes.select("same", "key"), "same"), "members")
    # one text stands for each class; which one does not matter, as their sets are equal
    texts = documents.select(row_key(documents).alias("key"), "text")
    met = placed.join(texts, "key").dropDuplicates(["same"])
    met = meetings(met, max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() // TILE)))
    met = met.select("group", "of", "root", "low", "high", "same", "tile", "text")
    return met.groupBy("group", "of", "low", "high").applyInArrow(verified, "same string, n_links long, forest string")


LAST = (1 << 63) - 1


def grouped(documents: DataFrame) -> DataFrame:
    """doc_id, key, class_id, n_copies, n_links, group_id, and group_key: the key of the row that stands for the group."""
    rows = stored(signatures(documents), "signatures")
    links = stored(links_of(documents, rows), "links")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "key"))
    classes = rows.groupBy("same").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"), first.alias("first"))
    roots = components(links.select(F.col("same").alias("a"), F.col("forest").alias("b"))).withColumnRenamed("node", "same")
    totals = links.groupBy("same").agg(F.sum("n_links").alias("n_links"))
    classes = classes.join(totals, "same", "left").join(roots, "same", "left")
    classes = stored(classes.withColumn("root", F.coalesce("root", "same")), "classes")
    groups = stored(classes.groupBy("root").agg(F.min("first").alias("of_group")), "groups")
    classes = classes.join(groups, "root").select(
        "same", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("of_group.doc_id") != LAST, F.col("of_group.doc_id")).alias("group_id"),
        F.col("of_group.key").alias("group_key"),
    )
    return rows.select("doc_id", "key", "same").join(classes, "same").drop("same")


def joined(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, n_copies, n_links, group_id of each row."""
    return grouped(documents).drop("key", "group_key")


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows that stand for their groups, with all their columns; of rows equal in doc_id and text one stays."""
    kept = grouped(documents).select(F.col("group_key").alias("key")).distinct()
    keyed = documents.select(row_key(documents).alias("key"), F.struct("*").alias("row"))

    def first_in_task(batches):
        seen: set[int] = set()
        for batch in pieces(batches):
            new = []
            for key in batch.column("key").to_pylist():
                mark = xxhash.xxh3_64_intdigest(key)
                new.append(mark not in seen)
                seen.add(mark)
            yield batch.filter(pa.array(new, pa.bool_()))

    # copies of a row within a task go before the shuffle
    once = keyed.mapInArrow(first_in_task, keyed.schema)
    return once.join(kept, "key").dropDuplicates(["key"]).select("row.*")

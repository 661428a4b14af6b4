"""Alignment of two tokenizers over the same text.

A text is encoded by a byte-level BPE (A) and by a piece model with byte fallback (B). Both token
lists cut the same bytes, so each has an ascending list of byte offsets where its tokens end.

1. The shorter end list is searched for in the longer one by galloping: each search starts where the
   one before ended, doubles its step until it is past the end and then halves the range. Lists are cut into lanes of
   ``LANE`` ends that gallop side by side.
2. Offsets in both lists cut the tokens into groups. Where consecutive searches ended tells the range of
   tokens that overlap each token: their difference in rank is its number of links.
3. A link is a pair of an A and a B token that overlap. How many documents hold an id pair is counted over the
   whole corpus: documents go in packs (``PACK_ROWS``, ``PACK_BYTES``), each pack tells every pair once,
   Spark sums them up, and the sums that a pack needs return to it by a join. Neither the counts nor the vocabularies'
   product is sent to every task.

Null and empty texts, and those that either tokenizer does not give back byte by byte after a leading
space, have no tokens. Repeated rows count as documents each, also rows without doc_id. An empty
table gives an empty result. Other columns are left out. A text is encoded in whole however long it is,
in one task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import list_array, stored, texts_of

LANE = 64
PACK_ROWS, PACK_BYTES = 512, 2_000_000
LIBRARY_BYTES = 1_000_000  # of texts that a library is given at once, or one text


#: Texts not to be cut at spaces: white space after a space, one at the end, and what stands for a space in pieces.
_ODD = re.compile(r" \s| \Z|▁").search
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
REMEMBERED = 200_000


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and ids as text. Remembers the ids of up to twice REMEMBERED parts of texts."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            config = json.load(f)
        vocabulary = config["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            if all(c in byte_of for c in token):
                self.a_bytes[i] = bytes(byte_of[c] for c in token)
        self.b_bytes = [self.piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}  # ids of parts by A and by B
        self.older, self.not_whole = self.known, set()
        # no token of either reaches from other text over a space, so texts can be cut before single spaces that text follows
        crossed = any(re.search(".▁", self.b.id_to_piece(i).lstrip("▁")) for i in range(self.b.get_piece_size()))
        self.uncut = _ODD if not crossed and config.get("pre_tokenizer") == BYTE_LEVEL and not config.get("normalizer") else len

    def piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(re.fullmatch("<0x(..)>", piece)[1], 16)])
        return piece.replace("▁", " ").encode()

    @cached_property
    def written(self) -> list[bytes]:
        """Each id as decimal digits, followed by each of the three separators of the groups' text."""
        return [b"%d%c" % (i, c) for i in range(max(len(self.a_bytes), len(self.b_bytes))) for c in b",|;"]

    def library(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids by A and by B of each text as 32-bit numbers; none of both where they don't give back the text."""
        a = [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        out = []
        for text, x, y in zip(texts, a, self.b.encode(texts, num_threads=1)):
            raw = b" " + text.encode()
            whole = text and b"".join(map(self.a_bytes.__getitem__, x)) == raw == b"".join(map(self.b_bytes.__getitem__, y))
            out.append((np.array(x, "<i4").tobytes(), np.array(y, "<i4").tobytes()) if whole else (b"", b""))
        return out

    def learn(self, new: list[str]) -> None:
        """Ask for many parts in one text, which is much faster; the bytes they take part the ids again."""
        for at in range(0, len(new), 2000):
            parts = new[at : at + 2000]
            ends = np.cumsum([len(p.encode()) + 1 for p in parts])
            for raw, sizes, known in zip(self.library([" ".join(parts)])[0], (self.a_sizes, self.b_sizes), self.known):
                own = np.cumsum(sizes[np.frombuffer(raw, "<i4")])
                stop = np.searchsorted(own, ends) + 1
                if not len(own) or stop[-1] > len(own) or (own[stop - 1] != ends).any():
                    self.apart(parts)
                    break
                stop = (4 * stop).tolist()
                known.update(zip(parts, [raw[s:e] for s, e in zip([0, *stop], stop)]))

    def apart(self, parts: list[str]) -> None:
        """Ask for each part by itself; texts with those that are not given back go to the library."""
        for part, ids in zip(parts, self.library(parts)):
            for known, own in zip(self.known, ids):
                known[part] = own
            if not ids[0]:
                self.not_whole.add(part)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """As ``library``, remembering the ids of the parts of texts between single spaces."""
        cut = [None if not t or self.uncut(" " + t) else t.split(" ") for t in texts]
        asked = set().union(*(parts for parts in cut if parts))
        if len(self.known[0]) >= REMEMBERED:  # what was asked for since the last time stays
            self.older, self.known, self.not_whole = self.known, ({}, {}), set()
        new = asked.difference(self.known[0])
        for part in new & self.older[0].keys():
            if self.older[0][part]:
                for known, older in zip(self.known, self.older):
                    known[part] = older[part]
                new.discard(part)
        self.learn(list(new))
        a, b = (known.__getitem__ for known in self.known)
        return [
            (b"".join(map(a, parts)), b"".join(map(b, parts))) if parts and self.not_whole.isdisjoint(parts) else self.library([text])[0]
            for text, parts in zip(texts, cut)
        ]


@lru_cache(maxsize=1)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """Loaded once per worker."""
    return Vocabularies(a_path, b_path)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if visible, else the next from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(moved)) for b in range(256)]


def gallop(ends: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key the first place from ``at`` on whose end is not below it. There is one, and none before ``at``."""
    last, step = len(ends) - 1, 1
    low, high = at - 1, at.copy()
    far = np.flatnonzero(ends[high] < keys)
    while len(far):
        low[far] = high[far]
        high[far] = np.minimum(high[far] + step, last)
        far = far[ends[high[far]] < keys[far]]
        step *= 2
    wide = np.flatnonzero(high - low > 1)
    while len(wide):
        middle = (low[wide] + high[wide]) >> 1
        below = ends[middle] < keys[wide]
        low[wide] = np.where(below, middle, low[wide])
        high[wide] = np.where(below, high[wide], middle)
        wide = wide[high[wide] - low[wide] > 1]
    return high


def places(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The first place in ``long`` that is not below each end of ``short``; both ascend to the same last end."""
    lanes = -(-len(short) // LANE)
    keys = np.full(lanes * LANE, short[-1])
    keys[: len(short)] = short
    keys = keys.reshape(lanes, LANE)
    found = np.empty_like(keys)
    at = np.zeros(lanes, np.int64)
    for k in range(LANE):
        found[:, k] = at = gallop(long, at, keys[:, k])
    return found.ravel()[: len(short)]


@dataclass
class Aligned:
    """Tokens of some documents: document, group and ids of each token, and links as places of tokens."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_of: np.ndarray
    b_of: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def intersect(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of each token of both lists, by common ends, and the links as two arrays of places."""
    place = places(short, long)
    common = long[place] == short
    first = np.concatenate([[0], place[:-1] + common[:-1]])
    count = place - first + 1  # the difference in rank
    left = np.repeat(np.arange(len(short)), count)
    right = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
    cut = np.zeros(len(long), np.int64)
    cut[place[common]] = 1
    return np.cumsum(common) - common, np.cumsum(cut) - cut, left, right


def align(ids: list[tuple[bytes, bytes]], own: Vocabularies) -> Aligned:
    """Align documents given by their ids, all at once: their offsets follow one another."""
    n_a, n_b = (np.array([len(x[k]) // 4 for x in ids], np.int64) for k in (0, 1))
    flat = [np.frombuffer(b"".join(x[k] for x in ids), "<i4").astype(np.int64) for k in (0, 1)]
    of = [np.repeat(np.arange(len(n)), n) for n in (n_a, n_b)]
    ends = [np.cumsum(own.a_sizes[flat[0]]), np.cumsum(own.b_sizes[flat[1]])]
    group = [np.zeros(len(x), np.int64) for x in flat]
    links: list[list[np.ndarray]] = [[], []]
    before = 0
    for short, long, docs in ((0, 1, n_a <= n_b), (1, 0, n_a > n_b)):  # the shorter list of each document drives
        use = [np.flatnonzero(docs[x]) for x in of]
        if not len(use[0]):
            continue
        # offsets of the documents left out are closed up, so that the lists ascend to the same end
        own_ends = [np.cumsum(np.diff(ends[s], prepend=0)[use[s]]) for s in (0, 1)]
        found = intersect(own_ends[short], own_ends[long])
        group[short][use[short]], group[long][use[long]] = found[0] + before, found[1] + before
        links[short].append(use[short][found[2]])
        links[long].append(use[long][found[3]])
        before += int(found[0][-1]) + 1
    none = [np.empty(0, np.int64)]
    return Aligned(*flat, *group, *of, np.concatenate(links[0] or none), np.concatenate(links[1] or none))


def group_texts(x: Aligned, documents: int, own: Vocabularies) -> list[bytes]:
    """The groups of each document in the form ``a1,a2|b1;a3|b2,b3``."""
    merged = np.empty(len(x.a) + len(x.b), np.int64)
    # groups are numbered by parts of the documents: order them as the documents are
    order, a_group = np.unique(x.a_of * (len(x.a) + 1) + x.a_group, return_inverse=True)
    b_group = np.searchsorted(order, x.b_of * (len(x.a) + 1) + x.b_group)
    in_a, in_b = np.bincount(a_group, minlength=len(order)), np.bincount(b_group, minlength=len(order))
    a_ends = np.append(np.diff(a_group) > 0, True)[: len(x.a)]
    b_ends = np.append(np.diff(b_group) > 0, True)[: len(x.b)]
    merged[np.arange(len(x.a)) + (np.cumsum(in_b) - in_b)[a_group]] = x.a * 3 + a_ends
    merged[np.arange(len(x.b)) + np.cumsum(in_a)[b_group]] = x.b * 3 + 2 * b_ends
    get = own.written.__getitem__
    ends = np.cumsum(np.bincount(x.a_of, minlength=documents) + np.bincount(x.b_of, minlength=documents))
    return [b"".join(map(get, merged[s:e].tolist()))[:-1] for s, e in zip([0, *ends.tolist()], ends.tolist())]


def batches_of(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of at most so many rows and, if more than one row, bytes of text."""
    sizes = pc.binary_length(batch.column("text")).to_pylist()
    start = total = 0
    for at, n in enumerate(n or 0 for n in sizes):
        if at > start and (at - start >= rows or total + n > size):
            yield batch.slice(start, at - start)
            start, total = at, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def encoded(batch: pa.RecordBatch, own: Vocabularies) -> list[tuple[bytes, bytes]]:
    return [ids for part in batches_of(batch, PACK_ROWS, LIBRARY_BYTES) for ids in own.encode(texts_of(part))]


def aligned(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The alignment itself: doc_id, ids by A and B, and of each group how many tokens of A and B come up to its end."""

    def run(batches):
        own = vocabularies(a_path, b_path)
        for batch in (part for whole in batches for part in batches_of(whole, PACK_ROWS, PACK_BYTES)):
            x = align(encoded(batch, own), own)
            rows, cuts = batch.num_rows, []
            for of, group in ((x.a_of, x.a_group), (x.b_of, x.b_group)):
                last = np.append(np.diff(group) != 0, True)[: len(group)] | np.append(np.diff(of) != 0, True)[: len(of)]
                place = np.arange(len(of)) - np.searchsorted(of, of) + 1
                cuts.append(list_array(place[last].astype(np.int32), np.bincount(of[last], minlength=rows), pa.int32()))
            ids = [list_array(i.astype(np.int32), np.bincount(of, minlength=rows), pa.int32()) for i, of in ((x.a, x.a_of), (x.b, x.b_of))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *ids, *cuts], ["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    schema = "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


PACK = (
    "pack long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>,"
    " groups_sha256 array<string>, codes array<long>, holders array<long>, sizes array<int>, numbers array<int>, times array<int>"
)


def packed(batch: pa.RecordBatch, own: Vocabularies, pack: int) -> dict:
    """A row of PACK: per document its counts, its distinct id pairs by number in ``codes`` and how often each is linked."""
    n, x = batch.num_rows, align(encoded(batch, own), own)
    digests = [hashlib.sha256(t).hexdigest() if t else "" for t in group_texts(x, n, own)]
    codes, number = np.unique((x.a[x.link_a] << 32) | x.b[x.link_b], return_inverse=True)
    pairs, times = np.unique(x.a_of[x.link_a] * max(1, len(codes)) + number, return_counts=True)
    number, of = pairs % max(1, len(codes)), pairs // max(1, len(codes))
    groups = np.unique(x.a_of * (len(x.a) + 1) + x.a_group) // (len(x.a) + 1)
    return {
        "pack": pack, "doc_ids": batch.column("doc_id").to_pylist(),
        "n_a": np.bincount(x.a_of, minlength=n), "n_b": np.bincount(x.b_of, minlength=n),
        "n_groups": np.bincount(groups, minlength=n), "n_links": np.bincount(x.a_of[x.link_a], minlength=n),
        "groups_sha256": digests, "codes": codes, "holders": np.bincount(number, minlength=len(codes)),
        "sizes": np.bincount(of, minlength=n), "numbers": number, "times": times,
    }


def packs(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    kinds = {f.name: f.type for f in pa_schema()}

    def run(batches):
        own, pack = vocabularies(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in (part for whole in batches for part in batches_of(whole, PACK_ROWS, PACK_BYTES)):
            row = packed(batch, own, pack)
            pack += 1
            yield pa.RecordBatch.from_arrays([pa.array([row[c]], k) for c, k in kinds.items()], list(kinds))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PACK)


def pa_schema() -> pa.Schema:
    """PACK as an Arrow schema."""
    kind = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    columns = [c.split() for c in PACK.split(", ")]
    return pa.schema([(n, pa.list_(kind[t[6:-1]]) if t.startswith("array") else kind[t]) for n, t in columns])


def pair_counts(packed_rows: DataFrame) -> DataFrame:
    """code (id of A in the upper, of B in the lower 32 bits), n: documents that hold it linked, best: no pair of this A id has more."""
    pairs = packed_rows.select(F.explode(F.arrays_zip("codes", "holders")).alias("p"))
    counts = pairs.groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.holders").alias("n"))
    counts = stored(counts.withColumn("a", F.shiftright("code", 32)), "pair-counts")
    most = stored(counts.groupBy("a").agg(F.max("n").alias("most")), "most-linked")
    return stored(counts.join(most, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def summed(pack: pa.Table, known: pa.Table) -> pa.Table:
    """The report of the documents of one pack, given the counts of its id pairs."""
    if not pack.num_rows:
        raise ValueError("counts without their pack")
    row = {c: pack.column(c)[0].values for c in pack.column_names if c != "pack"}
    order = np.argsort(known.column("code").to_numpy())
    n, best = (known.column(c).to_numpy()[order].astype(np.int64) for c in ("n", "best"))
    number, times, sizes = (row[c].to_numpy().astype(np.int64) for c in ("numbers", "times", "sizes"))
    ends = np.cumsum(sizes)

    def by_document(values: np.ndarray) -> pa.Array:
        total = np.concatenate([[0], np.cumsum(values)])
        return pa.array(total[ends] - total[ends - sizes])

    names = ["doc_ids", "n_a", "n_b", "n_groups", "n_links"]
    columns = [*(row[c] for c in names), by_document(times * best[number]), by_document(times * n[number]), row["groups_sha256"]]
    return pa.Table.from_arrays(columns, [c.split()[0] for c in REPORT.split(", ")])


def report(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row.

    n_best: links whose id pair is held by as many documents as any pair of its A id; count_sum: documents that hold the
    pair, summed over links.
    """
    rows = stored(packs(documents, a_path, b_path), "packs")
    # a pack names each pair once, however many of its documents hold it
    wanted = rows.select(F.col("pack").alias("of"), F.explode("codes").alias("code"))
    known = wanted.join(pair_counts(rows), "code").select("of", "code", "n", "best")
    return rows.groupBy("pack").cogroup(known.groupBy("of")).applyInArrow(summed, REPORT)

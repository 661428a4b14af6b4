"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash resolves pre-tokens that are in the
vocabulary as a whole; the others are merged with a heap over a linked list of
their bytes. The work is one map over whole texts. The only thing sent out is
the vocabulary, whose size is that of its file.

Null text counts as empty: no ids. Repeated rows are encoded each. An empty
table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from array import array

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import list_array, map_batches, texts_of


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for text, rank in pairs:
        tokens[int(rank)] = base64.b64decode(text)
    return tokens


class PerfectHash:
    """Minimal perfect hash by displacement: as many slots as keys, one probe and one comparison per lookup.

    Keys fall into buckets; from the largest bucket on, each looks for the first
    displacement that puts its keys on free slots. Buckets of one key take a
    free slot directly, written as a negative displacement.
    """

    def __init__(self, keys: list[bytes], load: int = 4) -> None:
        n = len(keys)
        self.n, self.buckets = n, max(1, n // load)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) != n:
            raise ValueError("keys must differ")
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        shift = [0] * self.buckets
        slots = [-1] * n
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        singles = [b for b in order if len(members[b]) == 1]
        for b in order:
            if len(members[b]) < 2:
                break
            d = 0
            while True:
                where = [self.slot(hashes[i], d) for i in members[b]]
                if len(set(where)) == len(where) and all(slots[s] < 0 for s in where):
                    break
                d += 1
            shift[b] = d
            for s, i in zip(where, members[b]):
                slots[s] = i
        free = (s for s in range(n) if slots[s] < 0)
        for b, s in zip(singles, list(free)):
            shift[b] = -s - 1
            slots[s] = members[b][0]
        self.shift, self.slots = array("q", shift), array("q", slots)
        self.keys = [keys[i] for i in slots]

    def slot(self, h: int, d: int) -> int:
        x = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x >> 30) % self.n

    def find(self, key: bytes) -> int:
        """Index of the key, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self.slot(h, d)
        return self.slots[s] if self.keys[s] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: merge the pair of lowest rank, leftmost first, until none is left.

    A heap entry is one number: rank, start and end of the pair from high to low
    bits. An entry is stale if its start was merged away or the pair ends elsewhere now.
    """
    n = len(piece)
    bits = n.bit_length()
    low = (1 << bits) - 1
    get = ranks.get
    heap = []
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            heap.append((((r << bits) | i) << bits) | (i + 2))
    heapq.heapify(heap)
    end = list(range(1, n + 2))  # where the part that starts here ends, and the next one starts; 0: merged away
    before = list(range(-1, n))
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        x = pop(heap)
        stop, i = x & low, (x >> bits) & low
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[middle] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
            r = get(piece[i : end[stop]])
            if r is not None:
                push(heap, (((r << bits) | i) << bits) | end[stop])
        j = before[i]
        if j >= 0:
            r = get(piece[j:stop])
            if r is not None:
                push(heap, (((r << bits) | j) << bits) | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec(dict):
    """Encoder and decoder. As a dict it remembers ids of pre-tokens, and forgets all when full."""

    def __init__(self, tokens: list[bytes], hashed: PerfectHash, pattern: str, limit: int = 700_000) -> None:
        self.tokens, self.hashed, self.limit = tokens, hashed, limit
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.split = regex.compile(pattern).findall

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        piece = word.encode()
        found = self.hashed.find(piece)
        ids = array("I", [found] if found >= 0 else merge(piece, self.ranks)).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


IN_WORKER: dict[str, Codec] = {}


def codec_maker(df: DataFrame, path: str, pattern: str):
    """A function that gives a task its codec. The hash is built once, here."""
    tokens = read_ranks(path)
    sent = df.sparkSession.sparkContext.broadcast((tokens, PerfectHash(tokens)))
    name = uuid.uuid4().hex

    def make() -> Codec:
        if name not in IN_WORKER:  # tasks that share a Python worker share what it remembers
            IN_WORKER.clear()
            IN_WORKER[name] = Codec(*sent.value, pattern)
        return IN_WORKER[name]

    return make


def id_lists(coded: list[bytes]) -> pa.ListArray:
    flat = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
    return list_array(flat, [len(c) // 4 for c in coded], pa.int32())


def encode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of each text."""
    maker = codec_maker(df, path, pattern)

    def make():
        codec = maker()

        def f(batch):
            coded = [codec.encode(t) for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), id_lists(coded)], ["doc_id", "ids"])

        return f

    return map_batches(df.select("doc_id", "text"), make, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the text of ids. Bytes that are no UTF-8 (of cut id lists) become U+FFFD; null ids give empty text."""
    maker = codec_maker(df, path, pattern)

    def make():
        codec = maker()

        def f(batch):
            texts = [
                codec.decode(np.asarray(i or [], "<u4").tobytes()).decode(errors="replace")
                for i in batch.column("ids").to_pylist()
            ]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"]
            )

        return f

    return map_batches(df.select("doc_id", "ids"), make, "doc_id long, text string", 128)


def round_trip(df: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids: encode each text and decode its ids."""
    maker = codec_maker(df, path, pattern)

    def make():
        codec = maker()
        digest = hashlib.sha256

        def f(batch):
            coded = [codec.encode(t) for t in texts_of(batch)]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(c) // 4 for c in coded], pa.int64()),
                "ids_sha256": pa.array([digest(c).hexdigest() for c in coded], pa.string()),
                "decoded_sha256": pa.array([digest(codec.decode(c)).hexdigest() for c in coded], pa.string()),
            }
            if with_ids:
                columns["ids"] = id_lists(coded)
            return pa.RecordBatch.from_pydict(columns)

        return f

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_batches(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema)

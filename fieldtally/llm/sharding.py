"""Shuffle and shard by a Feistel permutation of global row numbers.

Every row gets a number from 0 to N-1 that depends on the rows alone, not on
files or partitions: equal rows are counted, each distinct row falls by its hash into
one of ``BUCKETS`` buckets, and its number is that of the bucket's first row plus
its place within the bucket. Copies of a row, however many, are one row until
the end, so none of this gathers a hot group.

The number is then permuted on 0 to N-1. The permutation works on pairs
(left, right) with left < a, right < b and a*b just above N: six rounds add
to one half a hash of the other half and the key. Results beyond N-1 are permuted
again (cycle walking); that ends, as they are fewer than a. With position p, the
shard is p mod shards and the slot is p div shards: counts differ by one
at most, slots have no gaps, and both follow from N, the key and the row number.

Rows that are equal in all columns given are interchangeable, null equals null,
and an empty table stays empty. Select the columns that matter before the call.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldtally.llm.common import stored

BUCKETS, ROUNDS, WALKS = 4096, 3, 64
CHUNK = 1_000_000


def numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows with a column ``row_number`` (0 to N-1, reproducible), and N."""
    columns = df.columns
    groups = df.groupBy(*[f"`{c}`" for c in columns]).agg(F.count("*").alias("_copies"))
    groups = groups.withColumn("_hash", F.xxhash64(*[f"`{c}`" for c in columns]))
    groups = stored(groups.withColumn("_bucket", F.pmod("_hash", F.lit(BUCKETS)).cast("int")), "row-groups")
    sizes = groups.groupBy("_bucket").agg(F.sum("_copies").alias("_n"))
    whole = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)  # over at most BUCKETS rows
    firsts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_first"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    order = [F.col("_hash"), *[F.col(f"`{c}`") for c in columns]]
    within = W.partitionBy("_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = groups.withColumn("_place", F.coalesce(F.sum("_copies").over(within), F.lit(0)))
    placed = placed.join(F.broadcast(firsts), "_bucket")  # at most BUCKETS rows
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / CHUNK).cast("long")))
    copy = F.explode(
        F.sequence(F.col("_chunk") * CHUNK, F.least(F.col("_chunk") * CHUNK + CHUNK, F.col("_copies")) - 1)
    )
    placed = placed.withColumn("_chunk", chunk).withColumn("_copy", copy)
    number = (F.col("_first") + F.col("_place") + F.col("_copy")).alias("row_number")
    return placed.select(*[f"`{c}`" for c in columns], number), int(total)


def permuted(number: Column, total: int, key: int) -> Column:
    """The place of a row number in the shuffle of 0 to total-1."""
    if total < 2:
        return number
    a = math.isqrt(total - 1) + 1
    b = -(-total // a)
    walks = min(a * b - total + 1, WALKS)  # beyond WALKS the odds are under 2**-300

    def round_of(halves: Column, i: Column) -> Column:
        left = F.pmod(halves["l"] + F.xxhash64(halves["r"], F.lit(key), i * 2), F.lit(a))
        right = F.pmod(halves["r"] + F.xxhash64(left, F.lit(key), i * 2 + 1), F.lit(b))
        return F.struct(left.alias("l"), right.alias("r"))

    def once(x: Column) -> Column:
        start = F.struct(F.pmod(x, F.lit(a)).alias("l"), ((x - F.pmod(x, F.lit(a))) / F.lit(a)).cast("long").alias("r"))
        rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
        return F.aggregate(rounds, start, round_of, lambda h: h["r"] * F.lit(a) + h["l"])

    first = once(number)
    if walks < 2:
        return first
    steps = F.sequence(F.lit(2), F.lit(walks))
    found = F.aggregate(steps, first, lambda x, _: F.when(x < total, x).otherwise(once(x)))
    return F.when(found < total, found).otherwise(F.raise_error(F.lit("cycle walk not ended")).cast("long"))


def shards(df: DataFrame, count: int, key: int = 0) -> DataFrame:
    """The rows with ``row_number``, ``position``, ``shard`` and ``slot``."""
    rows, total = numbered(df)
    placed = rows.withColumn("position", permuted(F.col("row_number"), total, key))
    return placed.withColumns(
        {
            "shard": F.pmod("position", F.lit(count)).cast("int"),
            "slot": F.floor(F.col("position") / count).cast("long"),
        }
    )

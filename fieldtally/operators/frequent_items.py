"""Exact most frequent values in bounded memory.

1. Each task keeps at most ``counters`` values with a count (Misra and Gries, the subtracting form of Space-Saving):
   where there are more, the count of the first one too many is taken off all of them. What a task has taken off is
   the most that any count of its is too low, for values it kept and for those it dropped.
2. Counts are added up over tasks. A value's true count is between that sum and the sum plus all that was taken off.
   Values whose upper bound reaches the k-th lower bound are candidates and are counted exactly.
3. No other value can belong to the first k if the k-th exact count is above what any of them can reach. That
   is checked; if it does not hold, counters are doubled, and from ``MOST_COUNTERS`` on all values are counted.

Neither pass shuffles the values: a task sends ``counters`` rows at most.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS, MOST_COUNTERS = 4096, 65536


def summaries(df: DataFrame, column: str, counters: int) -> DataFrame:
    """value, low (a lower bound of its count within the task) and, on a row without value, what the task has taken off."""

    def run(batches):
        counts: dict[str, int] = {}
        taken = 0
        for batch in batches:
            for pair in pc.value_counts(batch.column(0)).to_pylist():
                if pair["values"] is not None:
                    counts[pair["values"]] = counts.get(pair["values"], 0) + pair["counts"]
            if len(counts) > counters:
                cut = sorted(counts.values(), reverse=True)[counters]
                taken += cut
                counts = {v: n - cut for v, n in counts.items() if n > cut}
        values, lows = [None, *counts], [taken, *counts.values()]
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(lows, pa.int64())], ["value", "low"])

    return df.select(F.col(column).cast("string").alias("value")).mapInArrow(run, "value string, low long")


def exact_top(df: DataFrame, column: str, k: int, counters: int = COUNTERS) -> DataFrame:
    """``column`` and ``occurrences`` of the ``k`` most frequent values (as text), ties by value; nulls do not count."""
    values = df.select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull())
    while counters <= MOST_COUNTERS:
        sums = summaries(df, column, counters).groupBy("value").agg(F.sum("low").alias("low"))
        # at most so many rows come here: those of the largest lower bounds, and the row without value
        taken = sums.where("value IS NULL").select("low").first()[0]
        ordered = sums.where("value IS NOT NULL").orderBy(F.desc("low"), "value")
        best = ordered.limit(counters + 1).collect()
        if len(best) < k and not taken:
            return _counted(values, column, [r.value for r in best], k)
        bar = best[k - 1].low if len(best) >= k else 0
        candidates = [r.value for r in best[:counters] if r.low + taken >= bar]
        # what a value that is no candidate can have at most
        rest = [r.low + taken for r in best[:counters] if r.low + taken < bar] + [r.low + taken for r in best[counters:]] + [taken]
        found = _counted(values, column, candidates, k)
        counted = found.collect()
        if len(counted) == k and counted[-1].occurrences > max(rest):
            return df.sparkSession.createDataFrame(counted, found.schema)
        counters *= 2
    counts = values.groupBy(column).agg(F.count("*").alias("occurrences"))
    return counts.orderBy(F.desc("occurrences"), column).limit(k)


def _counted(values: DataFrame, column: str, candidates: list[str], k: int) -> DataFrame:
    counts = values.where(F.col(column).isin(candidates)).groupBy(column).agg(F.count("*").alias("occurrences"))
    return counts.orderBy(F.desc("occurrences"), column).limit(k)

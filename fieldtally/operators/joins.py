"""Enrichment joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(facts: DataFrame, lookup: DataFrame, on: str | list[str], spread: int = 1) -> DataFrame:
    """Left join with a lookup table that has at most one row per key.

    No hint is given: Spark broadcasts the lookup when its measured size allows
    it, and otherwise shuffles both sides with skew splitting at run time.
    ``spread`` > 1 is for plans where a hot key cannot be split at run time
    (an aggregation on the same key follows): the lookup is repeated ``spread``
    times and each fact row meets one of the copies. The copy is chosen from the
    row's content and its partition, so a task that runs again chooses the same.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if spread <= 1:
        return facts.join(lookup, keys, "left")
    copy = F.pmod(F.hash(*facts.columns) + F.spark_partition_id(), F.lit(spread))
    copies = lookup.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return facts.withColumn("_copy", copy).join(copies, [*keys, "_copy"], "left").drop("_copy")

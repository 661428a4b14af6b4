"""Distinct counts that add up: stored sketches per key and day, united over any span.

A sketch (HyperLogLog of 2**``lg`` registers) has a fixed size, whatever it counts, and sketches of parts
unite to that of the whole. So counts over weeks, regions or seasons read one small row per key and day
in place of the records. The standard error of an estimate is ``standard_error``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG = 12


def standard_error(lg: int = LG) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / 2 ** (lg / 2)


def distinct_sketches(df: DataFrame, keys: list[str], value: str, lg: int = LG) -> DataFrame:
    """One row per group of ``keys`` with the ``sketch`` of its values; nulls are no values. Combined on the map side."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, F.lit(lg)).alias("sketch"))


def distinct_over(sketches: DataFrame, keys: list[str], name: str = "n_distinct") -> DataFrame:
    """Estimated distinct values per group of ``keys`` (of all, without keys), over all sketches of the group."""
    united = F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(False))).alias(name)
    return sketches.groupBy(*keys).agg(united) if keys else sketches.agg(united)


def refreshed(sketches: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Stored sketches united with those of further records: a late record changes one small row."""
    return sketches.unionByName(more).groupBy(*keys).agg(F.hll_union_agg("sketch", F.lit(False)).alias("sketch"))


def between(sketches: DataFrame, first: date, last: date, date_col: str = "date") -> DataFrame:
    """Those of an inclusive span of days."""
    return sketches.where(F.col(date_col).between(F.lit(first), F.lit(last)))

"""Costly columns that later steps use more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns whose expressions are evaluated exactly once per row.

    A filter on a projected column is pushed below the projection with a copy of
    the column's expression for every mention of it, which multiplies the cost of
    a parser; exploding an expression adds such a filter by itself. A generator is
    not copied: here it yields one row for each row.
    """
    one = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], one)

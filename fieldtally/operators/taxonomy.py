"""Rule-based record filtering with reasons, statistics and audit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import RuleSet


def _caption(df: DataFrame, column: str | None) -> Column | None:
    return F.col(column) if column and column in df.columns else None


def keep_column(
    df: DataFrame, rules: RuleSet, species_col: str = "first_species", caption_col: str | None = "full_caption"
) -> Column:
    return rules.keep(F.col(species_col), _caption(df, caption_col))


def filter_by_rules(
    df: DataFrame,
    rules: RuleSet,
    species_col: str = "first_species",
    caption_col: str | None = "full_caption",
    missing: str = "keep",
) -> DataFrame:
    """Rows the rules keep.

    Without the species column nothing changes, unless ``missing="error"``.
    """
    if species_col not in df.columns:
        if missing == "error":
            raise ValueError(f"no column {species_col!r}; there are {df.columns}")
        return df
    return df.where(keep_column(df, rules, species_col, caption_col))


def apply_rules(df: DataFrame, rules: RuleSet | None = None, species_col: str = "species") -> DataFrame:
    """Rows the rules keep, the caption taken from ``caption``, else ``description``.

    Without rules the default file is used; without that file, or without the
    species column, nothing changes.
    """
    if rules is None:
        try:
            rules = RuleSet.from_yaml()
        except FileNotFoundError:
            return df
    caption = next((c for c in ("caption", "description") if c in df.columns), None)
    return filter_by_rules(df, rules, species_col, caption)


def filter_audit(df: DataFrame, keep: Column) -> DataFrame:
    """One row: rows before, after and excluded, and the excluded share, in a single scan."""
    kept = F.count_if(keep)
    return df.agg(
        F.count("*").alias("rows_before"),
        kept.alias("rows_after"),
        (F.count("*") - kept).alias("rows_excluded"),
        F.try_divide((F.count("*") - kept).cast("double"), F.count("*")).alias("excluded_share"),
    )


def exclusion_stats(
    df: DataFrame,
    rules: RuleSet,
    species_col: str = "first_species",
    caption_col: str | None = "full_caption",
    date_col: str = "date",
) -> DataFrame:
    """Excluded species with count and reason, in no order: sort at the sink.

    A species is judged by a caption of its first date that has one (of any date
    without that column), there by the earliest keyword in the order of the rules. Date and
    keyword position are packed into one number whose least value is kept, so rows are
    combined by hash before the first exchange and no caption is shuffled.
    """
    schema = "species string, count bigint, exclusion_reason string"
    if species_col not in df.columns:
        return df.sparkSession.createDataFrame([], schema)
    caption = _caption(df, caption_col)
    span = len(rules.exclude_caption_keywords) + 1
    first = F.lit(None).cast("bigint")
    if caption is not None:
        day = F.unix_date(F.col(date_col).cast("date")).cast("bigint") if date_col in df.columns else F.lit(0)
        # records without a date come before all others
        day = F.coalesce(day, F.lit(-10_000_000))
        first = F.when(caption.isNotNull(), day * span + rules.first_keyword(caption))
    position = F.coalesce(F.pmod("first", F.lit(span)).cast("int"), F.lit(0))
    return (
        df.where(F.col(species_col).isNotNull())
        .select(F.col(species_col).alias("species"), first.alias("first"))
        .groupBy("species")
        .agg(F.count("*").alias("count"), F.min("first").alias("first"))
        .select("species", "count", rules.reason_for(F.col("species"), position).alias("exclusion_reason"))
        .where(F.col("exclusion_reason").isNotNull())
    )


def exclusion_stats_by_row(
    df: DataFrame, rules: RuleSet, species_col: str = "first_species", caption_col: str | None = "full_caption"
) -> DataFrame:
    """Excluded rows per species and reason, each row judged by its own caption."""
    reason = rules.reason(F.col(species_col), _caption(df, caption_col))
    return (
        df.select(F.col(species_col).alias("species"), reason.alias("exclusion_reason"))
        .where(F.col("exclusion_reason").isNotNull())
        .groupBy("species", "exclusion_reason")
        .agg(F.count("*").alias("count"))
        .select("species", "count", "exclusion_reason")
    )


def exclusion_report(stats: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent excluded species."""
    return stats.orderBy(F.desc("count"), "species").limit(k)

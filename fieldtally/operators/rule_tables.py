"""First-match rules kept as a table, of any number.

A rule table has kind and value (see RuleSet), and position where the order of keywords matters. Names are
resolved by joins: every distinct name meets the rules for names and those for its first word, the rule of least
rank decides, and rows take the decision of their name. So nothing is sent to every task that grows
with the rules, a name counts once however many rows have it, and the rules of a first word that very many names share meet
``spread`` parts of them. Keywords are searched in captions, which no join can do: they are read into one
pattern, and only rows that no name rule decides are searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keywords import any_listed, first_listed
from ..functions.text import genus, genus_label, strip
from .joins import lookup_join

# Ranks of the kinds that names decide, in order of precedence.
RANKS = {"include_species": 1, "exclude_species": 2, "exclude_genera": 3}
MAX_KEYWORDS = 100_000


def name_ranks(rules: DataFrame) -> DataFrame:
    """kind (species or genus), name and rank: one row for each name that has a rule, of least rank."""
    rank = F.lit(None).cast("int")
    for kind, value in RANKS.items():
        rank = F.when(F.col("kind") == kind, value).otherwise(rank)
    ranked = rules.select(F.lower(strip(F.col("value"))).alias("name"), rank.alias("rank")).where("rank IS NOT NULL AND name IS NOT NULL")
    of = F.when(F.col("rank") == RANKS["exclude_genera"], "genus").otherwise("species")
    return ranked.groupBy(of.alias("of"), "name").agg(F.min("rank").alias("rank"))


def keywords_of(rules: DataFrame) -> tuple[str, ...]:
    """The caption keywords in their order. More than MAX_KEYWORDS are an error, as all of them become one pattern."""
    rows = rules.where((F.col("kind") == "exclude_caption_keywords") & F.col("value").isNotNull())
    order = [c for c in ("position", "value") if c in rules.columns]
    found = rows.orderBy(*order).select("value").limit(MAX_KEYWORDS + 1).collect()
    if len(found) > MAX_KEYWORDS:
        raise ValueError(f"more than {MAX_KEYWORDS} caption keywords")
    return tuple(r.value.lower() for r in found)


def decisions(names: DataFrame, rules: DataFrame, spread: int = 1) -> DataFrame:
    """name and rank of each distinct name that a rule for names decides; a null name counts as ''."""
    ranks = name_ranks(rules)
    known = names.select("name").distinct()
    known = known.select("name", F.lower(strip(F.coalesce("name", F.lit("")))).alias("_species"), genus(F.col("name")).alias("_genus"))
    by_species = ranks.where("of = 'species'").select(F.col("name").alias("_species"), F.col("rank").alias("_own"))
    by_genus = ranks.where("of = 'genus'").select(F.col("name").alias("_genus"), F.col("rank").alias("_of_genus"))
    met = lookup_join(lookup_join(known, by_species, "_species"), by_genus, "_genus", spread)
    return met.select("name", F.least("_own", "_of_genus").alias("rank")).where("rank IS NOT NULL")


def judge_by_table(
    df: DataFrame, rules: DataFrame, species_col: str = "first_species", caption_col: str | None = "full_caption", spread: int = 1
) -> DataFrame:
    """The rows with ``keep`` and ``exclusion_reason``, as RuleSet's keep and reason give them for the same rules.

    ``spread``: into how many parts the rows of a very frequent name, and the names of a very frequent first word, are dealt.
    """
    name = F.col(species_col)
    named = df.withColumn("_name", F.coalesce(name, F.lit("")))
    found = decisions(named.select(F.col("_name").alias("name")), rules, spread)
    rows = lookup_join(named, found.select(F.col("name").alias("_name"), F.col("rank").alias("_rank")), "_name", spread)
    words = keywords_of(rules)
    caption = F.lower(F.coalesce(F.col(caption_col), F.lit(""))) if caption_col and caption_col in df.columns else None
    undecided = F.col("_rank").isNull()
    has, keyword = F.lit(False), F.lit(None).cast("string")
    if caption is not None and words:
        has = undecided & any_listed(caption, words)
        keyword = F.when(has, F.get(F.array(*[F.lit(w) for w in words]), first_listed(caption, words) - 1))

    def reason(rank: Column) -> Column:
        return (
            F.when(rank == RANKS["include_species"], F.lit(None).cast("string"))
            .when(rank == RANKS["exclude_species"], F.concat(F.lit("species in exclude list: "), name))
            .when(rank == RANKS["exclude_genera"], F.concat(F.lit("genus excluded: "), genus_label(name)))
            .otherwise(F.concat(F.lit("caption keyword: '"), keyword, F.lit("'")))
        )

    keep = F.when(undecided, ~has).otherwise(F.col("_rank") == RANKS["include_species"])
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], keep.alias("keep"), reason(F.col("_rank")).alias("exclusion_reason"))

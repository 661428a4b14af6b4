"""First-match keep/drop rules over a name and an optional caption."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .keywords import any_listed, first_listed
from .text import genus, genus_label, strip

DEFAULT_RULES = Path(__file__).parent.parent / "config" / "rules.yaml"

#: Beyond so many keywords a caption is walked once for all of them, in place of once for each.
LONG_LIST = 24


@dataclass(frozen=True)
class RuleSet:
    """Rules in order of precedence; the first that matches decides.

    1. listed in ``include_species``: keep, 2. listed in ``exclude_species``: drop,
    3. first word listed in ``exclude_genera``: drop, 4. caption contains one of
    ``exclude_caption_keywords``: drop, 5. keep. Matching ignores case and outer
    blanks, and a null name counts as ''.
    """

    exclude_groups: tuple[str, ...] = ()
    exclude_genera: tuple[str, ...] = ()
    exclude_species: tuple[str, ...] = ()
    include_species: tuple[str, ...] = ()
    exclude_caption_keywords: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for f in fields(self):
            object.__setattr__(self, f.name, tuple(getattr(self, f.name) or ()))

    @classmethod
    def from_mapping(cls, config: Mapping[str, list[str] | None]) -> "RuleSet":
        """Missing and empty keys become empty lists."""
        return cls(**{f.name: tuple(config.get(f.name) or ()) for f in fields(cls)})

    @classmethod
    def from_yaml(cls, path: str | Path | None = None) -> "RuleSet":
        """Rules from the ``filter`` section of a YAML file; a missing file is an error."""
        import yaml

        with open(path or DEFAULT_RULES, encoding="utf-8") as f:
            return cls.from_mapping(yaml.safe_load(f).get("filter") or {})

    @classmethod
    def empty(cls) -> "RuleSet":
        """Rules that keep everything."""
        return cls()

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """The rules as rows of (kind, value, position), for operators.rule_tables; positions count from 1 within a kind."""
        rows = [(f.name, v, i) for f in fields(self) for i, v in enumerate(getattr(self, f.name), start=1)]
        return spark.createDataFrame(rows, "kind string, value string, position int")

    @property
    def keywords(self) -> tuple[str, ...]:
        return tuple(k.lower() for k in self.exclude_caption_keywords)

    def _listed(self, name: Column, names: tuple[str, ...]) -> Column:
        values = sorted({n.strip().lower() for n in names})
        return F.lower(strip(F.coalesce(name, F.lit("")))).isin(values) if values else F.lit(False)

    def _genus_listed(self, name: Column) -> Column:
        values = sorted({g.strip().lower() for g in self.exclude_genera})
        return genus(name).isin(values) if values else F.lit(False)

    def first_keyword(self, caption: Column | None) -> Column:
        """Position (from 1) of the first listed keyword the caption contains, else 0."""
        out = F.lit(0)
        if caption is not None:
            text = F.lower(F.coalesce(caption, F.lit("")))
            if len(self.keywords) > LONG_LIST:
                return first_listed(text, self.keywords)
            for i, k in reversed(list(enumerate(self.keywords, start=1))):
                out = F.when(text.contains(k), i).otherwise(out)
        return out

    def _has_keyword(self, caption: Column | None) -> Column:
        out = F.lit(False)
        if caption is not None:
            text = F.lower(F.coalesce(caption, F.lit("")))
            if len(self.keywords) > LONG_LIST:
                return any_listed(text, self.keywords)
            for k in self.keywords:
                out = out | text.contains(k)
        return out

    def keep(self, name: Column, caption: Column | None = None) -> Column:
        """True where the record stays."""
        return (
            F.when(self._listed(name, self.include_species), True)
            .when(self._listed(name, self.exclude_species), False)
            .when(self._genus_listed(name), False)
            .otherwise(~self._has_keyword(caption))
        )

    def reason_for(self, name: Column, keyword_position: Column) -> Column:
        """Why a record is dropped, given the position of its first keyword; null if it stays."""
        keyword = F.lit(None).cast("string")
        if self.keywords:
            keyword = F.try_element_at(
                F.array(*[F.lit(k) for k in self.keywords]), F.nullif(keyword_position, F.lit(0))
            )
        return (
            F.when(self._listed(name, self.include_species), F.lit(None).cast("string"))
            .when(self._listed(name, self.exclude_species), F.concat(F.lit("species in exclude list: "), name))
            .when(self._genus_listed(name), F.concat(F.lit("genus excluded: "), genus_label(name)))
            .otherwise(F.concat(F.lit("caption keyword: '"), keyword, F.lit("'")))
        )

    def reason(self, name: Column, caption: Column | None = None) -> Column:
        """Why a record is dropped; null if it stays."""
        return self.reason_for(name, self.first_keyword(caption))

    def keep_names(self, names: Column) -> Column:
        """The names of a list that the rules keep (captions play no part)."""
        return F.filter(names, lambda n: self.keep(n))

"""Text expressions: trimming, names, labels and the weather sentence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blanks in the raw text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BLANK_CLASS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Name qualifiers that carry no taxonomic meaning.
QUALIFIERS = r"(?i)\b(?:cf\.|aff\.|var\.|ssp\.|spp?\.)"

# Fixed value: layout of the weather sentence (mean, min., max., precipitation).
WEATHER_SENTENCE = (
    r"(?i)Temperature ([-+]?\d+\.\d)° .*?min\. ([-+]?\d+)°, max\. ([-+]?\d+)°"
    r".*?Precipitation ([-+]?\d+\.\d) mm"
)


def strip(c: Column) -> Column:
    """Drop blanks of every kind at both ends."""
    return F.trim(c, F.lit(BLANKS))


def genus(name: Column) -> Column:
    """First blank-separated word in lower case; '' when there is none."""
    return F.coalesce(
        F.lower(F.regexp_extract(name, f"^[{BLANK_CLASS}]*([^{BLANK_CLASS}]+)", 1)), F.lit("")
    )


def genus_label(name: Column) -> Column:
    """Genus in title case, for display."""
    return F.initcap(genus(name))


def normalize_name(name: Column, strict_compat: bool = False) -> Column:
    """Remove qualifiers such as ``cf.``, turn brackets into blanks, collapse blanks.

    ``strict_compat`` demands a word character right behind the qualifier, so
    that ``A. cf. b`` keeps it and only ``A. cf.b`` loses it.
    """
    pattern = QUALIFIERS + (r"\b" if strict_compat else "")
    c = F.regexp_replace(strip(name), pattern, "")
    c = F.regexp_replace(c, r"[()\[\]{}]", " ")
    c = F.regexp_replace(c, f"[{BLANK_CLASS}]+", " ")
    return F.coalesce(strip(c), F.lit(""))


def truncate_label(c: Column, longer_than: int = 30, keep: int | None = None) -> Column:
    """Shorten labels longer than ``longer_than`` to ``keep`` characters and an ellipsis."""
    keep = longer_than if keep is None else keep
    return F.when(F.length(c) > longer_than, F.concat(F.substring(c, 1, keep), F.lit("…"))).otherwise(c)


def weather_metrics(sentence: Column) -> dict[str, Column]:
    """The four numbers of the weather sentence; all null when it does not match."""
    return {
        name: F.regexp_extract(sentence, WEATHER_SENTENCE, i).try_cast("double")
        for i, name in enumerate(("temp", "min", "max", "precip"), start=1)
    }

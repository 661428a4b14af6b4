"""Expressions over list-valued columns and over text that spells a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import BLANK_CLASS

UNIDENTIFIED = "Unidentified"

# Possessive loops keep the matcher iterative, whatever the length of the text.
_SINGLE = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'"""
_DOUBLE = r'''"[^"\\]*+(?:\\.[^"\\]*+)*+"'''
# A quoted string of either kind, or a run of text outside quotes.
_TOKENS = rf"""(?s){_SINGLE}|{_DOUBLE}|[^'"]++"""
# Everything up to the next None outside quotes.
_UP_TO_NONE = rf"""(?s)\G((?:[^'"N]++|N(?!one\b)|{_SINGLE}|{_DOUBLE})*+)None\b"""


def _token_as_json(t: Column) -> Column:
    body = F.substring(t, F.lit(2), F.length(t) - 2)
    body = F.regexp_replace(body, r"(?<!\\)((?:\\\\)*)\\'", "$1'")
    body = F.regexp_replace(body, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    bare = F.regexp_replace(t, r"\bNone\b", "null")
    bare = F.regexp_replace(bare, r"\bTrue\b", "true")
    bare = F.regexp_replace(bare, r"\bFalse\b", "false")
    bare = F.regexp_replace(bare, r",(\s*[\]}])", "$1")
    return (
        F.when(
            t.startswith("'"),
            F.concat(F.lit('"'), F.regexp_replace(body, r'(?<!\\)((?:\\\\)*)"', r'$1\\"'), F.lit('"')),
        )
        .when(t.startswith('"'), F.concat(F.lit('"'), body, F.lit('"')))
        .otherwise(bare)
    )


def _is_list(v: Column) -> Column:
    return (v.startswith("[") & v.endswith("]")) | v.rlike(rf"(?s)^[{BLANK_CLASS}]*\[.*\][{BLANK_CLASS}]*$")


def _from_json(v: Column, schema: str) -> tuple[Column, Column]:
    """Literal text read by the JSON reader in two ways; null where it cannot be read.

    The first accepts what JSON and the literal have in common: single quotes are
    fine with the reader, and ``None`` outside quotes is replaced in one pass. The
    second takes a literal apart token by token, for escapes, ``True`` and the
    like. Quoted text is never altered. Use the second where the first is null.
    """
    plain = F.when(v.contains("None"), F.regexp_replace(v, _UP_TO_NONE, "$1null")).otherwise(v)
    rewritten = F.array_join(F.transform(F.regexp_extract_all(v, F.lit(_TOKENS), F.lit(0)), _token_as_json), "")
    options = {"allowUnquotedControlChars": "true"}
    return F.from_json(plain, schema, options), F.from_json(rewritten, schema, options)


def _none() -> Column:
    return F.array().cast("array<string>")


def parse_list(v: Column) -> Column:
    """Text of a list literal to ``array<string>``; anything else gives an empty array."""
    items = F.coalesce(*_from_json(v, "array<string>"), _none())
    return F.when(_is_list(v), items).otherwise(_none())


def parse_record_names(v: Column, field: str = "latin_name") -> Column:
    """Text of a list of records to the non-empty values of one field.

    The first element decides the shape: a list that starts with a plain string
    is returned as it is.
    """
    names = [c.getField(field) for c in _from_json(v, f"array<struct<{field}: string>>")]
    # lists that mix records and other values are read element by element
    mixed = F.transform(parse_list(v), lambda x: F.when(x.startswith("{"), F.get_json_object(x, f"$.{field}")))
    is_records = v.startswith("[{") | v.rlike(rf"^[{BLANK_CLASS}]*\[\s*\{{")
    return (
        F.when(is_records & _is_list(v), F.filter(F.coalesce(*names, mixed), lambda n: n != ""))
        .when(is_records, _none())
        .otherwise(parse_list(v))
    )


def as_list(df: DataFrame, column: str) -> Column:
    """``column`` as ``array<string>``, whether it holds arrays or literal text."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.coalesce(c.cast("array<string>"), F.array().cast("array<string>"))
    return parse_list(c)


def as_record_names(df: DataFrame, column: str, field: str = "latin_name") -> Column:
    """``column`` as names, whether it holds records, plain arrays or literal text."""
    c, t = F.col(column), df.schema[column].dataType
    if not isinstance(t, T.ArrayType):
        return parse_record_names(c, field)
    if isinstance(t.elementType, T.StructType):
        names = F.transform(c, lambda r: r.getField(field).cast("string"))
        return F.coalesce(F.filter(names, lambda n: n != ""), F.array().cast("array<string>"))
    return as_list(df, column)


def list_to_text(xs: Column) -> Column:
    """Items joined by ``;``, nulls skipped; '' for a null list."""
    return F.coalesce(F.array_join(xs, ";"), F.lit(""))


def first_item(xs: Column, default: str = UNIDENTIFIED) -> Column:
    return F.coalesce(F.try_element_at(xs, F.lit(1)), F.lit(default))


def list_length(xs: Column) -> Column:
    return F.when(xs.isNull(), 0).otherwise(F.size(xs))

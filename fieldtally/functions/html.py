"""Expressions over HTML text: cleaning, text of a fragment, anchors, blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Elements that start a block of their own.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "body", "center", "dd", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section",
    "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
)
BLOCK_TAG = r"(?i)</?(?:" + "|".join(BLOCK_TAGS) + r")\b[^>]*>"

# Character references decoded in text and attributes.
ENTITIES = {
    "&nbsp;": "\xa0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "\\'", "&deg;": "°",
    "&copy;": "©", "&reg;": "®", "&middot;": "·", "&laquo;": "«", "&raquo;": "»",
    "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“",
    "&rdquo;": "”", "&hellip;": "…", "&agrave;": "à", "&aacute;": "á", "&auml;": "ä",
    "&ccedil;": "ç", "&egrave;": "è", "&eacute;": "é", "&ecirc;": "ê", "&iacute;": "í",
    "&ntilde;": "ñ", "&oacute;": "ó", "&ouml;": "ö", "&uacute;": "ú", "&uuml;": "ü",
    "&szlig;": "ß", "&times;": "×", "&micro;": "µ", "&plusmn;": "±", "&amp;": "&",
}

_TAG = r"<[/a-zA-Z!?][^>]*>"
_HREF = r"""<a\s[^>]*?(?<![\w-])href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
ANCHOR = rf"(?is){_HREF}[^>]*>.*?(?:</a\s*>|(?=<a\s)|$)"


def unescape(c: Column) -> Column:
    """Decode character references; unknown ones stay as they are."""
    names = F.expr("map(" + ", ".join(f"'{name}', '{char}'" for name, char in ENTITIES.items()) + ")")

    def decode(t: Column) -> Column:
        digits = F.regexp_extract(t, r"^&#(\d+);$", 1)
        hexadecimal = F.regexp_extract(t, r"(?i)^&#x([0-9a-f]+);$", 1)
        code = F.when(digits != "", digits).when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).try_cast("bigint")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(t.startswith("&#"), F.when(valid, char)).otherwise(F.try_element_at(names, t))

    tokens = F.regexp_extract_all(c, F.lit(r"&#?\w++;|[^&]++|&"), F.lit(0))
    decoded = F.transform(tokens, lambda t: F.when(t.startswith("&"), F.coalesce(decode(t), t)).otherwise(t))
    return F.when(c.contains("&"), F.array_join(decoded, "")).otherwise(c)


def visible(html: Column) -> Column:
    """The page without comments, scripts and style sheets."""
    return F.regexp_replace(
        html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>", ""
    )


def text_of(fragment: Column, separator: str = " ") -> Column:
    """Text pieces between tags, each stripped, empty ones dropped, joined by ``separator``."""
    pieces = F.transform(F.split(fragment, _TAG), lambda t: strip(unescape(t)))
    return F.array_join(F.filter(pieces, lambda t: t != ""), separator)


def blocks(html: Column) -> Column:
    """The page cut at every block tag, in document order."""
    return F.split(html, BLOCK_TAG)


def anchors(html: Column) -> Column:
    """Every anchor with a link target, from its opening tag to its end."""
    return F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0))


def _unquoted(target: Column) -> Column:
    # one mention of the target: within a lambda an expression is worked out anew for each
    return F.regexp_replace(target, r"""(?s)^(["'])(.*).$""", "$2")


def hrefs(html: Column) -> Column:
    """Link targets of all anchors, decoded, in document order."""
    targets = F.transform(F.regexp_extract_all(html, F.lit(f"(?i){_HREF}"), F.lit(1)), _unquoted)
    return F.transform(targets, unescape)


def href(anchor: Column) -> Column:
    """Link target of an anchor, decoded."""
    return unescape(_unquoted(F.regexp_extract(anchor, f"(?is)^{_HREF}", 1)))


def links(html: Column) -> Column:
    """All anchors as an array of (href, text), the text without blanks between its pieces."""
    raw = F.transform(
        anchors(html),
        lambda a: F.struct(_unquoted(F.regexp_extract(a, f"(?is)^{_HREF}", 1)).alias("t"), a.alias("a")),
    )
    return F.transform(raw, lambda r: F.struct(unescape(r.t).alias("href"), anchor_text(r.a).alias("text")))


def anchor_text(anchor: Column, separator: str = "") -> Column:
    return text_of(anchor, separator)

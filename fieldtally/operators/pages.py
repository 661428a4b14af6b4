"""Jobs over a table of pages: links, day fields, photo records, locations.

Every step works within the row of one page, so no page table is ever shuffled.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import BLOCK_TAGS, blocks, href, hrefs, links, text_of, visible
from ..functions.text import BLANK_CLASS, strip
from ..functions.urls import join_url
from .columns import compute_once

# What marks a photo, a species page, and a page that is neither.
PHOTO_PATH = "/pictures/archives/"
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif")
SPECIES_PATHS = ("en/", "fungi_en/", "ru/")
NOT_SPECIES = ("index", "list", "archives", "date-")
ATTACHMENT_SUFFIX = ".kmz"
ATTACHMENT_PART = "date-loc"

# Elements that end the species text, and the shortest weather
# text that is not taken for a mere label.
SPECIES_STOPS = r"(?i)<(?:p|div|table|h1|h2|h3|br)\b[^>]*>|</(?:" + "|".join(BLOCK_TAGS) + r")\s*>"
SHORTEST_WEATHER = 50


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def page_links(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per anchor of a page: position, raw target, text, absolute url."""
    return (
        compute_once(pages.select(*keep, "url", "html"), {"_links": links(visible(F.col("html")))})
        .select(*keep, "url", F.posexplode("_links").alias("_i", "_l"))
        .select(*keep, "url", (F.col("_i") + 1).alias("pos"), "_l.*")
        .withColumn("link", join_url(F.col("url"), F.col("href")))
    )


def index_links(
    pages: DataFrame,
    prefix: str = "date-en/",
    suffix: str = ".htm",
    date_format: str = "yyyy-M-d",
    date_pattern: str = r"^\d{4}-\d{1,2}-\d{1,2}$",
    newest_first: bool = False,
) -> DataFrame:
    """Dated links of index pages: the date from the link text, else from its last path segment.

    Links without a date are dropped. Only text that looks like a date is parsed,
    as a failing date parser is slow. ``newest_first`` sorts, which samples its input and
    so reads and parses every page twice: sort stored links instead.
    """

    def parsed(text: Column) -> Column:
        return F.when(text.rlike(date_pattern), F.try_to_date(text, date_format))

    target = F.col("href")
    segment = F.replace(F.substring_index(target, "/", -1), F.lit(suffix), F.lit(""))
    found = (
        page_links(pages)
        .where(target.startswith(prefix) & target.endswith(suffix))
        .select(
            F.coalesce(parsed(F.col("text")), parsed(segment)).alias("date"),
            F.col("link").alias("url"),
        )
        .where(F.col("date").isNotNull())
    )
    return found.orderBy(F.desc("date"), "url") if newest_first else found


def newest(pages: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest pages."""
    return pages.orderBy(F.desc("date"), "url").limit(n)


def _visible(pages: DataFrame) -> DataFrame:
    """Replace the raw HTML by its visible part, once for all that follows."""
    return compute_once(pages, {"html": visible(F.col("html"))})


def _weather_parts(page: Column) -> tuple[Column, Column]:
    """The first block with a text node that starts with "Weather", and the word's inline wrapper."""
    # within a block such a node comes first or follows an inline tag
    node = rf"(?:^|>)[{BLANK_CLASS}]*Weather"
    wrapper = rf"(?is)<(b|strong|i|em|u|font|span|big|small)\b[^>]*>[{BLANK_CLASS}]*(?-i:Weather).*?</\1\s*>"
    some = page.contains("Weather")
    block = F.try_element_at(F.filter(blocks(page), lambda b: b.rlike(node)), F.lit(1))
    return F.when(some, block), F.when(some, F.regexp_extract(page, wrapper, 0))


def _weather(page: Column, block: Column, wrapped: Column) -> Column:
    """Text from the word "Weather" to the end of its element.

    The element is the inline wrapper of the word if that holds enough text, else
    the block around it; a block that holds little more than a label is extended
    to the end of what encloses it.
    """
    to_the_end = rf"(?s)(?:^|>)[{BLANK_CLASS}]*(Weather.*?)(?i:</(?:div|td|article|section|center|body|html)\b|$)"
    in_wrapper = (wrapped != "") & block.contains(wrapped) & (F.length(text_of(wrapped)) >= SHORTEST_WEATHER)
    only_label = block.rlike(rf"^[{BLANK_CLASS}]*Weather") & (F.length(text_of(block)) < SHORTEST_WEATHER)
    element = F.when(in_wrapper, wrapped).when(only_label, F.regexp_extract(page, to_the_end, 1)).otherwise(block)
    return F.nullif(F.regexp_extract(text_of(element), r"(?s)Weather.*$", 0), F.lit(""))


def _species_part(page: Column) -> Column:
    """Text behind "Identified species" up to the next block or line break.

    What shares the text node of the label is skipped, and of the elements around
    the label only a bold one is left behind.
    """
    behind = F.regexp_extract(page, r"(?s)Identified species[^<]*+(?:</b\s*>|(?!</))(.*)$", 1)
    part = F.split(behind, SPECIES_STOPS + rf"|^[{BLANK_CLASS}]*</", 2)[0]
    return F.when(page.contains("Identified species"), F.nullif(text_of(part), F.lit("")))


def species_names(text: Column) -> Column:
    """Comma-separated names as a list without empty ones."""
    names = F.filter(F.transform(F.split(text, ","), strip), lambda n: n != "")
    return F.coalesce(names, F.array().cast("array<string>"))


def _attachment(page: Column) -> Column:
    """Target of the first location attachment of a page, or null."""
    first = F.filter(hrefs(page), lambda t: t.endswith(ATTACHMENT_SUFFIX) | t.contains(ATTACHMENT_PART))
    some = page.contains(ATTACHMENT_SUFFIX) | page.contains(ATTACHMENT_PART)
    return F.when(some, F.try_element_at(first, F.lit(1)))


def page_attachments(pages: DataFrame) -> DataFrame:
    """Rows of (page_url, kmz_url), one for each page that has an attachment."""
    found = compute_once(_visible(pages.select("url", "html")), {"_target": _attachment(F.col("html"))})
    return (
        found.where(F.col("_target").isNotNull())
        .select(F.col("url").alias("page_url"), join_url(F.col("url"), F.col("_target")).alias("kmz_url"))
        .distinct()  # copies of a page must not multiply what is attached to it
    )


def page_fields(pages: DataFrame, with_photos: bool = False) -> DataFrame:
    """Weather sentence, species text and list, attachment and photo count of every page.

    ``with_photos`` adds the photo records as an array, made within the page's row.
    """
    page, url, species = F.col("html"), F.col("url"), F.col("_species")
    block, wrapped = _weather_parts(page)
    parts = {
        "_block": block,
        "_wrapped": wrapped,
        "_species": _species_part(page),
        "_target": _attachment(page),
        "photo_count": count_photos(page),
    }
    fields = {
        "weather_summary": _weather(page, F.col("_block"), F.col("_wrapped")),
        # a colon in front and a dot at the end go, with the blanks inside them
        "identified_species_text": F.regexp_replace(species, rf"^:[{BLANK_CLASS}]*|\.$", ""),
        "kmz_url": join_url(url, F.col("_target")),
    }
    seen = with_photo_structs(_visible(pages)) if with_photos else _visible(pages)
    return (
        compute_once(seen, parts)
        .withColumns(fields)
        .withColumn("identified_species", species_names(F.col("identified_species_text")))
        .drop("html", "_block", "_wrapped", "_species", "_target")
    )


def _species_refs(container: Column, url: Column) -> Column:
    species = F.filter(
        links(container),
        lambda r: r.href.endswith(".htm")
        & _any([r.href.contains(p) for p in SPECIES_PATHS])
        & ~_any([r.href.contains(p) for p in NOT_SPECIES]),
    )
    return F.transform(
        species, lambda r: F.struct(r.text.alias("latin_name"), join_url(url, r.href).alias("page_url"))
    )


# Elements without an end tag, and those that end where a sibling of their name begins.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
IMPLIED_ENDS = ("p", "li", "td", "th", "tr", "dt", "dd", "option")
_TOKEN = r"<[/a-zA-Z][^>]*>|[^<]++|<"
_NAME = re.compile(r"</?([a-zA-Z][^ \t\n\x0b\f\r/>]*)").match


def _holders(tokens: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Places of anchors that name the photo archive with that of the element around each (-1: none), and from where to
    where those elements reach. One pass over the tags with the stack of open elements."""
    stack: list[tuple[str, int]] = []
    links, ends, holding = [], [], {-1}

    def ended(gone: list[tuple[str, int]], at: int) -> None:
        ends.extend((place, at) for _, place in gone if place in holding)

    for i, token in enumerate(tokens):
        tag = _NAME(token)
        name = tag[1].lower() if tag else ""
        if not name or name in VOID_TAGS:
            continue
        if token.startswith("</"):
            kept = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), len(stack))
        else:
            kept = len(stack) - (name in IMPLIED_ENDS and bool(stack) and stack[-1][0] == name)
        ended(stack[kept:], i)
        del stack[kept:]
        if token.startswith("</"):
            continue
        if name == "a" and PHOTO_PATH in token:
            parent = stack[-1][1] if stack else -1
            holding.add(parent)
            links.append((i, parent))
        stack.append((name, i))
    ended([*stack, ("", -1)], len(tokens))
    return links, ends


def _parents(page: Column) -> Column:
    """Links into the photo archive and the elements around them, by places among the tokens of a page."""

    def run(pages: pd.Series) -> pd.DataFrame:
        token = re.compile(_TOKEN).findall
        found = [_holders(token(p)) if p and PHOTO_PATH in p else ([], []) for p in pages]
        links = [[{"at": i, "parent": k} for i, k in f[0]] for f in found]
        return pd.DataFrame({"links": links, "ends": [[{"open": i, "close": k} for i, k in f[1]] for f in found]})

    return F.pandas_udf(run, "links array<struct<at: int, parent: int>>, ends array<struct<open: int, close: int>>")(page)


def _common_name(caption: Column) -> Column:
    return F.when(caption.contains("("), strip(F.substring_index(caption, "(", 1))).otherwise(caption)


def with_photo_structs(pages: DataFrame, name: str = "photos") -> DataFrame:
    """Add the archived images of each page as an array of photo records, in page order.

    ``html`` is the visible page. The caption is the text of the element that holds the link, and the
    species are the links in it; both are taken once for each such element, however
    many photos it holds. The position also counts links that are not images and
    so leaves gaps.
    """
    tokens = F.when(F.col("html").contains(PHOTO_PATH), F.regexp_extract_all("html", F.lit(_TOKEN), F.lit(0)))
    found = pages.withColumn("_found", _parents(F.col("html")))
    found = compute_once(found, {"_tokens": F.coalesce(tokens, F.array().cast("array<string>"))})
    targets = F.transform(
        "_found.links", lambda r: F.struct(href(F.get("_tokens", r["at"])).alias("href"), r["parent"].alias("parent"))
    )
    found = compute_once(found, {"_links": F.filter(targets, lambda r: r["href"].contains(PHOTO_PATH))})
    held = F.array_distinct(F.transform("_links", lambda r: r["parent"]))
    ranges = F.filter("_found.ends", lambda e: F.array_contains(held, e["open"]))

    def entry(e: Column) -> Column:
        part = F.array_join(F.slice("_tokens", e["open"] + 2, e["close"] - e["open"] - 1), "")
        return F.struct(e["open"].alias("open"), part.alias("part"))

    def facts(c: Column) -> Column:
        values = F.struct(text_of(c["part"]).alias("caption"), _species_refs(c["part"], F.col("url")).alias("species"))
        return F.struct(c["open"].alias("open"), values.alias("facts"))

    elements = F.map_from_entries(F.transform(F.transform(ranges, entry), facts))
    found = compute_once(found, {"_elements": elements})
    numbered = F.transform("_links", lambda r, i: F.struct((i + 1).alias("i"), r["href"].alias("href"), r["parent"].alias("parent")))
    images = F.filter(numbered, lambda r: _any([F.lower(r["href"]).endswith(e) for e in IMAGE_EXTENSIONS]))
    known = F.transform(
        images,
        lambda r: F.struct(r["i"].alias("i"), r["href"].alias("href"), F.element_at("_elements", r["parent"]).alias("facts")),
    )
    records = F.transform(
        known,
        lambda r: F.struct(
            F.col("date").alias("date"),
            F.col("url").alias("page_url"),
            join_url(F.col("url"), r["href"]).alias("photo_url"),
            r["i"].alias("index_on_page"),
            r["facts"]["caption"].alias("full_caption"),
            _common_name(r["facts"]["caption"]).alias("common_name"),
            r["facts"]["species"].alias("species"),
            F.lit(None).cast("string").alias("location_text"),
        ),
    )
    return compute_once(found, {name: records}).drop("_tokens", "_found", "_links", "_elements")


def photo_records(pages: DataFrame) -> DataFrame:
    """One row per archived image: position, caption, common name and species links."""
    holding = pages.select("date", "url", "html").where(F.col("html").contains(PHOTO_PATH))
    return with_photo_structs(_visible(holding), "_photos").select(F.inline("_photos"))


def location_key(photo_url: Column) -> Column:
    """``ROLL-NN``: the second segment after ``archives`` and the leading digits of the file name."""
    segments = F.split(photo_url, "/")
    at = F.array_position(segments, "archives")
    roll = F.try_element_at(segments, F.when(at > 0, (at + 2).cast("int")))
    number = F.regexp_extract(F.element_at(segments, -1), r"^\d+", 0)
    return F.when((roll != "") & (number != ""), F.concat_ws("-", roll, number))


def count_photos(page: Column) -> Column:
    """Number of archived images on a page."""
    images = F.filter(
        hrefs(page),
        lambda t: t.contains(PHOTO_PATH) & _any([F.lower(t).endswith(e) for e in IMAGE_EXTENSIONS]),
    )
    return F.when(page.contains(PHOTO_PATH), F.size(images)).otherwise(0).cast("bigint")


def flatten_pages(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested page records to the flat days and photos tables; ``species`` stays nested."""
    days = records.select(
        "date", "url", "weather_summary", "identified_species_text", "identified_species", "kmz_url",
        F.size("photos").cast("bigint").alias("photo_count"),
    )
    return days, records.select(F.inline("photos"))


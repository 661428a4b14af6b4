"""Relative reference resolution (RFC 3986, section 5) as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?"


def _without_dots(path: Column, collapse: bool) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path.

    ``collapse`` also drops empty inner segments, as merging a relative path does.
    """
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    if collapse:
        inner = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 2, F.lit(0)))
        segments = F.concat(F.array(F.lit("")), F.filter(inner, lambda s: s != ""), F.array(last))
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    # a path that ends in a dot segment names a folder; the root may have been
    # popped along the way and is put back
    kept = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    joined = F.array_join(kept, "/")
    resolved = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    unresolved = r"/\.{1,2}(/|$)|//" if collapse else r"/\.{1,2}(/|$)"
    return F.when(path.rlike(unresolved), resolved).otherwise(path)


def join_url(base: Column, ref: Column) -> Column:
    """Absolute form of ``ref`` found on the page ``base``."""
    origin = F.regexp_extract(base, _ORIGIN, 0)
    scheme = F.regexp_extract(base, _ORIGIN, 1)
    base_path = F.regexp_extract(base, _ORIGIN + r"([^?#]*)", 3)
    folder = F.when(base_path.contains("/"), F.regexp_extract(base_path, r"^.*/", 0)).otherwise("/")
    path = F.regexp_extract(ref, r"^[^?#]*", 0)
    tail = F.regexp_extract(ref, r"[?#].*$", 0)
    return (
        F.when(ref == "", base)
        .when(ref.rlike(_SCHEME), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref.startswith("#"), F.concat(F.regexp_extract(base, r"^[^#]*", 0), ref))
        .when(ref.startswith("?"), F.concat(origin, base_path, ref))
        .when(ref.startswith("/"), F.concat(origin, _without_dots(path, False), tail))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, path), True), tail))
    )


def file_name(url: Column) -> Column:
    """Last path segment without a query string."""
    return F.substring_index(F.substring_index(url, "/", -1), "?", 1)


def image_key(day: Column, index_on_page: Column, photo_url: Column) -> Column:
    """Storage key of an image: ``date/NNN_filename``."""
    return F.format_string(
        "%s/%03d_%s", F.date_format(day, "yyyy-MM-dd"), index_on_page, file_name(photo_url)
    )

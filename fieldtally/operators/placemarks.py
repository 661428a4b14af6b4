"""Placemark documents (KML text) and the location of photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import unescape
from ..functions.text import BLANK_CLASS, strip
from ..session import reusable
from .columns import compute_once
from .joins import lookup_join
from .pages import location_key, page_fields, photo_records

_PREFIX = r"(?:[\w.-]+:)?"
_PLACEMARK = rf"(?s)<{_PREFIX}Placemark\b[^>]*(?<!/)>.*?</{_PREFIX}Placemark\s*>"
_NAME = rf"(?s)<{_PREFIX}name(?:\s[^>]*)?(?<!/)>(.*?)</{_PREFIX}name\s*>"
_LAST_POINT = rf"(?s).*<{_PREFIX}Point\b[^>]*(?<!/)>.*?<{_PREFIX}coordinates\b[^>]*(?<!/)>(.*?)<"
_COORDINATES = rf"(?s)<{_PREFIX}coordinates\b[^>]*(?<!/)>(.*?)</"
_NUMBER = rf"[{BLANK_CLASS}]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[{BLANK_CLASS}]*"
_LON_LAT = rf"^{_NUMBER},{_NUMBER}(?:,|$)"


def _lat_lon(text: Column) -> Column:
    """(lat, lon) of ``lon,lat[,alt]``; null when either is not a number."""
    lon, lat = (F.regexp_extract(text, _LON_LAT, i).try_cast("double") for i in (1, 2))
    return F.when(text.rlike(_LON_LAT), F.struct(lat.alias("lat"), lon.alias("lon")))


def _readable(documents: DataFrame, key: str, kml_col: str) -> DataFrame:
    """Rows of (key, _kml): well-formed documents without their comments."""
    parsed = compute_once(
        documents.select(key, F.col(kml_col).alias("_kml")).where(F.col("_kml").isNotNull()),
        {"_xml": F.from_xml("_kml", "_corrupt_record string", {"mode": "PERMISSIVE"})},
    )
    return parsed.where(F.col("_xml._corrupt_record").isNull()).select(
        key, F.regexp_replace("_kml", r"(?s)<!--.*?-->", "").alias("_kml")
    )


def _points(kml: Column) -> Column:
    """Valid placemark points of a document in order, as an array of (name, lat, lon)."""
    raw = F.transform(
        F.regexp_extract_all(kml, F.lit(_PLACEMARK), F.lit(0)),
        lambda mark: F.struct(
            F.regexp_extract(mark, _NAME, 1).alias("name"),
            _lat_lon(F.regexp_extract(mark, _LAST_POINT, 1)).alias("at"),
        ),
    )
    text = r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$"
    return F.transform(
        F.filter(raw, lambda r: r["at"].isNotNull()),
        lambda r: F.struct(
            F.nullif(strip(unescape(F.regexp_replace(r["name"], text, "$1"))), F.lit("")).alias("name"),
            r["at"]["lat"].alias("lat"),
            r["at"]["lon"].alias("lon"),
        ),
    )


def _coordinates(kml: Column) -> Column:
    """The valid first coordinates of all geometries of a document."""
    first_tuple = f"^[{BLANK_CLASS}]*([^{BLANK_CLASS}]+)"
    texts = F.regexp_extract_all(kml, F.lit(_COORDINATES), F.lit(1))
    return F.filter(F.transform(texts, lambda t: _lat_lon(F.regexp_extract(t, first_tuple, 1))), lambda p: p.isNotNull())


def document_points(documents: DataFrame, kml_col: str = "kml", key: str = "kmz_url") -> DataFrame:
    """``key``, ``points`` (map of names to points, the last of a name), default_lat and default_lon.

    Every document is parsed once. Where a key has several documents, the place within a document decides, and between
    equal places, as for the default point, a hash of the document: the result does not hang on the order of rows.
    """
    kml = F.col("_kml")
    parsed = compute_once(_readable(documents, key, kml_col), {"_points": _points(kml), "_any": _coordinates(kml)})
    default = [F.coalesce(F.get("_points", F.lit(0))[c], F.get("_any", F.lit(0))[c]).alias(f"default_{c}") for c in ("lat", "lon")]
    mark = F.shiftrightunsigned(F.xxhash64(kml), 32).alias("_mark")
    rows = parsed.select(key, mark, *default, F.posexplode_outer("_points").alias("pos", "p"))
    place = F.coalesce("pos", F.lit(0)).cast("long") * (1 << 32) + F.col("_mark")
    has_default = F.when(F.col("default_lat").isNotNull(), F.col("_mark"))
    named = rows.groupBy(key, F.col("p.name").alias("name")).agg(
        F.max_by("p.lat", place).alias("lat"), F.max_by("p.lon", place).alias("lon"),
        *[F.min_by(c, has_default).alias(c) for c in ("default_lat", "default_lon")], F.min(has_default).alias("_mark"),
    )
    point = F.when(F.col("name").isNotNull(), F.struct("name", F.struct("lat", "lon").alias("at")))
    defaults = [F.min_by(c, "_mark").alias(c) for c in ("default_lat", "default_lon")]
    return named.groupBy(key).agg(F.map_from_entries(F.collect_list(point)).alias("points"), *defaults)


def placemarks(documents: DataFrame, key: str = "page_url", kml_col: str = "kml") -> DataFrame:
    """Rows of (key, name, lat, lon); of a repeated name the last point counts.

    Unreadable documents give no rows. All marks of a document lie in one row,
    so the aggregation shrinks them before anything is shuffled.
    """
    found = compute_once(_readable(documents, key, kml_col), {"_points": _points(F.col("_kml"))})
    marks = found.select(key, F.posexplode("_points").alias("pos", "p"))
    return (
        marks.where(F.col("p.name").isNotNull())
        .groupBy(key, F.col("p.name").alias("name"))
        .agg(F.max_by("p.lat", "pos").alias("lat"), F.max_by("p.lon", "pos").alias("lon"))
    )


def default_points(documents: DataFrame, key: str = "page_url", kml_col: str = "kml") -> DataFrame:
    """Rows of (key, default_lat, default_lon), one per key that has any coordinate.

    The default is the first placemark point of a document, else the first
    coordinate of any geometry in it.
    """
    kml = F.col("_kml")
    anywhere = _coordinates(kml)
    points = F.transform(_points(kml), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    found = compute_once(
        _readable(documents, key, kml_col),
        {"_p": F.coalesce(F.try_element_at(points, F.lit(1)), F.try_element_at(anywhere, F.lit(1)))},
    )
    # the least point of a key in two steps of plain numbers, which combine by hash where a struct would be sorted
    points = found.where(F.col("_p").isNotNull()).select(key, "_p.lat", "_p.lon").repartition(key)
    least = points.groupBy(key, "lat").agg(F.min("lon").alias("lon"))
    return least.groupBy(key).agg(F.min("lat").alias("default_lat"), F.min_by("lon", "lat").alias("default_lon"))


def locate_photos(photos: DataFrame, marks: DataFrame, defaults: DataFrame, spread: int = 1) -> DataFrame:
    """Set latitude and longitude: the photo's own placemark, else the default of its page.

    Both lookups are equi-joins on unique keys; the second is on the page alone,
    and ``spread`` divides a page that holds very many photos. Points come out of a parser, so Spark would judge
    them by the size of the documents' file and, however many they are, collect them for a broadcast: when it has measured
    them it no longer turns to a plan with more shuffles. So both are merged.
    """
    found = lookup_join(
        photos.withColumn("name", location_key(F.col("photo_url"))),
        marks.select("page_url", "name", F.struct("lat", "lon").alias("_at")).hint("merge"),
        ["page_url", "name"],
        spread,
    )
    found = lookup_join(
        found, defaults.select("page_url", F.struct(F.col("default_lat").alias("lat"), F.col("default_lon").alias("lon"))
                               .alias("_default")).hint("merge"), "page_url", spread,
    )
    at = F.coalesce("_at", "_default")
    return found.select(*photos.columns, at["lat"].alias("latitude"), at["lon"].alias("longitude"))


def locate_photos_by_points(photos: DataFrame, points: DataFrame, key: str = "page_url") -> DataFrame:
    """As :func:`locate_photos`, by one row per page with its points as a map (:func:`document_points`): one join, then a
    lookup within the row. Spark splits a page with very many photos, as nothing else is asked of its rows."""
    lookup = points.select(
        key, F.col("points").alias("_points"),
        F.when(F.col("default_lat").isNotNull(), F.struct(F.col("default_lat").alias("lat"), F.col("default_lon").alias("lon"))).alias("_default"),
    )
    found = lookup_join(photos, lookup, key)
    at = F.coalesce(F.try_element_at("_points", location_key(F.col("photo_url"))), F.col("_default"))
    found = compute_once(found, {"_at": at})
    return found.select(*photos.columns, F.col("_at.lat").alias("latitude"), F.col("_at.lon").alias("longitude"))


def page_tables(
    pages: DataFrame, documents: DataFrame | None = None, spread: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Flat days and photos tables of ``pages`` (date, url, html).

    ``documents`` (kmz_url, kml) holds the landed location attachments. Without it the
    coordinates are null. With it pages are read and parsed once for both tables.
    """
    if documents is None:
        nothing = F.lit(None).cast("double")
        return (
            page_fields(pages).withColumns({"latitude": nothing, "longitude": nothing}),
            photo_records(pages).withColumns({"latitude": nothing, "longitude": nothing}),
        )
    # both tables come from one pass over the pages, whose records are small beside them
    records = reusable(_located_records(pages, documents, spread))
    return records.drop("photos"), records.select(F.inline("photos"))


def nested_records(pages: DataFrame, documents: DataFrame, spread: int = 1) -> DataFrame:
    """One record per page with its located photos as an array of structs, in page order.

    The array is made within the page's row; one row per document, with its points as a
    map, is joined to it.
    """
    return _located_records(pages, documents, spread).drop("photo_count")


def _located_records(pages: DataFrame, documents: DataFrame, spread: int) -> DataFrame:
    records = page_fields(pages, with_photos=True)
    points = document_points(documents).select(
        "kmz_url", F.col("points").alias("_points"), F.col("default_lat").alias("latitude"), F.col("default_lon").alias("longitude")
    )
    located = lookup_join(records, points, "kmz_url", spread).select(*records.columns, "latitude", "longitude", "_points")
    keyed = F.transform("photos", lambda p: F.struct(p.alias("p"), location_key(p.photo_url).alias("key")))
    default = F.when(
        F.col("latitude").isNotNull(), F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    )

    def at(key: Column) -> Column:
        return F.coalesce(F.try_element_at("_points", key), default)

    placed = F.transform(keyed, lambda r: F.struct(r["p"].alias("p"), at(r["key"]).alias("at")))
    names = [f.name for f in records.schema["photos"].dataType.elementType.fields]
    photos = F.transform(
        placed,
        lambda r: F.struct(
            *[r["p"][c].alias(c) for c in names], r["at"]["lat"].alias("latitude"), r["at"]["lon"].alias("longitude")
        ),
    )
    return compute_once(located, {"photos": photos}).drop("_points")

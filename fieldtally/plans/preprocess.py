"""Raw tables to cleaned photos, the geo export and species frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import Box
from ..functions.lists import UNIDENTIFIED, as_list, as_record_names, first_item, list_length, list_to_text
from ..functions.rules import RuleSet
from ..operators.columns import compute_once
from ..operators.filters import available, drop_incomplete, filter_by_bbox
from ..operators.frequency import species_frequency
from ..operators.taxonomy import exclusion_report, exclusion_stats, filter_by_rules
from ..session import reusable
from ..sources.sinks import write_table
from ..sources.tables import read_days, read_photos

# Columns of the geo export.
GEO_COLUMNS = ["date", "page_url", "photo_url", "latitude", "longitude", "label_species"]


def process_days(days: DataFrame) -> DataFrame:
    """Add the species list and its length where the day records name species."""
    if "identified_species" not in days.columns:
        return days
    return compute_once(days, {"identified_species_list": as_list(days, "identified_species")}).withColumn(
        "identified_species_count", list_length(F.col("identified_species_list"))
    )


def process_photos(photos: DataFrame) -> DataFrame:
    """Add the species list and its first name."""
    if "species" not in photos.columns:
        return photos
    return compute_once(photos, {"species_list": as_record_names(photos, "species")}).withColumn(
        "first_species", first_item(F.col("species_list"))
    )


def photos_cleaned(photos: DataFrame) -> DataFrame:
    """Add the joined species text and the first name."""
    if "species_list" not in photos.columns:
        return photos
    names = F.col("species_list")
    return photos.withColumns({"species_list_str": list_to_text(names), "first_species": first_item(names)})


def photo_geospatial(photos: DataFrame) -> DataFrame:
    """Located photos with a species label."""
    label = F.col("first_species") if "first_species" in photos.columns else F.lit(UNIDENTIFIED)
    located = drop_incomplete(photos, ["latitude", "longitude"]).withColumn("label_species", label)
    return available(located, GEO_COLUMNS)


def select_photos(
    photos: DataFrame, rules: RuleSet | None = None, box: Box | None = None, species_col: str = "first_species"
) -> DataFrame:
    """Processed photos inside the box that the rules keep."""
    out = photos if box is None else filter_by_bbox(photos, box)
    return out if rules is None else filter_by_rules(out, rules, species_col)


def preprocess_tables(
    days: DataFrame, photos: DataFrame, rules: RuleSet | None = None, box: Box | None = None
) -> dict[str, DataFrame]:
    """All preprocessing results as lazy frames."""
    days, processed = process_days(days), process_photos(photos)
    in_box = processed if box is None else filter_by_bbox(processed, box)
    kept = select_photos(in_box, rules)
    cleaned = photos_cleaned(kept)
    out = {
        "days": days,
        "photos": kept,
        "photos_cleaned": cleaned,
        "photo_geospatial": photo_geospatial(cleaned),
        "species_frequency": species_frequency(days, kept),
    }
    if rules is not None and "first_species" in in_box.columns:
        out["exclusion_report"] = exclusion_report(exclusion_stats(in_box, rules))
    return out


def run_preprocessing(
    spark: SparkSession,
    days_path: str,
    photos_path: str,
    output_dir: str,
    filter_years: bool = True,
    rules: RuleSet | None = None,
    box: Box | None = None,
    in_fmt: str = "csv",
    out_fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """Read, select, and write ``photos_cleaned``, ``photo_geospatial`` and ``species_frequency``.

    The photos are parsed once: the first sink is read back for the other
    results where its format keeps lists, and materialised otherwise.
    """
    days = process_days(read_days(spark, days_path, filter_years, in_fmt))
    photos = process_photos(read_photos(spark, photos_path, filter_years, in_fmt))
    if box is not None:
        photos = filter_by_bbox(photos, box)
    out: dict[str, DataFrame] = {"days": days}
    if rules is not None and "first_species" in photos.columns:
        out["exclusion_report"] = exclusion_report(exclusion_stats(photos, rules))
    cleaned = photos_cleaned(select_photos(photos, rules))
    path = f"{output_dir}/photos_cleaned"
    if out_fmt == "csv":
        cleaned = reusable(cleaned)
        write_table(cleaned, path, out_fmt)
    else:
        write_table(cleaned, path, out_fmt)
        cleaned = spark.read.format(out_fmt).load(path)
    out["photos"] = out["photos_cleaned"] = cleaned
    out["photo_geospatial"] = photo_geospatial(cleaned)
    write_table(out["photo_geospatial"], f"{output_dir}/photo_geospatial", out_fmt)
    frequency = species_frequency(days, cleaned).orderBy(F.desc("occurrences"), "species")
    write_table(frequency, f"{output_dir}/species_frequency", out_fmt)
    out["species_frequency"] = frequency
    return out

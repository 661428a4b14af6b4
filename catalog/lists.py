"""List parsing, names, frequencies and top-k."""

from pyspark.sql import functions as F

from fieldtally.functions import lists as ls
from fieldtally.functions import text as tx
from fieldtally.operators import frequency as fr
from fieldtally.plans.preprocess import photo_geospatial, photos_cleaned, process_days, process_photos

from .base import DAYS_SQL, PHOTOS_SQL, Registry, days, load, parsed_photos, photos

registry = Registry()


def literals(spark, sf_dir):
    """Part names as list literals in the spellings a writer may use; every fifth one is broken."""
    words = F.split("p_name", " ")
    text = (
        F.when(F.pmod("p_partkey", F.lit(5)) == 0, F.concat(F.lit("['"), words[0], F.lit("', "), words[1], F.lit("]")))
        .when(F.pmod("p_partkey", F.lit(5)) == 1, F.concat(F.lit('["'), words[0], F.lit("\", 'it\\'s "), words[1], F.lit("']")))
        .when(F.pmod("p_partkey", F.lit(5)) == 2, F.lit(""))
        .otherwise(F.concat(F.lit("['"), words[0], F.lit("', '"), words[1], F.lit("']")))
    )
    return load(spark, sf_dir, "part").select("p_partkey", ls.parse_list(text).alias("xs"))


LITERALS_SQL = """parsed AS (
  SELECT p_partkey, split_part(p_name, ' ', 1) AS a,
         CASE WHEN p_partkey % 5 = 1 THEN 'it''s ' ELSE '' END || split_part(p_name, ' ', 2) AS b,
         p_partkey % 5 IN (0, 2) AS is_empty
  FROM part)"""


@registry.add(f"""WITH {LITERALS_SQL}
SELECT p_partkey, CASE WHEN is_empty THEN '' ELSE a || '|' || b END AS items FROM parsed""")
def list_parse(spark, sf_dir):
    return literals(spark, sf_dir).select("p_partkey", F.array_join("xs", "|").alias("items"))


@registry.add(f"""WITH {LITERALS_SQL}
SELECT p_partkey, CASE WHEN is_empty THEN 'Unidentified' ELSE a END AS first,
       CASE WHEN is_empty THEN 0 ELSE 2 END AS n, CASE WHEN is_empty THEN '' ELSE a || ';' || b END AS joined
FROM parsed""")
def list_summaries(spark, sf_dir):
    xs = F.col("xs")
    return literals(spark, sf_dir).select(
        "p_partkey", ls.first_item(xs).alias("first"), ls.list_length(xs).alias("n"), ls.list_to_text(xs).alias("joined")
    )


@registry.add(f"WITH {PHOTOS_SQL} SELECT photo_url, page_url, first_species || '|' || second_species AS names FROM photos")
def record_list_parse(spark, sf_dir):
    rows = parsed_photos(spark, sf_dir)
    return rows.select("photo_url", "page_url", F.array_join("species_list", "|").alias("names"))


@registry.add("""SELECT p_partkey, p_name || ' ' || lower(p_type) AS name, split_part(p_name, ' ', 1) AS genus,
       upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS label FROM part""")
def name_normalize(spark, sf_dir):
    words = F.split("p_name", " ")
    raw = F.concat(F.lit("  "), words[0], F.lit(" cf. "), words[1], F.lit("\t(aff."), F.lower("p_type"), F.lit(") "))
    df = load(spark, sf_dir, "part").select("p_partkey", tx.normalize_name(raw).alias("name"), raw.alias("raw"))
    return df.select(
        "p_partkey", "name", tx.genus(F.col("raw")).alias("genus"), tx.genus_label(F.col("raw")).alias("label")
    )


@registry.add("""SELECT doc_id, text[1:30] || CASE WHEN length(text) > 30 THEN '…' ELSE '' END AS short,
       CASE WHEN length(text) > 45 THEN text[1:40] || '…' ELSE text END AS medium FROM documents""")
def label_truncate(spark, sf_dir):
    t = F.col("text")
    return load(spark, sf_dir, "documents").select(
        "doc_id", tx.truncate_label(t).alias("short"), tx.truncate_label(t, 45, 40).alias("medium")
    )


NAMES_SQL = f"""{PHOTOS_SQL},
names AS (SELECT first_species AS species FROM photos UNION ALL SELECT second_species FROM photos),
freq AS (SELECT species, count(*) AS occurrences, 'photo-level' AS source FROM names GROUP BY species)"""


@registry.add(f"WITH {NAMES_SQL} SELECT * FROM freq")
def item_frequency(spark, sf_dir):
    return fr.species_frequency(days(spark, sf_dir), parsed_photos(spark, sf_dir))


@registry.add(f"""WITH {DAYS_SQL},
names AS (SELECT o_orderpriority AS species FROM days UNION ALL SELECT 'customer ' || (o_custkey % 50) FROM days)
SELECT species, count(*) AS occurrences, 'day-level' AS source FROM names GROUP BY species""")
def item_frequency_by_day(spark, sf_dir):
    return fr.species_frequency(process_days(days(spark, sf_dir)), photos(spark, sf_dir).drop("species"))


@registry.add(f"WITH {NAMES_SQL} SELECT * FROM freq")
def item_frequency_with_fallback(spark, sf_dir):
    return fr.species_frequency_or_days(process_days(days(spark, sf_dir)), parsed_photos(spark, sf_dir))


@registry.add(f"WITH {NAMES_SQL} SELECT * FROM freq ORDER BY occurrences DESC, species LIMIT 15")
def top_items(spark, sf_dir):
    counts = fr.species_frequency(days(spark, sf_dir), parsed_photos(spark, sf_dir))
    return fr.top_k(counts, 15, "occurrences", "species")


@registry.add("""WITH top AS (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 25)
SELECT event_id, CASE WHEN user_id IN (SELECT user_id FROM top) THEN CAST(user_id AS VARCHAR) ELSE 'Other' END AS label
FROM events""")
def top_n_or_other(spark, sf_dir):
    users = load(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user"),
                                                 "user_id")
    # ties are broken on the label's own order, so it is padded to sort like the number
    users = users.withColumn("user", F.lpad("user", 12, " "))
    return fr.top_or_other(users, "user", 25, "label").select("event_id", F.ltrim("label").alias("label"))


@registry.add("SELECT p_type, count(*) AS count FROM part GROUP BY p_type")
def value_counts(spark, sf_dir):
    return fr.value_counts(load(spark, sf_dir, "part"), "p_type")


@registry.add(f"""WITH {PHOTOS_SQL}
SELECT date, page_url, photo_url, index_on_page, full_caption, latitude, longitude, first_species,
       first_species || ';' || second_species AS species_list_str FROM photos""")
def cleaned_photos(spark, sf_dir):
    cleaned = photos_cleaned(parsed_photos(spark, sf_dir))
    return cleaned.drop("species", "species_list", "l_returnflag", "l_discount")


@registry.add(f"""WITH {PHOTOS_SQL}
SELECT date, page_url, photo_url, latitude, longitude, first_species AS label_species FROM photos
WHERE l_returnflag <> 'N'""")
def photo_geospatial_export(spark, sf_dir):
    rows = photos(spark, sf_dir, costly=True)
    known = F.col("l_returnflag") != "N"
    rows = rows.withColumns({c: F.when(known, F.col(c)) for c in ("latitude", "longitude")})
    return photo_geospatial(photos_cleaned(process_photos(rows)))


@registry.add(f"""WITH {PHOTOS_SQL}
SELECT date, photo_url, latitude, longitude, 'Unidentified' AS label_species FROM photos""")
def photo_geospatial_defaults(spark, sf_dir):
    # neither page_url nor species: the label gets its default and the column stays away
    return photo_geospatial(photos(spark, sf_dir).drop("page_url", "species"))


@registry.add(f"""WITH {DAYS_SQL}
SELECT date, url, photo_count, o_orderpriority || '|customer ' || (o_custkey % 50) AS names,
       2 AS identified_species_count FROM days""")
def processed_days(spark, sf_dir):
    rows = process_days(days(spark, sf_dir))
    names = F.array_join("identified_species_list", "|").alias("names")
    return rows.select("date", "url", "photo_count", names, "identified_species_count")

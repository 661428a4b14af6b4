"""Rule-based filtering."""

from pyspark.sql import functions as F

from fieldtally.functions.rules import RuleSet
from fieldtally.operators import rule_tables
from fieldtally.operators import taxonomy as t

from .base import PHOTOS_SQL, RULES, Registry, first_keyword_sql, keep_sql, load, parsed_photos, photos, reason_sql

registry = Registry()

PART_SQL = "part_rows AS (SELECT p_partkey, p_name AS species, p_type || ' ' || p_brand AS caption FROM part)"


def parts(spark, sf_dir):
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("species"), F.concat_ws(" ", "p_type", "p_brand").alias("caption")
    )


@registry.add(f"WITH {PART_SQL} SELECT p_partkey, species, caption FROM part_rows WHERE {keep_sql('species', 'caption')}")
def rule_filter(spark, sf_dir):
    return t.apply_rules(parts(spark, sf_dir), RULES)


@registry.add(f"""WITH {PHOTOS_SQL}
SELECT date, page_url, photo_url, first_species, full_caption FROM photos
WHERE {keep_sql('first_species', 'full_caption')}""")
def rule_filter_photos(spark, sf_dir):
    kept = t.filter_by_rules(parsed_photos(spark, sf_dir), RULES)
    return kept.select("date", "page_url", "photo_url", "first_species", "full_caption")


@registry.add(f"""WITH {PART_SQL}
SELECT p_partkey, {reason_sql('species', first_keyword_sql('caption'))} AS reason FROM part_rows""")
def rule_reasons(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", RULES.reason(F.col("species"), F.col("caption")).alias("reason"))


@registry.add(f"""WITH {PHOTOS_SQL}, k AS (SELECT {keep_sql('first_species', 'full_caption')} AS keep FROM photos)
SELECT count(*) AS rows_before, count(*) FILTER (keep) AS rows_after, count(*) FILTER (NOT keep) AS rows_excluded,
       round(count(*) FILTER (NOT keep) / count(*), 6) AS excluded_share FROM k""")
def rule_audit(spark, sf_dir):
    rows = parsed_photos(spark, sf_dir)
    audit = t.filter_audit(rows, t.keep_column(rows, RULES))
    return audit.withColumn("excluded_share", F.round("excluded_share", 6))


STATS_SQL = f"""{PHOTOS_SQL},
p AS (SELECT first_species, {first_keyword_sql('full_caption')} AS position, date, page_url, index_on_page FROM photos),
s AS (SELECT first_species AS species, count(*) AS count,
             arg_min(position, struct_pack(d := date, p := position)) AS position
      FROM p GROUP BY 1),
r AS (SELECT species, count, {reason_sql('species', 'position')} AS exclusion_reason FROM s)"""


@registry.add(f"WITH {STATS_SQL} SELECT * FROM r WHERE exclusion_reason IS NOT NULL")
def rule_exclusion_stats(spark, sf_dir):
    return t.exclusion_stats(parsed_photos(spark, sf_dir), RULES)


@registry.add(f"""WITH {STATS_SQL} SELECT * FROM r WHERE exclusion_reason IS NOT NULL
ORDER BY count DESC, species LIMIT 10""")
def rule_exclusion_report(spark, sf_dir):
    return t.exclusion_report(t.exclusion_stats(parsed_photos(spark, sf_dir), RULES))


@registry.add(f"""WITH {PHOTOS_SQL},
r AS (SELECT first_species AS species, {reason_sql('first_species', first_keyword_sql('full_caption'))} AS exclusion_reason
      FROM photos)
SELECT species, count(*) AS count, exclusion_reason FROM r WHERE exclusion_reason IS NOT NULL GROUP BY ALL""")
def rule_exclusion_stats_by_row(spark, sf_dir):
    return t.exclusion_stats_by_row(parsed_photos(spark, sf_dir), RULES)


TEXT_RULES = RuleSet(exclude_species=("src3",), include_species=("SRC5",), exclude_genera=("src7",),
                     exclude_caption_keywords=("THE THE", "eau", "und der"))


@registry.add("""SELECT doc_id, source FROM documents
WHERE CASE WHEN source = 'src5' THEN TRUE WHEN source IN ('src3', 'src7') THEN FALSE
           ELSE NOT (contains(lower(text), 'the the') OR contains(lower(text), 'eau') OR contains(lower(text), 'und der'))
      END""")
def rule_filter_long_texts(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", costly=True)
    return t.filter_by_rules(docs, TEXT_RULES, "source", "text").select("doc_id", "source")


@registry.add(f"""WITH {PHOTOS_SQL}
SELECT photo_url, page_url,
       concat_ws(';', CASE WHEN {keep_sql('first_species', None)} THEN first_species END,
                 CASE WHEN {keep_sql('second_species', None)} THEN second_species END) AS kept
FROM photos""")
def rule_filter_lists(spark, sf_dir):
    rows = parsed_photos(spark, sf_dir)
    return rows.select("photo_url", "page_url", F.array_join(RULES.keep_names(F.col("species_list")), ";").alias("kept"))


DEFAULT = RuleSet.from_yaml()


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# Names made of the words of the default rules: kept species, excluded genera, and other
# names, some of them with a keyword in the caption.
@registry.add(f"""WITH named AS (
  SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN {sql_list(DEFAULT.include_species)}[p_partkey % {len(DEFAULT.include_species)} + 1]
                         WHEN p_partkey % 3 = 0 THEN p_name
                         ELSE {sql_list(DEFAULT.exclude_genera)}[p_partkey % {len(DEFAULT.exclude_genera)} + 1] || ' ' || p_name END AS name
  FROM part)
SELECT p_partkey, name FROM named WHERE p_partkey % 7 = 0 OR (p_partkey % 3 = 0 AND p_partkey % 5 <> 0)""")
def rule_filter_default_rules(spark, sf_dir):
    def word(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % len(values) + 1).cast("int"))

    key = F.col("p_partkey")
    genus = F.concat_ws(" ", word(DEFAULT.exclude_genera), "p_name")
    name = F.when(key % 7 == 0, word(DEFAULT.include_species)).when(key % 3 == 0, F.col("p_name")).otherwise(genus)
    caption = F.when(key % 5 == 0, F.concat(F.lit("Seen: "), F.upper(word(DEFAULT.exclude_caption_keywords)), F.lit("!")))
    rows = load(spark, sf_dir, "part").select("p_partkey", name.alias("name"), caption.alias("caption"))
    return t.filter_by_rules(rows, DEFAULT, "name", "caption").select("p_partkey", "name")


#: Syllables of consonant, vowel, consonant, and each followed by "er": thousands of keywords, many of which begin with others.
SYLLABLES = tuple(a + b + c + d for d in ("er", "") for a in "bcdfghklmnprstvw" for b in "aeiou" for c in "bcdglmnprst")


@registry.add(f"""WITH keywords AS (SELECT unnest({list(SYLLABLES)}) AS keyword, unnest(range(1, {len(SYLLABLES) + 1})) AS i),
found AS (SELECT doc_id, arg_min(keyword, i) AS keyword FROM documents JOIN keywords ON contains(lower(text), keyword) GROUP BY doc_id)
SELECT doc_id, keyword IS NULL AS kept, 'caption keyword: ''' || keyword || '''' AS reason FROM documents LEFT JOIN found USING (doc_id)""")
def rule_reasons_many_keywords(spark, sf_dir):
    """Whole texts walked once for thousands of keywords."""
    rules = RuleSet(exclude_caption_keywords=SYLLABLES)
    text = F.col("text")
    return load(spark, sf_dir, "documents").select(
        "doc_id", rules.keep(F.lit("name"), text).alias("kept"), rules.reason(F.lit("name"), text).alias("reason")
    )


@registry.add(f"""WITH {PHOTOS_SQL}, listed AS (
  SELECT 'exclude_species' AS kind, p_name AS value FROM part WHERE p_size % 3 = 0
  UNION ALL SELECT 'include_species', upper(p_name) FROM part WHERE p_size % 6 = 0
  UNION ALL SELECT 'exclude_genera', split_part(p_name, ' ', 1) FROM part WHERE p_size = 7),
ranked AS (SELECT lower(value) AS name, min(CASE kind WHEN 'include_species' THEN 1 WHEN 'exclude_species' THEN 2 ELSE 3 END) AS rank,
                  kind = 'exclude_genera' AS genus FROM listed GROUP BY 1, 3),
judged AS (SELECT page_url, photo_url, first_species, least(s.rank, g.rank) AS rank FROM photos
           LEFT JOIN ranked AS s ON s.name = lower(first_species) AND NOT s.genus
           LEFT JOIN ranked AS g ON g.name = lower(split_part(first_species, ' ', 1)) AND g.genus)
SELECT page_url, photo_url, coalesce(rank = 1, TRUE) AS keep,
       CASE rank WHEN 2 THEN 'species in exclude list: ' || first_species
                 WHEN 3 THEN 'genus excluded: ' || upper(split_part(first_species, ' ', 1)[1]) || lower(split_part(first_species, ' ', 1)[2:])
       END AS exclusion_reason FROM judged""")
def rule_table(spark, sf_dir):
    """Rules that are a table themselves: names of parts."""
    part = load(spark, sf_dir, "part")

    def listed(kind, value, where):
        return part.where(where).select(F.lit(kind).alias("kind"), value.alias("value"))

    rules = listed("exclude_species", F.col("p_name"), "p_size % 3 = 0").union(
        listed("include_species", F.upper("p_name"), "p_size % 6 = 0")
    ).union(listed("exclude_genera", F.substring_index("p_name", " ", 1), "p_size = 7"))
    rows = photos(spark, sf_dir).withColumn("first_species", F.regexp_extract("full_caption", r"^(.*?) \(", 1))
    out = rule_tables.judge_by_table(rows, rules, spread=4)
    return out.select("page_url", "photo_url", "keep", "exclusion_reason")

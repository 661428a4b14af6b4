"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm import alignment, bpe, decontaminate, html_text, near_duplicates, pii, quality, resampling, sharding, simhash, substrings, token_files, url_filters
from fieldtally.llm.common import table
from fieldtally.llm.registry import ORACLES, QUERIES, query  # noqa: F401
from fieldtally.session import scratch_folder


@query()
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query()
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "token-files")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    token_files.write(table(spark, sf_dir, "documents"), folder, tokenizer, end_id=1, meta=("lang", "source"))
    return token_files.checksums(token_files.read_positions(spark, folder))


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.judge(documents, quality.train(documents, table(spark, sf_dir, "labels")))


@query()
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharding.shards(rows, count=24, key=1).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: Verdict, host and path start of each rule.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

# The test pages hold neither canonical links nor redirects, so the edges here are those of tracking parameters.
URLS_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url,
         CASE WHEN contains(url, '://') THEN lower(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*')) ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^[^#]*') END AS node
  FROM pages
),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT DISTINCT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p)
  GROUP BY host, path
),
edges AS (
  SELECT DISTINCT node AS a, regexp_replace(regexp_replace(node, '([?&])(utm_[a-z]+|gclid|fbclid)=[^&]*&?', '\1', 'gi'), '[?&]$', '') AS b
  FROM parts WHERE node IS NOT NULL
),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT node, b FROM reach JOIN both_ways ON other = a),
decided AS (
  SELECT reach.node, coalesce(bool_or(verdict = 'allow'), FALSE) AS allowed, coalesce(bool_or(verdict = 'block'), FALSE) AS blocked
  FROM reach JOIN (SELECT DISTINCT node, host, path FROM parts) AS q ON other = q.node LEFT JOIN fits USING (host, path)
  GROUP BY reach.node
)
SELECT page_id, url, host, path, rule,
       coalesce(verdict, CASE WHEN blocked AND NOT allowed THEN 'block' END, 'allow') AS verdict,
       CASE WHEN verdict IS NOT NULL THEN 'rule' WHEN blocked AND NOT allowed THEN 'alias' ELSE 'default' END AS decided_by
FROM parts LEFT JOIN fits USING (host, path) LEFT JOIN decided USING (node)
"""


@query(URLS_SQL.replace("\\\\1", "\\1"))
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query()
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query()
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query()
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"))


@query()
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.joined(table(spark, sf_dir, "documents"))


@query()
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.report(table(spark, sf_dir, "documents"), *paths)


# DuckDB has no CRC-32: each distinct feature goes through the byte table, which follows from the polynomial.
RESAMPLING_SQL = r"""
WITH tab AS (
  SELECT list(list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) AS r(n)
),
docs AS (SELECT 'd' AS side, doc_id, row_number() OVER () AS row, text FROM documents UNION ALL SELECT 'b', item_id, -row_number() OVER (), text FROM benchmark),
words AS (
  SELECT side, doc_id, row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM docs
),
grams AS (
  SELECT side, row, unnest(w) AS g FROM words
  UNION ALL SELECT side, row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
),
coded AS (
  SELECT g, xor(list_reduce([4294967295] || list_transform(range(octet_length(encode(g))), lambda i: ('0x' || substr(hex(g), 2 * i + 1, 2))::BIGINT),
                            lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT g FROM grams), tab
),
sums AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM grams JOIN coded USING (g) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM sums
),
weights AS (
  SELECT row, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM grams JOIN coded USING (g) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row
),
scored AS (
  SELECT doc_id, row, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (row) WHERE side = 'd'
),
placed AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (row)
"""


@query(RESAMPLING_SQL)
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))

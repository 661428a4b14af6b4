"""Jobs over pages: the given raw pages, and pages written from the other tables."""

from pyspark.sql import functions as F

from fieldtally.functions import urls
from fieldtally.operators import pages as p
from fieldtally.operators import placemarks as pm

from .base import SITE, Registry, load

registry = Registry()

RAW_LINKS_SQL = """tags AS (
  SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS a FROM pages),
links AS (
  SELECT page_id, url, CAST(i AS INTEGER) AS pos, regexp_extract(a[i], 'href="([^"]*)"', 1) AS href,
         trim(regexp_extract(a[i], '>([^<]*)<', 1)) AS text
  FROM (SELECT *, unnest(generate_series(1, len(a))) AS i FROM tags))"""


@registry.add(f"""WITH {RAW_LINKS_SQL}
SELECT page_id, pos, href, text, regexp_extract(url, '^[a-z]+://[^/?#]+') || href AS link FROM links""")
def page_links(spark, sf_dir):
    return p.page_links(load(spark, sf_dir, "pages", costly=True), "page_id").drop("url")


# Every other raw page gets a weather sentence, two names and an attachment where its article ends.
MARKED_SQL = """marked AS (SELECT page_id, url, page_id % 2 = 0 AND contains(html, '</article>') AS has FROM pages)"""


@registry.add(f"""WITH {MARKED_SQL}
SELECT page_id, CASE WHEN has THEN 'Weather was mild & dry on day ' || page_id || ', with hardly any wind up to the evening' END AS weather_summary,
       CASE WHEN has THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || '/loc/date-loc' || page_id || '.htm' END AS kmz_url,
       CASE WHEN has THEN 'Rosa alba, sp. ' || page_id END AS identified_species_text, CASE WHEN has THEN 2 ELSE 0 END AS names
FROM marked""")
def page_fields_raw(spark, sf_dir):
    """Whole raw pages."""
    marker = F.format_string(
        "<p>Weather was mild &amp; dry on day %d, with hardly any wind up to the evening</p><p><b>Identified species:</b>"
        " <i>Rosa</i> alba, sp. %d<br>more</p><p><a href=/loc/date-loc%d.htm>map</a> <a href=b.kmz>b</a></p></article>",
        "page_id", "page_id", "page_id",
    )
    html = F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit("</article>"), marker)).otherwise(F.col("html"))
    fields = p.page_fields(load(spark, sf_dir, "pages", costly=True).withColumn("html", html))
    return fields.select(
        "page_id", "weather_summary", "kmz_url", "identified_species_text", F.size("identified_species").alias("names")
    )


# ---- index pages: one per order, linking to its date and to the next one ----


def index_pages(spark, sf_dir):
    day, following = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd")
    html = F.format_string(
        "<html><body><!-- <a href=\"date-en/1990-01-01.htm\">1990-01-01</a> --><ul>"
        "<li><a href=\"date-en/%s.htm\">%s</a><li><A class=x HREF='date-en/%s.htm'> </A>"
        "<li><a href=\"date-en/latest.htm\">latest</a><li><a href=\"other.htm\">%s</a></ul></body></html>",
        day, day, following, day,
    )
    return load(spark, sf_dir, "orders", costly=True).select(F.lit(f"{SITE}/x/index.htm").alias("url"), html.alias("html"))


@registry.add(f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date FROM orders
           UNION ALL SELECT CAST(o_orderdate AS DATE) + 1 FROM orders)
SELECT date, '{SITE}/x/date-en/' || strftime(date, '%Y-%m-%d') || '.htm' AS url FROM d""")
def index_links(spark, sf_dir):
    return p.index_links(index_pages(spark, sf_dir))


# ---- day pages: one per part ------------------------------------------------


def day_pages(spark, sf_dir):
    html = F.format_string(
        "<html><head><title>Day</title><script>var a='<a href=\"/pictures/archives/no.jpg\">';</script></head><body>"
        "<h1>Day</h1><p><b>Weather</b>: Temperature %d.5&deg; (average), min. %d&#176;, max. 31°.<br>\n"
        "Wind 2 m/s. Precipitation %d.0 mm.</p>"
        "<p><b>Identified species</b>: <i>%s</i>, , %s.<br>And more</p>"
        "<table><tr><td><a href='../loc/date-loc%d.htm'>Map</a> <a href=\"x.kmz\">K</a></td></tr></table>"
        "<p><a href=\"/pictures/archives/2020/R%d/index.htm\">Roll</a>"
        "<a href=\"/pictures/archives/2020/R%d/jpeg/%02db.JPG\"><img src=\"t.jpg\"></a> A %s &amp; more "
        "(<a href=\"../fungi_en/sp%d.htm\"><i>%s</i></a>, <a href=\"../en/list.htm\">all</a>) found</p>"
        "<p><a href='/pictures/archives/2020/R%d/jpeg/99.png'>no bracket</a></p></body></html>",
        "p_size", "p_size", "p_size", "p_name", "p_brand", "p_partkey", "p_size", "p_size", "p_size", "p_type",
        "p_partkey", "p_name", "p_size",
    )
    return load(spark, sf_dir, "part", costly=True).select(
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")).alias("date"),
        F.format_string(f"{SITE}/date-en/%d.htm", "p_partkey").alias("url"),
        html.alias("html"),
    )


@registry.add(f"""SELECT '{SITE}/date-en/' || p_partkey || '.htm' AS url,
       'Weather : Temperature ' || p_size || '.5° (average), min. ' || p_size || '°, max. 31°. Wind 2 m/s. Precipitation '
         || p_size || '.0 mm.' AS weather_summary,
       p_name || ' , , ' || p_brand AS identified_species_text, p_name || '|' || p_brand AS names,
       '{SITE}/loc/date-loc' || p_partkey || '.htm' AS kmz_url, 2::BIGINT AS photo_count FROM part""")
def page_fields(spark, sf_dir):
    fields = p.page_fields(day_pages(spark, sf_dir))
    return fields.select("url", "weather_summary", "identified_species_text",
                         F.array_join("identified_species", "|").alias("names"), "kmz_url", "photo_count")


@registry.add(f"SELECT p_partkey, '{SITE}/loc/date-loc' || p_partkey || '.htm' AS first FROM part")
def page_first_attachment(spark, sf_dir):
    found = p.page_attachments(day_pages(spark, sf_dir))
    return found.select(
        F.regexp_extract("page_url", r"(\d+)\.htm$", 1).cast("bigint").alias("p_partkey"), F.col("kmz_url").alias("first")
    )


RECORDS_SQL = f"""records AS (
  SELECT DATE '2020-01-01' + p_size AS date, '{SITE}/date-en/' || p_partkey || '.htm' AS page_url,
         '{SITE}/pictures/archives/2020/R' || p_size || '/jpeg/' || lpad(CAST(p_size AS VARCHAR), 2, '0') || 'b.JPG' AS photo_url,
         2 AS index_on_page,
         'Roll A ' || p_type || ' & more ( ' || p_name || ' , all ) found' AS full_caption,
         'Roll A ' || p_type || ' & more' AS common_name,
         p_name || '@{SITE}/fungi_en/sp' || p_partkey || '.htm' AS refs, p_partkey, p_size FROM part
  UNION ALL
  SELECT DATE '2020-01-01' + p_size, '{SITE}/date-en/' || p_partkey || '.htm',
         '{SITE}/pictures/archives/2020/R' || p_size || '/jpeg/99.png', 3, 'no bracket', 'no bracket', '', p_partkey, p_size
  FROM part)"""


def flat_refs(df):
    refs = F.transform("species", lambda s: F.concat_ws("@", s.latin_name, s.page_url))
    return df.withColumn("refs", F.array_join(refs, "|")).drop("species", "location_text")


@registry.add(f"WITH {RECORDS_SQL} SELECT * EXCLUDE (p_partkey, p_size) FROM records")
def page_records(spark, sf_dir):
    return flat_refs(p.photo_records(day_pages(spark, sf_dir)))


@registry.add(f"""WITH {RECORDS_SQL}
SELECT page_url, index_on_page, strftime(date, '%Y-%m-%d') || '/00' || index_on_page || '_'
       || CASE WHEN index_on_page = 2 THEN lpad(CAST(p_size AS VARCHAR), 2, '0') || 'b.JPG' ELSE '99.png' END AS image_key
FROM records""")
def image_keys(spark, sf_dir):
    records = p.photo_records(day_pages(spark, sf_dir))
    key = urls.image_key(F.col("date"), F.col("index_on_page"), F.col("photo_url"))
    return records.select("page_url", "index_on_page", key.alias("image_key"))


# ---- location attachments: one per part, some broken, some without points ----


def attachments(spark, sf_dir):
    """Every fifth document is malformed, every fifth has only a line, the rest repeat a name."""
    lon, lat = F.format_string("-95.%03d", F.pmod("p_partkey", F.lit(1000))), F.format_string("30.%02d", "p_size")
    line = F.concat(F.lit("<LineString><coordinates>\n "), lon, F.lit(","), lat, F.lit(",5 -1,2,0</coordinates></LineString>"))
    point = F.format_string(
        "<Folder><k:Placemark id='a'><k:name> R%d-%02d </k:name><k:Point><k:coordinates>1.5,2.5,0</k:coordinates></k:Point>"
        "</k:Placemark><Placemark><name>bad</name><Point><coordinates>x,1</coordinates></Point></Placemark>"
        "<Placemark><name>R%d-%02d</name><Point><coordinates> %s,%s </coordinates></Point></Placemark></Folder>",
        "p_size", "p_size", "p_size", "p_size", lon, lat,
    )
    kind = F.pmod("p_partkey", F.lit(5))
    body = F.when(kind == 0, F.concat(F.lit("<Folder>"), point)).when(kind == 1, line).otherwise(point)
    return load(spark, sf_dir, "part", costly=True).select(
        F.format_string(f"{SITE}/loc/date-loc%d.htm", "p_partkey").alias("kmz_url"),
        F.format_string(f"{SITE}/date-en/%d.htm", "p_partkey").alias("page_url"),
        F.concat(F.lit("<kml xmlns:k='http://k'>"), body, F.lit("</kml>")).alias("kml"),
    )


POINT_SQL = """CAST('30.' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS DOUBLE) AS lat,
         CAST('-95.' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS DOUBLE) AS lon"""


@registry.add(f"""SELECT '{SITE}/date-en/' || p_partkey || '.htm' AS page_url,
       'R' || p_size || '-' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS name, {POINT_SQL}
FROM part WHERE p_partkey % 5 NOT IN (0, 1)""")
def placemark_rows(spark, sf_dir):
    return pm.placemarks(attachments(spark, sf_dir))


@registry.add(f"""SELECT '{SITE}/date-en/' || p_partkey || '.htm' AS page_url,
       CASE WHEN p_partkey % 5 = 1 THEN lat ELSE 2.5::DOUBLE END AS default_lat,
       CASE WHEN p_partkey % 5 = 1 THEN lon ELSE 1.5::DOUBLE END AS default_lon
FROM (SELECT p_partkey, {POINT_SQL} FROM part) WHERE p_partkey % 5 <> 0""")
def placemark_defaults(spark, sf_dir):
    return pm.default_points(attachments(spark, sf_dir))


LOCATED_SQL = f"""{RECORDS_SQL}, points AS (SELECT p_partkey, {POINT_SQL} FROM part),
located AS (
  SELECT r.* EXCLUDE (p_size),
         CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 OR index_on_page = 2 THEN lat
              ELSE 2.5::DOUBLE END AS latitude,
         CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 OR index_on_page = 2 THEN lon
              ELSE 1.5::DOUBLE END AS longitude
  FROM records r JOIN points USING (p_partkey))"""


@registry.add(f"WITH {LOCATED_SQL} SELECT * EXCLUDE (p_partkey) FROM located")
def placemark_join(spark, sf_dir):
    pages, docs = day_pages(spark, sf_dir), attachments(spark, sf_dir)
    return flat_refs(pm.locate_photos_by_points(p.photo_records(pages), pm.document_points(docs, key="page_url")))


@registry.add(f"WITH {LOCATED_SQL} SELECT * EXCLUDE (p_partkey) FROM located")
def placemark_join_tables(spark, sf_dir):
    """The same by two lookup tables, one of named points and one of default points."""
    pages, docs = day_pages(spark, sf_dir), attachments(spark, sf_dir)
    located = pm.locate_photos(p.photo_records(pages), pm.placemarks(docs), pm.default_points(docs), spread=4)
    return flat_refs(located)


@registry.add(f"""WITH {LOCATED_SQL} SELECT page_url, photo_url, latitude, longitude FROM located""")
def page_assembly_photos(spark, sf_dir):
    docs = attachments(spark, sf_dir).drop("page_url")
    return pm.page_tables(day_pages(spark, sf_dir), docs)[1].select("page_url", "photo_url", "latitude", "longitude")


@registry.add(f"""WITH {LOCATED_SQL}
SELECT page_url AS url, 2::BIGINT AS photo_count,
       CASE WHEN p_partkey % 5 <> 0 THEN latitude END AS latitude,
       CASE WHEN p_partkey % 5 <> 0 THEN longitude END AS longitude
FROM located WHERE index_on_page = 3""")
def page_assembly_days(spark, sf_dir):
    docs = attachments(spark, sf_dir).drop("page_url")
    return pm.page_tables(day_pages(spark, sf_dir), docs)[0].select("url", "photo_count", "latitude", "longitude")


@registry.add(f"WITH {LOCATED_SQL} SELECT page_url, photo_url, full_caption, latitude, longitude FROM located")
def page_flatten(spark, sf_dir):
    records = pm.nested_records(day_pages(spark, sf_dir), attachments(spark, sf_dir).drop("page_url"))
    _, flat = p.flatten_pages(records)
    return flat.select("page_url", "photo_url", "full_caption", "latitude", "longitude")


@registry.add("""SELECT page_id, 'https://o.org/en' || '/fr/' || page_id || '.htm?x=' || page_id AS a,
       'https://o.org/' || page_id AS b, regexp_extract(url, '^[^#]*') || '#n' AS c FROM pages""")
def url_join(spark, sf_dir):
    base = F.lit("https://o.org/en/a/b.htm")
    ref = F.format_string("../fr/./%d.htm?x=%d", "page_id", "page_id")
    return load(spark, sf_dir, "pages", costly=True).select(
        "page_id",
        urls.join_url(base, ref).alias("a"),
        urls.join_url(base, F.format_string("/%d", "page_id")).alias("b"),
        urls.join_url(F.col("url"), F.lit("#n")).alias("c"),
    )

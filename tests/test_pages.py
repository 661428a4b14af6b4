from datetime import date

from pyspark.sql import functions as F

from fieldtally.operators import pages as p
from fieldtally.operators import placemarks as pm

DAY = date(2023, 1, 1)
URL = "https://obs.example.org/date-en/2023-01-01.htm"


def page(spark, html, url=URL):
    return spark.createDataFrame([(DAY, url, html)], "date date, url string, html string")


def index(spark, html):
    df = page(spark, html, "https://obs.example.org/indexc.htm")
    return [tuple(r) for r in p.index_links(df).collect()]


def test_index_dates_are_sorted_if_asked(spark):
    html = "<ul><li><a href='date-en/1999-3-9.htm'>1999-3-9</a><li><a href='date-en/2001-12-24.htm'>2001-12-24</a>" \
        "<li><a href='notes.htm'>1999-3-10</a></ul>"
    df = page(spark, html, "https://obs.example.org/log/index.htm")
    found = [tuple(r) for r in p.index_links(df, newest_first=True).collect()]
    assert found == [
        (date(2001, 12, 24), "https://obs.example.org/log/date-en/2001-12-24.htm"),
        (date(1999, 3, 9), "https://obs.example.org/log/date-en/1999-3-9.htm"),
    ]
    assert sorted(index(spark, html)) == sorted((d, u.replace("/log", "")) for d, u in found)


def test_index_dates_from_the_target(spark):
    html = "<a href='date-en/1987-05-30.htm'><img src=s.gif></a><a href='date-en/1987-99-01.htm'>next</a>" \
        "<a href='date-en/1.htm'>1988-2-29</a><a href='date-en/2.htm'>1989-2-29</a>"
    assert sorted(d for d, _ in index(spark, html)) == [date(1987, 5, 30), date(1988, 2, 29)]


def test_photo_in_a_list_item(spark):
    html = "<ol><li>intro<li><a href='/pictures/archives/1991/Z9/jpeg/31b.gif'>open</a> Under an oak, " \
        "see <a href=../en/quercus_robur.htm><b>Quercus</b> robur</a>!<li>outro</ol>"
    [r] = p.photo_records(page(spark, html)).collect()
    assert (r.date, r.index_on_page) == (DAY, 1)
    assert r.photo_url == "https://obs.example.org/pictures/archives/1991/Z9/jpeg/31b.gif"
    assert r.full_caption == "open Under an oak, see Quercus robur !"
    assert [s.page_url for s in r.species] == ["https://obs.example.org/en/quercus_robur.htm"]


def test_photo_positions_names_and_links(spark):
    html = """<table><tr><td><a href="/pictures/archives/2023/A1/index.htm">roll</a></td>
      <td><a href="../pictures/archives/2023/A1/jpeg/07b.JPG?w=1">x</a></td>
      <td><A HREF='../pictures/archives/2023/A1/jpeg/08b.png'><img></A> Parasol &amp; co (<i>big</i>)
        <a href="/en/list.htm">all</a><a href="/ru/b_c.htm"><i>B</i> <b>c</b></a><a href="/de/d_e.htm">D e</a></td></tr></table>
      <!-- <p><a href="/pictures/archives/no.jpg">no</a></p> -->"""
    [r] = p.photo_records(page(spark, html)).collect()
    assert (r.index_on_page, r.common_name) == (3, "Parasol & co")
    assert [tuple(s) for s in r.species] == [("Bc", "https://obs.example.org/ru/b_c.htm")]


def fields(spark, html):
    return p.page_fields(page(spark, html)).first()


def test_day_fields(spark):
    r = fields(
        spark,
        """<p><b>Weather</b> Temperature 25.0° (average), min. 20°, max. 31°. Precipitation 1.0 mm.</p><p>later</p>
        <p>We saw: <b>Identified species today</b>: <i>A b</i>, , C d.<br>E f</p><a href="x.txt">x</a>
        <a href="../loc/date-loc.htm">map</a><a href="b.kmz">kmz</a>""",
    )
    assert r.weather_summary == "Weather Temperature 25.0° (average), min. 20°, max. 31°. Precipitation 1.0 mm."
    assert r.identified_species_text == "A b , , C d"
    assert r.identified_species == ["A b", "C d"]
    assert r.kmz_url == "https://obs.example.org/loc/date-loc.htm"
    assert r.photo_count == 0


def test_day_fields_absent(spark):
    r = fields(spark, "<p>Bad Weather</p><p>Identified species: in the same text</p><p><i>Identified species</i>: A b</p>")
    assert (r.weather_summary, r.identified_species_text, r.identified_species, r.kmz_url) == (None, None, [], None)


def test_weather_element(spark):
    long = "temperature and wind and rain, all of it in more than fifty characters"
    assert fields(spark, f"<p><b>Weather {long}</b> not this</p>").weather_summary == f"Weather {long}"
    assert fields(spark, f"<p><b>Weather</b> {long}</p><p>x</p>").weather_summary == f"Weather {long}"
    short = "<div><p>Weather</p><p>mild</p></div><div>footer</div>"
    assert fields(spark, short).weather_summary == "Weather mild"


KML = """<?xml version="1.0"?><kml xmlns:k="http://k"><Document><name>doc</name><Folder>
  <!-- <Placemark><name>gone</name><Point><coordinates>9,9</coordinates></Point></Placemark> -->
  <Placemark><name>line</name><LineString><coordinates>7,8 9,10</coordinates></LineString></Placemark>
  <k:Placemark><k:name> A1-07 </k:name><k:Point><k:coordinates> -95.5,30.25,12 </k:coordinates></k:Point></k:Placemark>
  <Placemark><name>bad</name><Point><coordinates>x,1</coordinates></Point></Placemark>
  <Placemark><Point><coordinates>1,2</coordinates></Point></Placemark>
  <Placemark><name><![CDATA[B & C]]></name><Point><coordinates>3,4</coordinates></Point></Placemark>
  <Placemark><name>A1-07</name><Point><coordinates>-96,31</coordinates></Point></Placemark>
</Folder></Document></kml>"""
LINE = "<kml><Placemark><LineString><coordinates> oops </coordinates></LineString></Placemark>" \
    "<MultiGeometry><LineString><coordinates>\n 5.5,6.5,0 7,8</coordinates></LineString></MultiGeometry></kml>"


def documents(spark):
    rows = [("p1", KML), ("p2", LINE), ("p3", KML.replace("</Folder>", "")), ("p4", None), ("p5", "<kml/>"), ("p6", "text")]
    return spark.createDataFrame(rows, "page_url string, kml string")


def test_placemarks(spark):
    got = {tuple(r) for r in pm.placemarks(documents(spark)).collect()}
    assert got == {("p1", "A1-07", 31.0, -96.0), ("p1", "B & C", 4.0, 3.0)}


def test_default_points(spark):
    got = {tuple(r) for r in pm.default_points(documents(spark)).collect()}
    assert got == {("p1", 30.25, -95.5), ("p2", 6.5, 5.5)}


def test_points_are_not_collected_for_a_broadcast(spark, tmp_path):
    """By the size of the small file that they are parsed from, Spark would broadcast them, however many they are."""
    spark.createDataFrame([(URL, KML)], "page_url string, kml string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    photos = spark.createDataFrame([(URL, f"https://o/archives/2023/A1/jpeg/0{i}b.jpg") for i in (7, 9)], "page_url string, photo_url string")
    found = pm.locate_photos(photos, pm.placemarks(docs), pm.default_points(docs), spread=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BroadcastExchange" not in plan
    assert sorted((r.photo_url[-7:], r.latitude, r.longitude) for r in found.collect()) == [("07b.jpg", 31.0, -96.0), ("09b.jpg", 30.25, -95.5)]


def test_location_key(column_of):
    urls = ["https://o/archives/2023/A1/jpeg/07b.jpg", "https://o/archives/2023", "https://o/archives/2023/A1/b7.jpg", "x", None]
    assert column_of(urls, p.location_key) == ["A1-07", None, None, None, None]


def test_page_tables_and_nested_form(spark):
    html = """<p><a href="/pictures/archives/2023/A1/jpeg/07b.jpg">x</a> one</p>
              <p><a href="/pictures/archives/2023/A1/jpeg/08b.jpg">x</a> two</p><a href="loc.kmz">kmz</a>"""
    other = spark.createDataFrame([(DAY, "https://obs.example.org/z.htm", "<p>empty</p>")], "date date, url string, html string")
    pages = page(spark, html).union(page(spark, html)).union(other)  # a copy of a page must not multiply anything
    docs = spark.createDataFrame([("https://obs.example.org/date-en/loc.kmz", KML)], "kmz_url string, kml string")
    days, photos = pm.page_tables(pages, docs, spread=3)
    assert sorted((r.photo_count, r.latitude) for r in days.where(F.col("photo_count") > 0).collect()) == [(2, 30.25)] * 2
    found = sorted((r.photo_url[-7:], r.latitude, r.longitude) for r in photos.collect())
    assert found == [("07b.jpg", 31.0, -96.0)] * 2 + [("08b.jpg", 30.25, -95.5)] * 2

    flat_days, flat_photos = p.flatten_pages(pm.nested_records(pages, docs, spread=2))
    assert sorted(r.photo_count for r in flat_days.collect()) == [0, 2, 2]
    assert flat_photos.columns == photos.columns
    assert sorted(map(str, flat_photos.collect())) == sorted(map(str, photos.collect()))

    without, lonely = pm.page_tables(page(spark, html))
    assert [r.latitude for r in lonely.collect()] == [None, None] and without.first().photo_count == 2


def captions(spark, html):
    rows = p.photo_records(page(spark, html)).sort("index_on_page").collect()
    return [(r.full_caption, [s.latin_name for s in r.species]) for r in rows]


PHOTO = "<a href='/pictures/archives/2020/K1/jpeg/{}b.jpg'></a>"


def test_caption_comes_from_the_element_of_the_link(spark):
    cell = f"<table><tr><td>{PHOTO.format(1)}<p>Wax cap (<a href=../en/w.htm>Hygrocybe</a>)</p></td><td>other</td></tr></table>"
    assert captions(spark, cell) == [("Wax cap ( Hygrocybe )", ["Hygrocybe"])]
    spans = f"<p><span>{PHOTO.format(1)} one <a href=en/a.htm>Aa</a></span> and <span>{PHOTO.format(2)} two <a href=en/b.htm>Bb</a></span></p>"
    assert captions(spark, spans) == [("one Aa", ["Aa"]), ("two Bb", ["Bb"])]
    loose = f"{PHOTO.format(1)}<br>no element <i>around</i>"
    assert captions(spark, loose) == [("no element around", [])]
    broken = f"</div><p>x<p>{PHOTO.format(1)} y</b><img> z"
    assert captions(spark, broken) == [("y z", [])]


def test_many_photos_in_one_element_take_linear_time(spark):
    import time

    html = "<td>" + "".join(f"{PHOTO.format(i)} <a href=en/s{i}.htm>Sp {i}</a>" for i in range(400)) + "</td>"
    captions(spark, html)
    began = time.time()
    found = captions(spark, html)
    assert len(found) == 400 and len(found[0][1]) == 400
    assert time.time() - began < 8


def test_several_documents_of_a_page(spark):
    """The place within a document decides; between equal places the result does not hang on the order of rows."""
    mark = lambda n, x: f"<Placemark><name>{n}</name><Point><coordinates>{x},{x}</coordinates></Point></Placemark>"
    kml = lambda *m: "<kml>" + "".join(m) + "</kml>"
    docs = [("p", kml(mark("a", 1), mark("b", 2))), ("p", kml(mark("b", 3), mark("a", 4))), ("q", "<kml>"), ("r", kml("<LineString><coordinates>5,6 7,8</coordinates></LineString>"))]
    for order in (docs, docs[::-1]):
        df = spark.createDataFrame(order, "page_url string, kml string").coalesce(1)
        rows = {r.page_url: r for r in pm.document_points(df, key="page_url").collect()}
        assert {k: v.lat for k, v in rows["p"].points.items()} == {"a": 4.0, "b": 2.0} and rows["p"].default_lat in (1.0, 3.0)
        first = rows["p"].default_lat if order is docs else first
        assert rows["p"].default_lat == first == rows["p"].default_lon
        assert (rows["r"].default_lat, rows["r"].default_lon) == (6.0, 5.0) and "q" not in rows
        assert [tuple(r) for r in pm.default_points(df).orderBy("page_url").collect()] == [("p", 1.0, 1.0), ("r", 6.0, 5.0)]


def test_small_tables_are_dealt_out_before_parsers(spark):
    from catalog.base import PIECES_PER_CORE, load

    parts = load(spark, "/root/testdata/sf0.001", "part", costly=True)
    assert parts.rdd.getNumPartitions() == PIECES_PER_CORE * spark.sparkContext.defaultParallelism


def test_elements_around_photo_links():
    tokens = ["<ul>", "<li>", "<a href=/pictures/archives/1.jpg>", "x", "</a>", "<li>", "<br>", "y", "</ul>", "<A href='/pictures/archives/2.jpg'>"]
    assert p._holders(tokens) == ([(2, 1), (9, -1)], [(1, 5), (-1, 10)])

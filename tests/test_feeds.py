from datetime import datetime

from pyspark.sql import functions as F

from feedlake.operators import incremental as I
from feedlake.operators import integrity as C
from feedlake.operators import upsert as U
from feedlake.sources import jsonfeed, route, xmlfeed

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:itunes="x" xmlns:media="y" xmlns:atom="z"><channel><title> Show &amp; Tell </title><link>https://s</link>
<description><![CDATA[About]]></description><itunes:author>Ann</itunes:author><itunes:image href="https://i"/><itunes:category text="Tech"/>
<item><title>One</title><guid isPermaLink="false">g1</guid><pubDate>Fri, 11 Mar 2027 08:30:00 GMT</pubDate><itunes:duration>02:03:04</itunes:duration><enclosure url="a.mp3" type="audio/mpeg" length="1"/></item>
<item><title>Two</title><pubDate>Sun, 18 Mar 2027 08:30:00 GMT</pubDate><enclosure url="p.pdf" type="application/pdf"/><enclosure url="b.ogg"/></item>
<item><link>https://three</link><media:content url="c.aac"/></item><item><title>nothing</title></item></channel></rss>"""
ATOM = """<feed><title>At</title><author><name>Bo</name></author><entry><id>e1</id><title>E</title><updated>2026-01-02T00:00:00Z</updated><link rel="alternate" href="https://e"/><link rel="enclosure" href="e.mp3" type="audio/mpeg"/></entry></feed>"""
JSON = """ {"title":"J","authors":[{"name":"Cy"}],"icon":"i","items":[{"id":7,"title":null,"attachments":[{"url":"v.mp4","mime_type":"video/mp4"},{"url":"a.mp3","mime_type":"audio/mpeg","duration_in_seconds":61}],"audio_url":"own.mp3"},
{"url":"u","duration":"1:00","date_published":"bad","published":"2026-01-01"},{"summary":"lost"}]}"""


def test_rss(spark):
    parsed = xmlfeed.parse(spark.createDataFrame([(1, RSS), (2, "<rss><channel>"), (3, "[]")], "k int, content string"))
    m = {r.k: r for r in xmlfeed.metadata(parsed, "k").collect()}[1]
    assert (m.title, m.author, m.description, m.link, m.image_url, m.category, m.total_feed_episodes) == ("Show & Tell", "Ann", "About", "https://s", "https://i", "Tech", 4)
    assert {r.k for r in parsed.filter(xmlfeed.is_broken()).collect()} >= {2, 3}
    e = xmlfeed.episodes(xmlfeed.identified(xmlfeed.items(parsed, "k")), "k", "pos").orderBy("pos").collect()
    assert [(r.guid, r.title, r.audio_url, r.enclosure_type, r.duration) for r in e] == [("g1", "One", "a.mp3", "audio/mpeg", 7384), ("b.ogg", "Two", "b.ogg", "audio/mpeg", None), ("c.aac", "Untitled Episode", "c.aac", "audio/mpeg", None)]


def test_atom(spark):
    parsed = xmlfeed.parse(spark.createDataFrame([(1, ATOM)], "k int, content string"))
    m = xmlfeed.metadata(parsed).first()
    assert (m.title, m.author, m.total_feed_episodes) == ("At", "Bo", 1)
    e = xmlfeed.episodes(xmlfeed.identified(xmlfeed.items(parsed))).first()
    assert (e.guid, e.audio_url, e.link, e.published_at) == ("e1", "e.mp3", "https://e", datetime(2026, 1, 2))


def test_json(spark):
    parsed = jsonfeed.parse(spark.createDataFrame([(1, JSON), (2, "{broken")], "k int, content string"))
    assert [r.k for r in parsed.filter("parsed is null").collect()] == [2]
    m = {r.k: r for r in jsonfeed.metadata(parsed, "k").collect()}[1]
    assert (m.title, m.author, m.image_url, m.total_feed_episodes) == ("J", "Cy", "i", 3)
    e = jsonfeed.episodes(jsonfeed.identified(jsonfeed.items(parsed)), "pos").orderBy("pos").collect()
    assert [(r.guid, r.title, r.audio_url, r.duration, r.published_at) for r in e] == [("7", "Untitled Episode", "a.mp3", 61, None), ("u", "Untitled Episode", "", 60, None)]


def test_author_object_without_name_ends_the_search(spark):
    parsed = jsonfeed.parse(spark.createDataFrame([('{"author":{"x":1},"authors":[{"name":"n"}]}',), ('{"author":"s"}',), ('{"authors":["t"]}',)], "content string"))
    assert [r.author for r in jsonfeed.metadata(parsed).collect()] == [None, "s", "t"]


def test_router_and_known_items(spark):
    rows = spark.createDataFrame([(1, "\n" + RSS), (2, JSON)], "k int, content string")
    assert {(r.k, r.guid) for r in route.parse_items(rows, "k").collect()} == {(1, "g1"), (1, "b.ogg"), (1, "c.aac"), (2, "7"), (2, "u")}
    known = spark.createDataFrame([(1, "g1"), (2, "g1"), (2, "u")], "k int, guid string")
    assert {(r.k, r.guid) for r in route.parse_items(rows, "k", known).collect()} == {(1, "b.ogg"), (1, "c.aac"), (2, "7")}


def test_high_water_mark_drops_equal_dates_and_keeps_undated(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, None), (2, 1)], "k int, d int")
    marks = spark.createDataFrame([(1, 1)], "k int, mark int")
    assert sorted((r.k, r.d or 0) for r in I.above_mark(rows, marks, "k", "d").collect()) == [(1, 0), (1, 2), (2, 1)]


def test_first_in_batch(spark):
    rows = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (1, "b", 0)], "f int, guid string, pos int")
    kept, rejected = I.first_in_batch(rows, ["f", "guid"], ["pos"])
    assert sorted(r.pos for r in kept.collect()) == [0, 1] and [r.pos for r in rejected.collect()] == [2]


def test_upsert_rules(spark):
    schema = "rss_url string, title string, author string, description string, image_url string, category string, etag string, last_modified string"
    old = spark.createDataFrame([("a", "T", "x", None, None, "c", "e", "m"), ("b", "T", "x", None, None, "c", "e", "m"), ("d", "T", "x", None, None, "c", "e", "m")], schema).selectExpr("*", "'id' feed_id", "cast(null as timestamp) last_fetched_at", "'pending' sync_status")
    new = spark.createDataFrame([("a", "N", "", "D", None, "k", "", "m2"), ("b", "", "y", "D", None, "k", "e2", None), ("n", "", None, None, None, None, None, None)], schema).selectExpr("*", "false is_not_modified")
    got = {r.rss_url: r for r in U.upsert_feeds(old, new, F.lit(datetime(2026, 1, 1))).collect()}
    assert (got["a"].title, got["a"].author, got["a"].description, got["a"].category, got["a"].etag, got["a"].last_modified) == ("N", "x", "D", "k", "e", "m2")
    assert (got["b"].title, got["b"].author, got["b"].description, got["b"].etag, got["b"].sync_status) == ("T", "x", None, "e2", "active")
    assert (got["n"].title, got["n"].sync_status, got["d"].sync_status, got["d"].last_fetched_at) == ("Untitled Podcast", "active", "pending", None)


def test_cascade_and_checks(spark):
    t = {"feeds": spark.createDataFrame([(1,), (2,)], "feed_id int"), "episodes": spark.createDataFrame([(10, 1), (20, 2)], "episode_id int, feed_id int"), "insights": spark.createDataFrame([(10, "x"), (20, "y")], "episode_id int, t string")}
    left = C.survivors(t, {"episodes": [("feed_id", "feeds")], "insights": [("episode_id", "episodes")]}, {"feeds": "feed_id", "episodes": "episode_id"}, {"feeds": t["feeds"].filter("feed_id = 1")})
    assert [left[n].count() for n in t] == [1, 1, 1] and left["insights"].first().t == "y"
    rows = spark.createDataFrame([(1, None), (1, None), (1, "a"), (1, "a")], "f int, g string")
    assert [tuple(r) for r in C.duplicates(rows, ["f", "g"]).collect()] == [(1, "a", 2)]


def test_fetch_gate_and_headers(spark):
    log = spark.createDataFrame([(200, "n", ""), (304, None, None), (404, None, None), (500, None, None)], "status int, etag string, last_modified string").selectExpr("*", "'o' old_etag", "'l' old_last_modified")
    assert [(r.outcome, r.etag, r.last_modified) for r in route.fetch_gate(log).collect()] == [("modified", "n", "l"), ("not_modified", "o", "l"), ("rejected", "o", "l"), ("rejected", "o", "l")]
    h = spark.createDataFrame([("e", ""), (None, None)], "e string, m string").select(route.request_headers(F.col("e"), F.col("m")).alias("h")).collect()
    assert [r.h for r in h] == [{"If-None-Match": "e"}, {}]


RDF = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:d="http://purl.org/dc/elements/1.1/">
<channel rdf:about="https://c"><title>Old</title><link>https://c</link><d:creator>Di</d:creator></channel><image><url>https://pic</url></image>
<item rdf:about="https://c/1"><title>First</title><link>https://c/1</link><d:date>2026-03-04T05:06:07+01:00</d:date></item><item><title>Second</title><link>https://c/2</link></item></rdf:RDF>"""
PREFIXED_ATOM = """<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>Pre</a:title><a:entry><a:id>p1</a:id><a:title>P</a:title><a:published>2026-03-04T00:00:00Z</a:published><a:link rel="enclosure" href="p.ogg" type="audio/ogg"/></a:entry></a:feed>"""
PREFIXED_RDF = RDF.replace('xmlns="', 'xmlns:r="').replace("<channel", "<r:channel").replace("</channel", "</r:channel").replace("<item", "<r:item").replace("</item", "</r:item").replace("<title", "<r:title").replace("</title", "</r:title").replace("<link", "<r:link").replace("</link", "</r:link")
OWN_ATOM_LINK = """<rss xmlns:a10="http://www.w3.org/2005/Atom"><channel><title>L</title><item><guid>l1</guid><a10:link rel="enclosure" href="l.mp3"/></item></channel></rss>"""


def test_other_roots(spark):
    rows = [("rdf", RDF), ("atom", PREFIXED_ATOM), ("rdf2", PREFIXED_RDF), ("link", OWN_ATOM_LINK)]
    parsed = xmlfeed.parse(spark.createDataFrame([(k, t.encode()) for k, t in rows], "k string, content binary")).cache()
    m = {r.k: (r.title, r.author, r.image_url, r.total_feed_episodes) for r in xmlfeed.metadata(parsed, "k").collect()}
    assert m == {"rdf": ("Old", "Di", "https://pic", 2), "atom": ("Pre", None, None, 1), "rdf2": ("Old", "Di", "https://pic", 2), "link": ("L", None, None, 1)}
    e = xmlfeed.episodes(xmlfeed.identified(xmlfeed.items(parsed, "k")), "k", "pos").collect()
    got = {(r.k, r.pos): (r.guid, r.title, r.audio_url, r.published_at) for r in e}
    old = [("https://c/1", "First", "", datetime(2026, 3, 4, 4, 6, 7)), ("https://c/2", "Second", "", None)]
    assert [got["rdf", i] for i in (0, 1)] == old and [got["rdf2", i] for i in (0, 1)] == old
    assert got["atom", 0] == ("p1", "P", "p.ogg", datetime(2026, 3, 4)) and got["link", 0][2] == "l.mp3"

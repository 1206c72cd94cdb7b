"""Queries over payloads: scans, projections, functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..sources import jsonfeed, route, xmlfeed
from . import bindings as B

NTZ = "timestamp_ntz"


def xml_feed_scan(spark, d):
    rows = xmlfeed.items(xmlfeed.parse(B.xml_payloads(B.table(spark, d, "orders"))), "feed_id")
    e = xmlfeed.episodes(xmlfeed.identified(rows), "feed_id", "pos")
    return e.select("feed_id", "pos", "guid", "title", "duration", F.col("published_at").cast(NTZ).alias("published_at"), "summary")


XML_FEED_SCAN = """select o_custkey as feed_id, cast(row_number() over (partition by o_custkey, o_orderkey % pages order by o_orderkey) - 1 as integer) as pos,
cast(o_orderkey as varchar) as guid, 'Order ' || o_orderkey as title, cast(floor(o_totalprice) as integer) as duration,
o_orderdate as published_at, o_orderpriority as summary from (select *, (count(*) over (partition by o_custkey) + 999) // 1000 as pages from orders)"""


def json_feed_scan(spark, d):
    rows = jsonfeed.items(jsonfeed.parse(B.json_payloads(B.table(spark, d, "documents"))), "feed")
    return jsonfeed.episodes(jsonfeed.identified(rows), "feed").select("feed", "guid", "summary")


JSON_FEED_SCAN = "select source as feed, cast(doc_id as varchar) as guid, nullif(text, '') as summary from documents"


def format_router(spark, d):
    xml = B.xml_payloads(B.table(spark, d, "orders")).select(F.concat(F.lit("c"), F.col("feed_id")).alias("feed"), F.concat(F.lit("\n"), F.col("content")).alias("content"))
    js = B.json_payloads(B.table(spark, d, "documents")).select("feed", F.concat(F.lit("\n\t "), F.col("content")).alias("content"))
    both = xml.unionByName(js)
    return route.parse_items(both, "feed").select(F.when(F.col("feed").startswith("c"), "xml").otherwise("json").alias("kind"), "feed", "guid")


FORMAT_ROUTER = """select 'xml' as kind, 'c' || o_custkey as feed, cast(o_orderkey as varchar) as guid from orders
union all select 'json', source, cast(doc_id as varchar) from documents"""


def fetch_gate(spark, d):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    log = B.table(spark, d, "orders").select(
        "o_orderkey",
        F.when(s == "F", 304).when(s == "O", 200).otherwise(500).alias("status"),
        F.when(k % 2 == 0, F.concat(F.lit("new"), k)).alias("etag"), F.lit("").alias("last_modified"),
        F.concat(F.lit("old"), k).alias("old_etag"), F.when(k % 3 == 0, F.lit("then")).alias("old_last_modified"),
    )
    return route.fetch_gate(log).select("o_orderkey", "outcome", "etag", "last_modified")


FETCH_GATE = """select o_orderkey, case o_orderstatus when 'F' then 'not_modified' when 'O' then 'modified' else 'rejected' end as outcome,
case when o_orderkey % 2 = 0 then 'new' || o_orderkey else 'old' || o_orderkey end as etag,
case when o_orderkey % 3 = 0 then 'then' end as last_modified from orders"""


def crawl_headers(spark, d):
    k = F.col("c_custkey")
    h = route.request_headers(F.when(k % 3 != 0, F.concat(F.lit("e"), k)), F.when(k % 2 == 0, F.concat(F.lit("m"), k)).otherwise(F.lit("")))
    c = B.table(spark, d, "customer").select("c_custkey", h.alias("h"))
    return c.select("c_custkey", F.size("h").alias("n_headers"), F.col("h")["If-None-Match"].alias("if_none_match"), F.col("h")["If-Modified-Since"].alias("if_modified_since"))


CRAWL_HEADERS = """select c_custkey, cast((c_custkey % 3 <> 0)::int + (c_custkey % 2 = 0)::int as integer) as n_headers,
case when c_custkey % 3 <> 0 then 'e' || c_custkey end as if_none_match, case when c_custkey % 2 = 0 then 'm' || c_custkey end as if_modified_since from customer"""


def feed_metadata_xml(spark, d):
    return xmlfeed.metadata(xmlfeed.parse(B.xml_payloads(B.table(spark, d, "orders"), B.table(spark, d, "customer"))), "feed_id")


FEED_METADATA_XML = """select c_custkey as feed_id, c_name as title, case when c_custkey % 2 = 1 then c_name else 'A & B' end as author,
case when c_custkey % 3 = 0 then 'S' else 'D' end || c_custkey as description, 'https://f.example/' || c_custkey as link,
case when c_custkey % 2 = 1 then 'https://i.example/' || c_custkey else 'https://j.example/x' end as image_url,
case when c_custkey % 4 = 0 then 'Arts' else c_mktsegment end as category, cast(count(*) as integer) as total_feed_episodes
from customer join (select *, (count(*) over (partition by o_custkey) + 999) // 1000 as pages from orders) on c_custkey = o_custkey group by c_custkey, c_name, c_mktsegment, o_orderkey % pages"""


def feed_metadata_json(spark, d):
    return jsonfeed.metadata(jsonfeed.parse(B.json_payloads(B.table(spark, d, "documents"))), "feed", "page")


FEED_METADATA_JSON = """select source as feed, doc_id // 1000 as page, source as title, case when (doc_id // 1000) % 2 = 0 then source end as author,
case when (doc_id // 1000) % 3 <> 0 then 'd' end as description, case when (doc_id // 1000) % 2 = 0 then 'u' else 'h' end as link,
'f' as image_url, cast(null as varchar) as category, cast(count(*) as integer) as total_feed_episodes from documents group by source, doc_id // 1000"""


def enclosure_choice_xml(spark, d):
    rows = xmlfeed.items(xmlfeed.parse(B.xml_payloads(B.table(spark, d, "orders"))), "feed_id")
    return xmlfeed.episodes(xmlfeed.identified(rows)).select("guid", "audio_url", "enclosure_type")


ENCLOSURE_CHOICE_XML = """select cast(o_orderkey as varchar) as guid, 'https://a.example/' || o_orderkey ||
case o_orderkey % 5 when 0 then '.mp3' when 1 then '.M4A' when 2 then '.mp3?x=1' when 3 then '.ogg' else '' end as audio_url,
case o_orderkey % 5 when 0 then 'audio/mpeg' when 1 then 'application/octet-stream' when 2 then null when 3 then 'audio/mpeg' else 'audio/aac' end as enclosure_type from orders"""


def attachment_choice_json(spark, d):
    rows = jsonfeed.items(jsonfeed.parse(B.attachment_items(B.table(spark, d, "documents"))), "doc_id")
    return jsonfeed.episodes(jsonfeed.identified(rows), "doc_id").select("doc_id", "audio_url", "enclosure_type", "duration")


ATTACHMENT_CHOICE_JSON = """select doc_id, case doc_id % 5 when 0 then 'a' || doc_id || '.mp3' when 1 then 'o' || doc_id when 2 then 'v.mp4' when 3 then 'g.ogg' else '' end as audio_url,
case doc_id % 5 when 2 then 'video/mp4' when 3 then 'audio/ogg' else 'audio/mpeg' end as enclosure_type,
cast(case doc_id % 5 when 0 then doc_id when 1 then 90 when 2 then 2 else null end as integer) as duration from documents"""


def page_links(spark, d):
    return B.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))


PAGE_LINKS = """select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as link from pages"""


def episode_defaults(spark, d):
    rows = jsonfeed.items(jsonfeed.parse(B.json_payloads(B.table(spark, d, "documents"))), "feed")
    return jsonfeed.episodes(jsonfeed.identified(rows)).select("guid", "title", "audio_url", "link", "enclosure_type")


EPISODE_DEFAULTS = """select cast(doc_id as varchar) as guid, case when doc_id % 4 = 0 then 'Untitled Episode' else 'T' || doc_id end as title,
case when doc_id % 4 = 2 then 'https://p.example/' || doc_id || '.mp3' else '' end as audio_url,
case when doc_id % 4 <> 1 then 'https://p.example/' || doc_id end as link, 'audio/mpeg' as enclosure_type from documents"""


def duration_seconds(spark, d):
    k, s = F.col("o_orderkey"), B.total_seconds()
    text = (
        F.when(k % 6 == 0, s.cast("string"))
        .when(k % 6 == 1, F.format_string("%d:%02d", (s / 60).cast("int"), s % 60))
        .when(k % 6 == 2, F.concat(F.lit(" "), B.clock_text(s), F.lit(".9\n")))
        .when(k % 6 == 3, F.concat(F.lit("-"), s.cast("string"), F.lit(".7")))
        .when(k % 6 == 4, F.concat(s.cast("string"), F.lit("d")))
        .otherwise(F.format_string("01 : %d", s % 100))
    )
    rows = B.table(spark, d, "orders").select("o_orderkey", N.held(text.alias("text")).alias("h"))
    return rows.select("o_orderkey", N.duration_seconds(F.col("h.text")).alias("seconds"))


DURATION_SECONDS = """select o_orderkey, cast(case o_orderkey % 6 when 3 then -floor(o_totalprice) when 4 then null when 5 then 60 + cast(floor(o_totalprice) as integer) % 100 else floor(o_totalprice) end as integer) as seconds from orders"""


def duration_numeric(spark, d):
    return B.table(spark, d, "events").select("event_id", N.duration_number(F.col("value")).alias("seconds"), N.duration_number(F.floor("value") + 0.5).alias("half"))


DURATION_NUMERIC = "select event_id, cast(round_even(value, 0) as integer) as seconds, cast(round_even(floor(value) + 0.5, 0) as integer) as half from events"


def published_utc(spark, d):
    """Dates in sixteen shapes; what is partial, no day or no date gives null."""
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    shape = lambda pattern, end="", begin="": F.concat(F.lit(begin), F.date_format(t, pattern), F.lit(end))
    shapes = [
        F.concat(B.mail_date(t), F.lit(" -0700")), shape("d MMM yyyy HH:mm", " PDT", "Foo, "), shape("yyyy-MM-dd'T'HH:mm:ss", "+02:00 ", " "), shape("yyyy-MM-dd'T'HH:mm:ss"),
        shape("yyyy-MM-dd'T'HH:mm:ss", "Z"), shape("MMM yyyy"), shape("d MMMM yyyy HH:mm:ss", " +01:00"), shape("MMMM d, yyyy HH:mm"), shape("yyyy/MM/dd HH:mm"), shape("yyyyMMdd'T'HHmmss", "Z"),
        shape("dd-MMM-yyyy HH:mm:ss"), shape("EEE MMM d HH:mm:ss yyyy"), shape("yyyy-MM-dd'T'HH:mm:ss", " EST"), shape("d MMM yyyy"), shape("MM/dd/yyyy hh:mm a"), shape("yyyy-MM-dd", " or so"),
    ]
    text = shapes[-1]
    for i, s in enumerate(shapes[:-1]):
        text = F.when(k % len(shapes) == i, s).otherwise(text)
    rows = B.table(spark, d, "orders").select("o_orderkey", N.held(N.date_text(text).alias("text")).alias("_t"))
    return rows.select("o_orderkey", N.date_value(F.col("_t.text")).cast(NTZ).alias("published_at"))


PUBLISHED_UTC = """select o_orderkey, case o_orderkey % 16 when 0 then o_orderdate + interval 7 hour when 1 then date_trunc('minute', o_orderdate) + interval 7 hour when 2 then o_orderdate - interval 2 hour
when 5 then null when 6 then o_orderdate - interval 1 hour when 7 then date_trunc('minute', o_orderdate) when 8 then date_trunc('minute', o_orderdate) when 12 then o_orderdate + interval 5 hour
when 13 then cast(date_trunc('day', o_orderdate) as timestamp) when 14 then date_trunc('minute', o_orderdate) when 15 then null else o_orderdate end as published_at from orders"""


def text_helpers(spark, d):
    text = F.col("text")
    spaced = F.concat(F.lit("\t\n "), text, F.lit(" \r\n"))
    return B.table(spark, d, "documents").select(
        "doc_id",
        N.trim_ws(spaced).alias("stripped"),
        N.first_truthy(F.when(F.col("doc_id") % 3 == 0, F.lit("")), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("source")).alias("chosen"),
        F.lower(F.col("source")).endswith("9").alias("ends"),
        F.col("source").startswith("src1").alias("starts"),
        F.length(N.decode_payload(F.encode(text, "UTF-8"))).alias("n_chars"),
    )


TEXT_HELPERS = """select doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)) as stripped, case when doc_id % 2 = 0 then lang else source end as chosen,
ends_with(lower(source), '9') as ends, starts_with(source, 'src1') as starts, cast(length(text) as integer) as n_chars from documents"""


def payload_encodings(spark, d):
    """Payloads in Latin-1 and UTF-8, with the iTunes namespace bound to a prefix of its own in every third."""
    k, third = F.col("o_orderkey"), F.col("o_orderkey") % 3 == 0
    p = F.when(third, F.lit("pod")).otherwise(F.lit("itunes"))
    name = F.when(k % 2 == 0, "ISO-8859-1").otherwise("UTF-8")
    xml = F.concat(F.lit('<?xml version="1.0" encoding="'), name, F.lit('"?><rss xmlns:'), p, F.lit('="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><item><guid>'), k.cast("string"), F.lit("</guid><title>Fünf é "), k.cast("string"), F.lit("</title><"), p, F.lit(":duration>1:05</"), p, F.lit(":duration></item></channel></rss>"))
    rows = B.table(spark, d, "orders").select(N.held(xml.alias("xml"), (k % 2 == 0).alias("latin")).alias("h"))
    rows = rows.select(F.when(F.col("h.latin"), F.encode("h.xml", "ISO-8859-1")).otherwise(F.encode("h.xml", "UTF-8")).alias("content"))
    return xmlfeed.episodes(xmlfeed.identified(xmlfeed.items(xmlfeed.parse(rows)))).select("guid", "title", "duration")


PAYLOAD_ENCODINGS = "select cast(o_orderkey as varchar) as guid, 'Fünf é ' || o_orderkey as title, 65 as duration from orders"

QUERIES = {n.lower(): (globals()[n.lower()], sql) for n, sql in list(globals().items()) if n.isupper() and n.lower() in globals() and isinstance(sql, str)}

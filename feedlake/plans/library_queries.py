"""Queries over feeds, episodes and the library: what is new, upserts, integrity, joins, streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import incremental as I
from ..operators import integrity as C
from ..operators import library as L
from ..operators import upsert as U
from ..sources import route
from ..storage import new_path, staged
from ..streaming import ingest
from . import bindings as B

NTZ = "timestamp_ntz"
def _now():
    return F.lit("2026-01-01 00:00:00").cast(NTZ)



def _stored_orders(spark, d, status: str = "F"):
    return B.table(spark, d, "orders").filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("feed_id"), F.col("o_orderkey").cast("string").alias("guid"))


def _parsed_orders(spark, d, known=None):
    return route.parse_items(B.xml_payloads(B.table(spark, d, "orders")), "feed_id", known)


def new_items_antijoin(spark, d):
    rows = _parsed_orders(spark, d, _stored_orders(spark, d))
    return rows.select("feed_id", "guid", F.col("published_at").cast(NTZ).alias("published_at"), "duration")


NEW_ITEMS_ANTIJOIN = "select o_custkey as feed_id, cast(o_orderkey as varchar) as guid, o_orderdate as published_at, cast(floor(o_totalprice) as integer) as duration from orders where o_orderstatus <> 'F'"


def high_water_filter(spark, d):
    e = B.table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"))
    marks = e.filter((F.col("event_id") % 2 == 0) & (F.col("user_id") % 3 != 0)).groupBy("user_id").agg(F.min("ts").alias("mark"))
    return I.above_mark(e, marks, "user_id", "ts").select("event_id", "user_id", "ts")


HIGH_WATER_FILTER = """with e as (select event_id, user_id, case when event_id % 7 <> 0 then ts end as ts from events),
m as (select user_id, min(ts) as mark from e where event_id % 2 = 0 and user_id % 3 <> 0 group by user_id)
select event_id, e.user_id, ts from e left join m on e.user_id = m.user_id where mark is null or ts is null or ts > mark"""


def keyed_lookup(spark, d):
    keys = B.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return L.lookup(B.table(spark, d, "orders"), keys, ["o_custkey"]).select("o_orderkey")


KEYED_LOOKUP = "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')"


def composite_lookup(spark, d):
    e = B.table(spark, d, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("episode"))
    return L.lookup(e, e.filter("event_type = 'purchase'"), ["user_id", "episode"]).select("event_id")


COMPOSITE_LOOKUP = """with e as (select event_id, user_id, event_type, cast(props->>'$.k' as bigint) as k from events)
select event_id from e where exists (select 1 from e x where x.event_type = 'purchase' and x.user_id = e.user_id and x.k = e.k)"""


def _feeds(spark, d):
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("feed_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("category"))


def _episodes(spark, d):
    return B.table(spark, d, "orders").select(F.col("o_orderkey").alias("episode_id"), F.col("o_custkey").alias("feed_id"), F.col("o_orderdate").alias("published_at"))


def feed_episodes(spark, d):
    return _feeds(spark, d).join(_episodes(spark, d), "feed_id", "left").select("feed_id", "title", "episode_id")


FEED_EPISODES = "select c_custkey as feed_id, c_name as title, o_orderkey as episode_id from customer left join orders on c_custkey = o_custkey"


def episode_insights(spark, d):
    li = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("timestamp_seconds"), F.col("l_returnflag").alias("insight_type"))
    return _episodes(spark, d).join(li, "episode_id").select("episode_id", "feed_id", "timestamp_seconds", "insight_type")


EPISODE_INSIGHTS = "select o_orderkey as episode_id, o_custkey as feed_id, l_linenumber as timestamp_seconds, l_returnflag as insight_type from orders join lineitem on l_orderkey = o_orderkey"


def _tags(spark, d):
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("tag_id"), F.col("p_brand").alias("name"), F.col("p_type").alias("category"))


def _bridge(spark, d):
    return B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_partkey").alias("tag_id")).distinct()


def episode_tags(spark, d):
    return L.through(_episodes(spark, d), _bridge(spark, d), _tags(spark, d), "episode_id", "tag_id").select("episode_id", "tag_id", "name", "category")


EPISODE_TAGS = """select o_orderkey as episode_id, p_partkey as tag_id, p_brand as name, p_type as category from orders
join (select distinct l_orderkey, l_partkey from lineitem) on l_orderkey = o_orderkey join part on p_partkey = l_partkey"""


def _progress(spark, d):
    return B.table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("episode_id"), F.col("ts").alias("last_played_at"), F.col("value").alias("position"))


def progress_join(spark, d):
    users = B.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    return _progress(spark, d).join(users, "user_id").join(_episodes(spark, d), "episode_id").select("event_id", "email", "episode_id", "feed_id")


PROGRESS_JOIN = """select event_id, c_name as email, o_orderkey as episode_id, o_custkey as feed_id from events join customer on c_custkey = user_id
join orders on o_orderkey = cast(props->>'$.k' as bigint)"""


def user_playlists(spark, d):
    users = B.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("user_id"))
    lists = B.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("playlist_id"), F.col("s_name").alias("title"))
    owners = users.groupBy("nation").agg(F.min("user_id").alias("user_id"))
    return owners.join(lists, "nation").select("user_id", "playlist_id", "title")


USER_PLAYLISTS = """select user_id, s_suppkey as playlist_id, s_name as title from supplier
join (select c_nationkey, min(c_custkey) as user_id from customer group by c_nationkey) on c_nationkey = s_nationkey"""


def playlist_order(spark, d):
    rows = B.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("playlist_id"), F.col("l_orderkey").alias("episode_id")).agg(F.min("l_linenumber").alias("position"))
    joined = rows.join(_episodes(spark, d), "episode_id")
    return L.ranked(joined, ["playlist_id"], ["position", "episode_id"], name="place").select("playlist_id", "episode_id", "position", "place")


PLAYLIST_ORDER = """select l_suppkey as playlist_id, l_orderkey as episode_id, position, cast(row_number() over (partition by l_suppkey order by position, l_orderkey) as integer) as place
from (select l_suppkey, l_orderkey, min(l_linenumber) as position from lineitem group by all) join orders on o_orderkey = l_orderkey"""


def feed_upsert(spark, d):
    c, k = B.table(spark, d, "customer"), F.col("c_custkey")
    url = F.concat(F.lit("https://f/"), k).alias("rss_url")
    old = c.filter(k % 2 == 0).select(url, F.concat(F.lit("id"), k).alias("feed_id"), F.concat(F.lit("old"), k).alias("title"), F.lit("a").alias("author"), F.lit("").alias("description"), F.lit(None).cast("string").alias("image_url"), F.col("c_mktsegment").alias("category"), F.lit("e0").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast(NTZ).alias("last_fetched_at"), F.lit("pending").alias("sync_status"), (k % 3).cast("int").alias("error_count"), F.lit(None).cast(NTZ).alias("created_at"))
    new = c.filter(k % 5 != 0).select(url, F.when(k % 3 == 0, F.lit("")).otherwise(F.col("c_name")).alias("title"), F.lit("").alias("author"), F.lit("d").alias("description"), F.when(k % 4 == 0, F.lit("i")).alias("image_url"), F.lit("").alias("category"), F.when(k % 7 == 0, F.lit("e1")).alias("etag"), F.lit("m").alias("last_modified"), (k % 11 == 0).alias("is_not_modified"))
    return U.upsert_feeds(old, new, _now()).drop("feed_id")


FEED_UPSERT = """with o as (select c_custkey as k, 'old' || c_custkey as title, 'a' as author, '' as description, cast(null as varchar) as image_url, c_mktsegment as category, 'e0' as etag from customer where c_custkey % 2 = 0),
n as (select c_custkey as k, case when c_custkey % 3 = 0 then '' else c_name end as title, case when c_custkey % 4 = 0 then 'i' end as image_url, case when c_custkey % 7 = 0 then 'e1' end as etag, c_custkey % 11 = 0 as nm from customer where c_custkey % 5 <> 0),
j as (select coalesce(o.k, n.k) as k, o.k is null as fresh, n.k is not null as fetched, o.k is not null and n.k is not null and not nm and n.title <> '' as modified,
o.title as ot, n.title as nt, cast(o.k % 3 as integer) as ec, o.author as oa, o.image_url as oi, n.image_url as ni, o.category as oc, o.etag as oe, n.etag as ne from o full join n on o.k = n.k)
select 'https://f/' || k as rss_url, case when fresh then coalesce(nullif(nt, ''), 'Untitled Podcast') when modified then nt else ot end as title,
case when fresh then '' when modified then oa else oa end as author, case when fresh or modified then 'd' else '' end as description,
case when fresh then ni when modified then coalesce(ni, oi) else oi end as image_url, case when fresh then '' else oc end as category,
case when fetched then coalesce(ne, oe) else oe end as etag, case when fetched then 'm' end as last_modified,
case when fetched then timestamp '2026-01-01' end as last_fetched_at, case when fetched then 'active' else 'pending' end as sync_status, case when fresh then 0 else ec end as error_count,
case when fresh then timestamp '2026-01-01' end as created_at from j"""


def episode_append(spark, d):
    rows = U.episode_rows(_parsed_orders(spark, d, _stored_orders(spark, d)), _now())
    return rows.select("episode_id", "feed_id", "guid", "title", "audio_url", "duration", "processed")


EPISODE_APPEND = """select sha256(o_custkey || chr(1) || o_orderkey) as episode_id, o_custkey as feed_id, cast(o_orderkey as varchar) as guid, 'Order ' || o_orderkey as title,
'https://a.example/' || o_orderkey || case o_orderkey % 5 when 0 then '.mp3' when 1 then '.M4A' when 2 then '.mp3?x=1' when 3 then '.ogg' else '' end as audio_url,
cast(floor(o_totalprice) as integer) as duration, false as processed from orders where o_orderstatus <> 'F'"""


def ingest_twice(spark, d):
    """Two ingests of the same payloads into one table: rows added by each, per feed."""
    root, known = new_path(spark, "library"), _stored_orders(spark, d)
    out = None
    for run in (1, 2):
        stored = known if run == 1 else known.unionByName(spark.read.parquet(f"{root}/episodes").select("feed_id", "guid"))
        rows = staged(U.episode_rows(_parsed_orders(spark, d, stored), _now()), "new")
        feeds = rows.select("feed_id").distinct()
        U.publish(spark, rows, feeds, root, run)
        added = rows.groupBy("feed_id").agg(F.count("*").alias("n")).withColumn("run", F.lit(run))
        out = added if out is None else out.unionByName(added)
    return out


INGEST_TWICE = "select o_custkey as feed_id, count(*) as n, 1 as run from orders where o_orderstatus <> 'F' group by o_custkey"


def new_per_feed(spark, d):
    return _parsed_orders(spark, d, _stored_orders(spark, d)).groupBy("feed_id").agg(F.count("*").alias("n_new"))


NEW_PER_FEED = "select o_custkey as feed_id, count(*) as n_new from orders where o_orderstatus <> 'F' group by o_custkey"


def known_keys(spark, d):
    rows = B.table(spark, d, "orders").select(F.col("o_custkey").alias("feed_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey").cast("string")).otherwise(F.lit("")).alias("guid"))
    return rows.groupBy("feed_id").agg(F.countDistinct(F.nullif("guid", F.lit(""))).cast("int").alias("n_known"))


KNOWN_KEYS = "select o_custkey as feed_id, cast(count(distinct case when o_orderkey % 3 <> 0 then o_orderkey end) as integer) as n_known from orders group by o_custkey"


def dup_keys(spark, d):
    return C.duplicates(B.table(spark, d, "lineitem"), ["l_orderkey"])


DUP_KEYS = "select l_orderkey, count(*) as n from lineitem group by l_orderkey having count(*) > 1"


def dup_pairs(spark, d):
    return C.duplicates(B.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


DUP_PAIRS = "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1"


def null_exempt_dups(spark, d):
    rows = B.table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") != 1, F.col("l_linenumber")).alias("line"))
    return C.duplicates(rows, ["l_orderkey", "line"])


NULL_EXEMPT_DUPS = "select l_orderkey, l_linenumber as line, count(*) as n from lineitem where l_linenumber <> 1 group by all having count(*) > 1"


def orphans(spark, d):
    return C.orphans(B.table(spark, d, "documents"), "doc_id", B.table(spark, d, "labels"), "doc_id").select("doc_id")


ORPHANS = "select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)"


def null_and_length_report(spark, d):
    rows = B.table(spark, d, "documents").withColumn("lang", F.when(F.col("doc_id") % 9 != 0, F.col("lang")))
    return C.null_report(rows, ["doc_id", "lang"], {"text": 1024, "source": 4})


NULL_AND_LENGTH_REPORT = """select 'null' as "check", 'doc_id' as column_name, count(*) filter (doc_id is null) as n from documents union all
select 'null', 'lang', count(*) filter (doc_id % 9 = 0 or lang is null) from documents union all
select 'length', 'text', count(*) filter (length(text) > 1024) from documents union all select 'length', 'source', count(*) filter (length(source) > 4) from documents"""


def cascade_delete(spark, d):
    tables = {"feeds": B.table(spark, d, "customer").withColumnRenamed("c_custkey", "feed_id"), "episodes": B.table(spark, d, "orders").select(F.col("o_orderkey").alias("episode_id"), F.col("o_custkey").alias("feed_id")), "insights": B.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "episode_id")}
    left = C.survivors(tables, {"episodes": [("feed_id", "feeds")], "insights": [("episode_id", "episodes")]}, {"feeds": "feed_id", "episodes": "episode_id"}, {"feeds": tables["feeds"].filter("c_mktsegment = 'BUILDING'").select("feed_id")})
    return reduce(lambda a, b: a.unionByName(b), (rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, rows in left.items()))


CASCADE_DELETE = """with f as (select c_custkey from customer where c_mktsegment <> 'BUILDING'), e as (select o_orderkey from orders where o_custkey in (from f))
select 'feeds' as table_name, count(*) as n from f union all select 'episodes', count(*) from e union all
select 'insights', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey not in (from f))"""


def batch_dedup(spark, d):
    order = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")]
    return I.first_in_batch(B.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order)[0].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


BATCH_DEDUP = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem
qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) = 1"""

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _event_stream(spark, d):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 64).parquet(f"{d}/events.parque[t]")


def stream_new_items(spark, d):
    """Events as a stream of items by user and type; those of odd users are known before."""
    target, schema = new_path(spark, "items"), "user_id long, event_type string"
    B.table(spark, d, "events").filter("user_id % 2 = 1").select("user_id", "event_type").distinct().write.parquet(target)
    for _ in (1, 2):  # the second run adds nothing
        ingest.append_new(_event_stream(spark, d).select("user_id", "event_type"), target, ["user_id", "event_type"], new_path(spark, "state"), schema)
    return spark.read.schema(schema).parquet(target)


STREAM_NEW_ITEMS = "select distinct user_id, event_type from events where event_type is not null"


def stream_dedup(spark, d):
    out = new_path(spark, "dedup")
    rows = ingest.dedup(_event_stream(spark, d).select("user_id", F.get_json_object("props", "$.k").alias("k")), ["user_id", "k"])
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, k string").parquet(out)


STREAM_DEDUP = "select distinct user_id, props->>'$.k' as k from events"


def feed_marks(spark, d):
    return I.marks(B.table(spark, d, "orders"), "o_custkey", "o_orderdate")


FEED_MARKS = "select o_custkey, max(o_orderdate) as mark from orders group by o_custkey"


def changed_payloads(spark, d):
    p = B.table(spark, d, "pages")
    stored = p.filter("page_id % 3 <> 0").select("page_id", F.sha2(F.when(F.col("page_id") % 3 == 1, F.col("html")).otherwise(F.lit("old")), 256).alias("body_hash"))
    return I.changed(p, stored, "page_id", "html").select("page_id", "body_hash")


CHANGED_PAYLOADS = "select page_id, sha256(html) as body_hash from pages where page_id % 3 <> 1"


def fetch_to_feeds(spark, d):
    """Gate, parse and upsert in one: landed responses of customers, a third of them not modified, a seventh failed."""
    k = F.col("feed_id")
    body = B.xml_payloads(B.table(spark, d, "orders"), B.table(spark, d, "customer"))
    log = route.fetch_gate(body.select("feed_id", "content", F.when(k % 3 == 0, 304).when(k % 7 == 0, 500).otherwise(200).alias("status"), F.lit("e").alias("etag"), F.lit("").alias("last_modified"), F.lit("o").alias("old_etag"), F.lit("l").alias("old_last_modified")))
    meta = route.parse_metadata(log.filter("outcome = 'modified'"), "feed_id", "etag", "last_modified").withColumn("is_not_modified", F.lit(False))
    same = log.filter("outcome = 'not_modified'").select("feed_id", "etag", "last_modified", F.lit("").alias("title"), F.lit(True).alias("is_not_modified"))
    new = meta.select("feed_id", "title", *U.GROUP, "etag", "last_modified", "is_not_modified").unionByName(same, allowMissingColumns=True).withColumnRenamed("feed_id", "rss_url")
    old = B.table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("rss_url"), F.lit("x").alias("feed_id"), F.lit("t").alias("title"), *(F.lit(None).cast("string").alias(c) for c in (*U.GROUP, "etag", "last_modified", "sync_status")), F.lit(None).cast(NTZ).alias("last_fetched_at"))
    return U.upsert_feeds(old, new, _now()).select(F.col("rss_url").alias("feed_key"), "title", "category", "last_modified", "sync_status")


FETCH_TO_FEEDS = """with c as (select c_custkey as k, c_name, c_mktsegment, case when c_custkey not in (select o_custkey from orders) then 'none' when c_custkey % 3 = 0 then 'same' when c_custkey % 7 = 0 then 'bad' else 'new' end as s, c_custkey % 2 = 0 as known from customer)
select k as feed_key, case when s = 'new' then c_name when known then 't' else 'Untitled Podcast' end as title,
case when s = 'new' then case when k % 4 = 0 then 'Arts' else c_mktsegment end end as category,
case when s in ('new', 'same') then 'l' end as last_modified, case when s in ('new', 'same') then 'active' end as sync_status from c where known or s in ('new', 'same')"""

QUERIES = {n.lower(): (globals()[n.lower()], sql) for n, sql in list(globals().items()) if n.isupper() and n.lower() in globals() and isinstance(sql, str)}

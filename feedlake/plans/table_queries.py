"""Queries over the ten library tables as stored: created, filled from the given tables, scanned, checked, deleted from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import integrity as C
from ..operators import upsert as U
from ..storage import new_path
from . import bindings as B

#: Table -> (given table, expressions of its columns); keys, texts and references that break constraints included.
FILL = {
    "users": ("customer", "concat('u', c_custkey) as user_id", "c_mktsegment as email"),
    "feeds": ("supplier", "concat('f', s_suppkey) as feed_id", "concat('https://f/', s_nationkey) as rss_url", "s_name as title"),
    "episodes": ("orders", "concat('e', o_orderkey) as episode_id", "concat('f', o_custkey) as feed_id", "o_orderpriority as guid", "o_orderstatus = 'F' as processed"),
    "user_episode_progress": ("events", "concat('u', user_id) as user_id", "concat('e', get_json_object(props, '$.k')) as episode_id"),
    "tags": ("part", "concat('t', p_partkey) as tag_id", "p_brand as name", "p_type as category"),
    "episode_tags": ("lineitem", "concat('e', l_orderkey) as episode_id", "concat('t', l_partkey) as tag_id"),
    "insights": ("lineitem", "concat('i', l_orderkey, '-', l_linenumber) as insight_id", "concat('e', l_partkey * 5) as episode_id"),
    "curated_playlists": ("conversations", "concat('p', conv_id) as playlist_id", "concat('u', conv_id) as user_id", "text as title"),
    "playlist_episodes": ("lineitem", "concat('p', l_suppkey) as playlist_id", "concat('e', l_orderkey) as episode_id", "l_linenumber as position"),
    "task_logs": ("events", "case when value >= 1 then concat('j', event_id) end as task_log_id", "event_type as task_type"),
}
WITH = "with " + ", ".join(f"{t} as (select {', '.join(columns).replace('get_json_object(props, ' + chr(39) + '$.k' + chr(39) + ')', 'json_extract_string(props, ' + chr(39) + '$.k' + chr(39) + ')')} from {source})" for t, (source, *columns) in FILL.items())


def _library(spark, d) -> dict[str, DataFrame]:
    root = new_path(spark, "library")
    for name, (source, *columns) in FILL.items():
        schemas.create(spark, root, name)
        rows = B.table(spark, d, source).selectExpr(*columns)
        schemas.conform(rows, name).write.mode("append").parquet(f"{root}/{name}")
    return {name: schemas.scan(spark, root, name) for name in FILL}


def table_defaults(spark, d):
    """What the tables hold where nothing was given."""
    t = _library(spark, d)
    feeds = t["feeds"].groupBy(F.concat_ws(":", "sync_status", "error_count").alias("value")).agg(F.count("*").alias("n"))
    logs = t["task_logs"].groupBy(F.col("status").alias("value")).agg(F.count("*").alias("n"))
    seen = t["user_episode_progress"].groupBy(F.concat_ws(":", "position_seconds", "completed").alias("value")).agg(F.count("*").alias("n"))
    return feeds.unionByName(logs).unionByName(seen)


TABLE_DEFAULTS = "select 'pending:0' as value, count(*) as n from supplier union all select 'pending', count(*) from events union all select '0:false', count(*) from events"


def table_violations(spark, d):
    return C.violations(_library(spark, d))


def _violations_sql() -> str:
    parts = []
    add = lambda t, check, c, body: parts.append(f"""select '{t}' as table_name, '{check}' as "check", '{c}' as column_name, count(*) as n from {body}""")
    given = {t: [c.rsplit(" as ", 1)[1] for c in columns] for t, (_, *columns) in FILL.items()}
    for t in FILL:
        for check, keys in (("key", schemas.PRIMARY_KEYS[t]), ("unique", schemas.UNIQUE.get(t, []))):
            if keys:
                there = " and ".join(f"{k} is not null" for k in keys)
                add(t, check, ",".join(keys), f"(select 1 from {t} where {there} group by {', '.join(keys)} having count(*) > 1)")
        for c, parent in schemas.REFERENCES.get(t, []):
            add(t, "reference", c, f"{t} x where {c} is not null and not exists (select 1 from {parent} y where y.{schemas.PRIMARY_KEYS[parent][0]} = x.{c})")
        for c in schemas.PRIMARY_KEYS[t]:
            add(t, "null", c, f"{t} where {c} is null")
        for c, n in schemas.LENGTHS.get(t, {}).items():
            add(t, "length", c, f"{t} where length({c}) > {n}" if c in given[t] else f"{t} where false" if (t, c) != ("feeds", "sync_status") else f"{t} where length('pending') > {n}")
    return WITH + " " + " union all ".join(parts)


TABLE_VIOLATIONS = _violations_sql()


def table_cascade(spark, d):
    """Rows left in each table after users of a segment, feeds of a few nations and tags of a brand are deleted."""
    t = _library(spark, d)
    keys = {name: k[0] for name, k in schemas.PRIMARY_KEYS.items() if len(k) == 1}
    gone = {"users": t["users"].filter("email = 'BUILDING'").select("user_id"), "feeds": t["feeds"].filter("rss_url in ('https://f/1', 'https://f/2', 'https://f/3')").select("feed_id"), "tags": t["tags"].filter("name = 'Brand#11'").select("tag_id")}
    left = C.survivors(t, schemas.REFERENCES, keys, gone)
    return reduce(DataFrame.unionByName, (rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, rows in left.items()))


TABLE_CASCADE = (
    WITH
    + """, du as (select user_id from users where email = 'BUILDING'), df as (select feed_id from feeds where rss_url in ('https://f/1', 'https://f/2', 'https://f/3')),
dt as (select tag_id from tags where name = 'Brand#11'), de as (select episode_id from episodes where feed_id in (from df)), dp as (select playlist_id from curated_playlists where user_id in (from du))
select 'users' as table_name, count(*) as n from users where user_id not in (from du) union all select 'feeds', count(*) from feeds where feed_id not in (from df)
union all select 'tags', count(*) from tags where tag_id not in (from dt) union all select 'episodes', count(*) from episodes where episode_id not in (from de)
union all select 'curated_playlists', count(*) from curated_playlists where playlist_id not in (from dp) union all select 'insights', count(*) from insights where episode_id not in (from de)
union all select 'episode_tags', count(*) from episode_tags where episode_id not in (from de) and tag_id not in (from dt)
union all select 'user_episode_progress', count(*) from user_episode_progress where user_id not in (from du) and coalesce(episode_id not in (from de), true)
union all select 'playlist_episodes', count(*) from playlist_episodes where playlist_id not in (from dp) and episode_id not in (from de) union all select 'task_logs', count(*) from task_logs"""
)


def apply_results(spark, d):
    """Pairs of episodes and tags after results were applied twice; a third of the tags and some pairs are stored before."""
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("episode_id"), "lang", "source", F.lit(None).cast("boolean").alias("processed"))
    tags = docs.select(F.concat(F.lit("old "), "lang").alias("tag_id"), F.col("lang").alias("name"), F.lit("language").alias("category")).dropna().distinct()
    bridge = docs.filter("source is not null and lang is not null").select("episode_id", F.concat(F.lit("old "), "lang").alias("tag_id")).distinct()
    analysed = docs.join(B.table(spark, d, "labels").select(F.col("doc_id").alias("episode_id")), "episode_id", "left_semi")
    results = analysed.select("episode_id", F.inline(F.array(*(F.struct(F.col(c).alias("name"), F.lit(k).alias("category")) for c, k in (("lang", "language"), ("source", "source"))))))
    once = U.apply_results(docs, tags, bridge, results)
    episodes, tags, bridge = U.apply_results(*once, results)
    return bridge.join(tags, "tag_id").join(episodes.select("episode_id", "processed"), "episode_id").select("episode_id", "tag_id", "name", "category", "processed")


APPLY_RESULTS = """with l as (select distinct doc_id from labels), p as (select distinct doc_id, 'old ' || lang as tag_id, lang as name, 'language' as category from documents where lang is not null and (source is not null or doc_id in (from l))
union select doc_id, sha256(source || chr(1) || 'source'), source, 'source' from documents where source is not null and doc_id in (from l))
select p.doc_id as episode_id, tag_id, name, category, p.doc_id in (from l) as processed from p join documents d on d.doc_id = p.doc_id"""

def apply_insights(spark, d):
    """Insights and processed flags after an analysis was applied twice; the second call brings one more that is too late."""
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    episodes = B.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("episode_id"), (F.col("doc_id") % 4 == 0).alias("processed"))
    k = F.col("doc_id")
    one = lambda title, at, kind: F.struct(at.cast("int").alias("timestamp_seconds"), title.alias("title"), F.lit("d").alias("detail"), F.lit(kind).alias("insight_type"))
    two = F.array(one(F.concat(F.lit("q"), "quality"), k % 60, "quality"), one(F.when(F.col("toxic") == 1, "toxic"), F.lit(None), "toxic"), one(F.concat(F.lit("q"), "quality"), k % 60, "quality"))
    found = B.table(spark, d, "labels").select(k.cast("string").alias("episode_id"), F.inline(two))
    stored = spark.createDataFrame([], schemas.TABLES["insights"])
    once = U.apply_insights(episodes, stored, found, now)
    late = found.unionByName(found.select("episode_id", F.lit(0).alias("timestamp_seconds"), F.lit("late").alias("title"), F.lit("d").alias("detail"), F.lit("late").alias("insight_type")))
    episodes, insights = U.apply_insights(*once, late, now)
    return insights.join(episodes, "episode_id").select("insight_id", "episode_id", "timestamp_seconds", "title", "insight_type", "processed")


APPLY_INSIGHTS = """with l as (select * from labels where doc_id in (select doc_id from documents) and doc_id % 4 <> 0),
f as (select distinct doc_id, cast(doc_id % 60 as integer) as t, 'q' || quality as title, 'quality' as kind from l where quality is not null union select distinct doc_id, null, 'toxic', 'toxic' from l where toxic = 1)
select sha256(f.doc_id || chr(1) || coalesce(cast(t as varchar), '') || chr(1) || title || chr(1) || kind) as insight_id, cast(f.doc_id as varchar) as episode_id, t as timestamp_seconds, title, kind as insight_type, true as processed
from f join documents d on d.doc_id = f.doc_id"""


def batch_constraints(spark, d):
    """A batch of episodes judged against a stored library: how many rows stay, and what the others break."""
    o, k = B.table(spark, d, "orders"), F.col("o_orderkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    row = [F.when(k % 11 != 4, name("e", k)).alias("episode_id"), name("f", F.col("o_custkey")).alias("feed_id"), F.when(k % 13 != 2, k.cast("string")).alias("guid"), F.when(k % 7 == 3, F.repeat(F.lit("t"), 600)).otherwise("t").alias("title"), F.lit("").alias("audio_url"), F.lit("first").alias("summary")]
    stored = {"feeds": B.table(spark, d, "customer").filter("c_custkey % 5 <> 0").select(name("f", F.col("c_custkey")).alias("feed_id")), "episodes": o.filter(k % 3 == 0).select(name("e", k).alias("episode_id"), name("f", F.col("o_custkey")).alias("feed_id"), k.cast("string").alias("guid"))}
    batch = o.filter((k % 3 != 0) | (k % 6 == 0)).select(*row)
    again = o.filter(k % 10 == 1).select(name("n", k).alias("episode_id"), *row[1:-1], F.lit("second").alias("summary"))
    kept, left = C.admitted(batch.unionByName(again), "episodes", stored)
    return left.groupBy("check", "column_name").agg(F.count("*").alias("n")).unionByName(kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("check"), F.lit("").alias("column_name"), "n"))


BATCH_CONSTRAINTS = """with b as (select o_orderkey as k, o_custkey as c, case when o_orderkey % 11 <> 4 then 'e' || o_orderkey end as id, 1 as r from orders where o_orderkey % 3 <> 0 or o_orderkey % 6 = 0
union all select o_orderkey, o_custkey, 'n' || o_orderkey, 2 from orders where o_orderkey % 10 = 1),
a as (select *, case when id is null then 'null' when k % 7 = 3 then 'length' when c % 5 = 0 then 'reference' when r = 1 and k % 3 = 0 then 'key' end as why from b),
n as (select *, row_number() over (partition by k order by why is not null, r) as place from a),
w as (select coalesce(why, case when k % 13 <> 2 and (k % 3 = 0 or place > 1) then 'unique' end, 'kept') as why from n)
select why as "check", case why when 'null' then 'episode_id' when 'length' then 'title' when 'reference' then 'feed_id' when 'key' then 'episode_id' when 'unique' then 'feed_id,guid' else '' end as column_name, count(*) as n from w group by why"""

QUERIES = {n.lower(): (globals()[n.lower()], sql) for n, sql in list(globals().items()) if n.isupper() and n.lower() in globals() and isinstance(sql, str)}

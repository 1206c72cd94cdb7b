"""Extensions: work that a library's users would build on the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import library as L
from ..operators import nearest as N
from ..operators import textindex as X
from ..operators import vectorindex as V
from ..storage import new_path, staged
from . import bindings as B

#: Search words, and the tags of the all-of filter.
NEEDLE, SIZES = "tion the", [1, 2, 3]


def _progress(spark, d):
    return B.table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("episode_id"), "ts", "value")


def ext_unread_per_feed(spark, d):
    """Unread episodes of each feed that a user has listened to; a value over 50 is a finished one."""
    e = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("episode_id"), F.col("o_custkey").alias("feed_id"))
    seen = _progress(spark, d).groupBy("user_id", "episode_id").agg(F.max((F.col("value") > 50).cast("int")).alias("done")).join(e, "episode_id")
    done = seen.groupBy("user_id", "feed_id").agg(F.sum("done").alias("n_done"))
    return done.join(e.groupBy("feed_id").agg(F.count("*").alias("n")), "feed_id").select("user_id", "feed_id", (F.col("n") - F.col("n_done")).alias("n_unread"))


EXT_UNREAD_PER_FEED = """with s as (select user_id, cast(props->>'$.k' as bigint) as k, max((value > 50)::int) as done from events group by all)
select user_id, o_custkey as feed_id, (select count(*) from orders x where x.o_custkey = o.o_custkey) - sum(done) as n_unread from s join orders o on o_orderkey = k group by user_id, o_custkey"""


def ext_progress_ratio(spark, d):
    e = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("episode_id"), (F.floor("o_totalprice") % 1000).alias("duration"))
    return _progress(spark, d).join(e, "episode_id").select("event_id", F.round(F.least(F.lit(1.0), F.try_divide("value", "duration")), 6).alias("ratio"))


EXT_PROGRESS_RATIO = """select event_id, round(case when dur = 0 then null else least(1.0, value / dur) end, 6) as ratio from
(select event_id, value, cast(floor(o_totalprice) as bigint) % 1000 as dur from events join orders on o_orderkey = cast(props->>'$.k' as bigint))"""


def ext_resume_position(spark, d):
    return L.latest(_progress(spark, d), ["user_id", "episode_id"], ["ts", "event_id"], ["value", "ts"])


EXT_RESUME_POSITION = "select user_id, cast(props->>'$.k' as bigint) as episode_id, arg_max(value, (ts, event_id)) as value, max(ts) as ts from events group by all"


def _processed(spark, d):
    done = B.table(spark, d, "labels").select("doc_id").distinct().withColumn("processed", F.lit(True))
    return B.table(spark, d, "documents").select("doc_id", "source", "lang").join(done, "doc_id", "left").fillna(False, ["processed"])


def ext_work_list(spark, d):
    return _processed(spark, d).filter("not processed").groupBy("source").agg(F.count("*").alias("n"))


EXT_WORK_LIST = "select source, count(*) as n from documents where doc_id not in (select doc_id from labels) group by source"


def ext_apply_results(spark, d):
    """Episodes after analysis: processed, and the tags of the results, inserted where missing."""
    marked = _processed(spark, d)
    results = marked.filter("processed").select("doc_id", F.explode(F.array(F.struct(F.col("lang").alias("name"), F.lit("language").alias("category")), F.struct(F.col("source").alias("name"), F.lit("source").alias("category")))).alias("t")).select("doc_id", "t.*")
    tags = results.select("name", "category").distinct().select(F.sha2(F.concat_ws("\x01", "name", "category"), 256).alias("tag_id"), "name", "category")
    return results.join(tags, ["name", "category"]).select("doc_id", "tag_id", "name", "category")


EXT_APPLY_RESULTS = """select doc_id, sha256(name || chr(1) || category) as tag_id, name, category from (select doc_id, lang as name, 'language' as category from documents
union all select doc_id, source, 'source' from documents) where doc_id in (select doc_id from labels)"""


def ext_task_log(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.when(k % 10 == 0, "failed").when(k % 3 == 0, "pending").otherwise("done")
    return B.table(spark, d, "events").groupBy(F.col("event_type").alias("task_type"), status.alias("status")).agg(F.count("*").alias("n"), F.countDistinct(k).alias("n_episodes"))


EXT_TASK_LOG = """select event_type as task_type, case when k % 10 = 0 then 'failed' when k % 3 = 0 then 'pending' else 'done' end as status, count(*) as n, count(distinct k) as n_episodes
from (select event_type, cast(props->>'$.k' as bigint) as k from events) group by all"""


def ext_tag_counts(spark, d):
    tags = B.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("tag"))
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct().join(tags, "l_partkey").groupBy("tag").agg(F.countDistinct("l_orderkey").alias("n_episodes"))


EXT_TAG_COUNTS = "select p_brand as tag, count(distinct l_orderkey) as n_episodes from lineitem join part on p_partkey = l_partkey group by p_brand"


def ext_tags_all_of(spark, d):
    tags = B.table(spark, d, "part").filter(F.col("p_size").isin(SIZES)).select(F.col("p_partkey").alias("l_partkey"), "p_size")
    rows = B.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(tags, "l_partkey").groupBy("l_orderkey").agg(F.countDistinct("p_size").alias("n_tags"))
    return rows.select("l_orderkey", "n_tags", (F.col("n_tags") == len(SIZES)).alias("all_of"))


EXT_TAGS_ALL_OF = "select l_orderkey, count(distinct p_size) as n_tags, count(distinct p_size) = 3 as all_of from lineitem join part on p_partkey = l_partkey where p_size in (1, 2, 3) group by l_orderkey"


def ext_insight_timeline(spark, d):
    at = F.col("l_linenumber") * 37
    rows = B.table(spark, d, "lineitem").select("l_orderkey", at.alias("at"), F.concat(F.lit("["), L.clock(at), F.lit("] "), F.col("l_returnflag")).alias("line"))
    return L.ranked(rows, ["l_orderkey"], ["at", "line"], name="place").select("l_orderkey", "place", "line")


EXT_INSIGHT_TIMELINE = """select l_orderkey, cast(row_number() over (partition by l_orderkey order by sec, line) as integer) as place, line from (select l_orderkey, l_linenumber * 37 as sec,
'[' || lpad(cast(l_linenumber * 37 // 60 as varchar), 2, '0') || ':' || lpad(cast(l_linenumber * 37 % 60 as varchar), 2, '0') || '] ' || l_returnflag as line from lineitem)"""


def ext_full_text(spark, d):
    """The five best documents for each benchmark item by tf-idf over all words."""
    words = lambda rows, key: rows.select(key, F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("w")).filter("w <> ''")
    docs, asked = B.table(spark, d, "documents"), words(B.table(spark, d, "benchmark"), "item_id").distinct()
    n = docs.count()
    tf = words(docs, "doc_id").join(asked.select("w").distinct(), "w", "left_semi").groupBy("doc_id", "w").agg(F.count("*").alias("tf"))
    tf = staged(tf, "tf")
    asked = staged(asked.join(tf.groupBy("w").agg(F.count("*").alias("df")), "w"), "asked")
    score = F.round(F.sum(F.col("tf") * F.log(F.lit(float(n)) / F.col("df"))), 4)
    # A document's words stay together, so where Spark can broadcast the items' words (it checks the size) a document is
    # scored where it is, and only the best of each task are shuffled.
    rows = tf.repartition("doc_id").join(asked, "w").groupBy("item_id", "doc_id").agg(score.alias("score"))
    return L.ranked(rows, ["item_id"], [F.desc("score"), "doc_id"], 5, "place").select("item_id", "place", "doc_id", "score")


EXT_FULL_TEXT = r"""with t as (select doc_id, w, count(*) as tf from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as w from documents) where w <> '' group by all),
a as (select distinct item_id, w from (select item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as w from benchmark) where w <> ''),
f as (select w, count(*) as df from t group by w),
s as (select item_id, doc_id, round(sum(tf * ln((select count(*) from documents)::double / df)), 4) as score from a join f using (w) join t using (w) group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as place, doc_id, score from s qualify place <= 5"""


def ext_full_text_index(spark, d):
    """The five best documents for each benchmark item by BM25, from an index that took the documents in two segments."""
    root, docs = new_path(spark, "index"), B.table(spark, d, "documents").select("doc_id", "text")
    X.init(spark, root)
    for part in (docs.filter("doc_id % 3 <> 0"), docs):
        X.add(part, root)
    return X.search(B.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), root)[0]


EXT_FULL_TEXT_INDEX = r"""with t as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from documents),
n as (select count(*)::double as n, sum(len(ws)) / count(*)::double as average from t),
p as (select doc_id, size, w, count(*) as tf from (select doc_id, len(ws) as size, unnest(ws) as w from t) group by all),
a as (select distinct item_id, w from (select item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as w from benchmark) where w <> ''),
f as (select w, count(*) as df from p group by w),
s as (select item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / average))) as score from a join f using (w) join p using (w) cross join n group by all)
select item_id as query_id, cast(row_number() over (partition by item_id order by round(score, 6) desc, doc_id) as integer) as place, doc_id, round(score, 4) as score from s qualify place <= 5"""


def ext_vector_top_k(spark, d):
    """The five most similar of all other vectors for each hundredth vector, by cosine, exactly."""
    rows = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return N.exact(rows.filter("id % 100 = 0"), rows, 5, 5)


EXT_VECTOR_TOP_K = """with s as (select q.vec_id as query_id, c.vec_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])), 5) as score
from embeddings q join embeddings c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as place, vec_id, score from s qualify place <= 5"""


def ext_vector_index(spark, d):
    """As ext_vector_top_k, from a stored index of cells: most of the same vectors, of which a test measures the share."""
    root = new_path(spark, "vectors")
    rows = B.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    V.build(rows, root)
    return V.search(rows.filter("vec_id % 100 = 0"), root).select("query_id", "place", "vec_id", F.round("score", 5).alias("score"))


def ext_chat_context(spark, d):
    rows = L.ranked(B.table(spark, d, "conversations"), ["conv_id"], [F.desc("turn"), F.desc("role"), F.desc("text")], 4, "back")
    return rows.select("conv_id", "turn", "role", "text", "back")


EXT_CHAT_CONTEXT = """select conv_id, turn, role, text, cast(row_number() over (partition by conv_id order by turn desc, role desc, text desc) as integer) as back from conversations qualify back <= 4"""


def ext_playlist_assembly(spark, d):
    rows = B.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("playlist_id"), F.col("l_orderkey").alias("episode_id")).agg(F.max("l_extendedprice").alias("score"))
    return L.ranked(rows, ["playlist_id"], [F.desc("score"), "episode_id"], 10).select("playlist_id", "episode_id", "position")


EXT_PLAYLIST_ASSEMBLY = """select l_suppkey as playlist_id, l_orderkey as episode_id, cast(row_number() over (partition by l_suppkey order by max(l_extendedprice) desc, l_orderkey) as integer) as position
from lineitem group by l_suppkey, l_orderkey qualify position <= 10"""


def ext_library_search(spark, d):
    docs = B.table(spark, d, "documents").filter(F.lower("text").contains(NEEDLE)).select(F.lit("episode").alias("kind"), F.col("doc_id").alias("id"))
    parts = B.table(spark, d, "part").filter(F.lower("p_name").rlike("a.*e$|1$")).select(F.lit("tag").alias("kind"), F.col("p_partkey").alias("id"))
    return docs.unionByName(parts)


EXT_LIBRARY_SEARCH = """select 'episode' as kind, doc_id as id from documents where contains(lower(text), 'tion the') union all
select 'tag', p_partkey from part where regexp_matches(lower(p_name), 'a.*e$|1$')"""

QUERIES = {n.lower(): (globals()[n.lower()], sql) for n, sql in list(globals().items()) if n.isupper() and n.lower() in globals() and isinstance(sql, str)}
QUERIES["ext_vector_index"] = (ext_vector_index, None)  # no SQL: an approximate search

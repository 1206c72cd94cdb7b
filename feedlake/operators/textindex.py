"""A stored inverted index over texts: new documents are added without a rebuild, and searched by BM25 within score bounds.

A segment holds the postings of the documents added at once, in rows of one word and one group of GROUP documents: the
documents with their counts and lengths, and beside them the largest count and the smallest length. These give an upper
bound for what a word adds to any document of the group, whatever documents are added later. A search first reads
bounds only. The most promising groups of each query are then scored whole, which gives a score that the last of the
best must reach; of the other groups, those whose bounds fall short of it are never read. A stop word's list is thus read
only in groups that also hold a query's other words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import staged
from . import library

GROUP, PARTS = 64, 64
K1, B = 1.2, 0.75
#: Groups of a query that are scored before the others are judged.
FIRST = 8
POSTINGS = "w string, g long, docs array<struct<doc_id:long,tf:long,n:long>>, most long, least long, part int"
STATS = "w string, df long, part int"
SEGMENTS = "segment long, documents long, words long"
KNOWN = "doc_id long"


def words(text: Column) -> Column:
    """The runs of letters and digits, in small letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _part(w: Column) -> Column:
    return F.pmod(F.xxhash64(w), F.lit(PARTS)).cast("int")


def init(spark: SparkSession, root: str) -> None:
    for name, schema in (("segments", SEGMENTS), ("documents", KNOWN)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def _segments(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(f"{root}/segments")


def add(docs: DataFrame, root: str) -> None:
    """Adds documents (doc_id, text) that the index does not hold, as a segment. A null text has no words, a null id is not
    added, of rows that repeat an id one counts (the smallest text). Nothing stored is read but ids, and nothing is
    written over; the segment's line comes last, so what a crash leaves behind is never seen."""
    spark = docs.sparkSession
    number = _segments(spark, root).agg(F.max("segment")).first()[0]
    number = 0 if number is None else number + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna(subset=["doc_id"]).groupBy("doc_id").agg(F.min("text").alias("text"))
    seen = _segments(spark, root).select("segment").join(spark.read.schema(f"{KNOWN}, segment long").parquet(f"{root}/documents"), "segment")
    rows = staged(rows.join(seen.select("doc_id"), "doc_id", "left_anti"), "new")
    counted = rows.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("ws")).select("doc_id", F.size("ws").cast("long").alias("n"), F.explode("ws").alias("w"))
    tf = counted.groupBy("doc_id", "w").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    # The group of a document: its segment, and its place in order of ids.
    g = F.shiftleft(F.lit(number).cast("long"), 44).bitwiseOR(F.pmod(F.floor(F.col("doc_id") / GROUP), F.lit(1 << 44)))
    lists = tf.groupBy("w", g.alias("g")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf", "n"))).alias("docs"), F.max("tf").alias("most"), F.min("n").alias("least"))
    lists.withColumn("part", _part(F.col("w"))).hint("rebalance", F.col("part")).write.mode("overwrite").partitionBy("part").parquet(f"{root}/postings/segment={number}")
    stored = spark.read.schema(POSTINGS).parquet(f"{root}/postings/segment={number}")
    df = stored.groupBy("w").agg(F.sum(F.size("docs")).alias("df")).withColumn("part", _part(F.col("w")))
    df.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{root}/df/segment={number}")
    rows.select("doc_id").write.mode("overwrite").parquet(f"{root}/documents/segment={number}")
    total = rows.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size(words(F.coalesce("text", F.lit(""))))), F.lit(0)).alias("words"))
    total.select(F.lit(number).cast("long").alias("segment"), "documents", F.col("words").cast("long")).coalesce(1).write.mode("append").parquet(f"{root}/segments")


def _stored(spark: SparkSession, root: str, name: str, schema: str, parts: list[int], segments: DataFrame) -> DataFrame:
    """A table's rows of the published segments, in the parts where the asked words lie."""
    rows = spark.read.schema(f"segment long, {schema}").parquet(f"{root}/{name}").filter(F.col("part").isin(parts))
    return rows.join(segments.select("segment"), "segment").drop("segment", "part")


def search(asked: DataFrame, root: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(query_id, place, doc_id, score) of the k best documents of each query (query_id, text) by BM25, ties to smaller ids,
    and the (query_id, g) that were scored, a count of the work done. Exact: bounds leave out only what can't be among
    the best. A word counts once in a query; queries without known words have no rows."""
    spark = asked.sparkSession
    segments = staged(_segments(spark, root), "segments")
    n, total = segments.agg(F.sum("documents"), F.sum("words")).first()
    terms = asked.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("w")).distinct()
    terms = staged(terms, "terms")
    parts = [r[0] for r in terms.select(_part(F.col("w"))).distinct().collect()]  # PARTS at most
    if not n or not parts:
        empty = spark.createDataFrame([], "query_id long, place int, doc_id long, score double")
        return empty, empty.select("query_id", F.lit(0).cast("long").alias("g"))
    df = _stored(spark, root, "df", STATS, parts, segments).join(terms.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.sum("df").alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = staged(terms.join(df, "w").select("query_id", "w", idf.alias("idf")), "terms")
    average = max(1.0, total / n)
    of = lambda tf, size: tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))
    lists = _stored(spark, root, "postings", POSTINGS, parts, segments)
    bounds = lists.select("w", "g", "most", "least").join(terms, "w").groupBy("query_id", "g").agg(F.sum(F.col("idf") * of(F.col("most"), F.col("least"))).alias("bound"))
    bounds = staged(bounds, "bounds")

    def scored(pairs):
        """Scores of all documents of the query's groups."""
        rows = terms.join(pairs, "query_id").join(lists.select("w", "g", "docs"), ["w", "g"])
        rows = rows.select("query_id", "idf", F.explode("docs").alias("d"))
        each = rows.groupBy("query_id", F.col("d.doc_id").alias("doc_id")).agg(F.sum(F.col("idf") * of(F.col("d.tf"), F.col("d.n"))).alias("score"))
        return library.ranked(each, ["query_id"], [F.desc(F.round("score", 6)), "doc_id"], k, "place")

    first = library.ranked(bounds, ["query_id"], [F.desc("bound"), "g"], FIRST).select("query_id", "g")
    first = staged(first, "first")
    best = staged(scored(first), "best")
    reached = best.filter(F.col("place") == k).select("query_id", F.col("score").alias("least"))
    # A query with fewer than k documents so far must see every other group.
    rest = bounds.join(first, ["query_id", "g"], "left_anti").join(reached, "query_id", "left")
    rest = staged(rest.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6)).select("query_id", "g"), "rest")
    both = best.select("query_id", "doc_id", "score").unionByName(scored(rest).select("query_id", "doc_id", "score"))
    out = library.ranked(both, ["query_id"], [F.desc(F.round("score", 6)), "doc_id"], k, "place").select("query_id", "place", "doc_id", F.round("score", 4).alias("score"))
    return out, first.unionByName(rest)

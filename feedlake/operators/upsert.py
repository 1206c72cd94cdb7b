"""The feed row's upsert and the episodes' insert-only append."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import first_truthy, key_of
from ..schemas import TABLES

GROUP = ["author", "description", "image_url", "category"]
POINTER = "run long, name string, source string, marks string, rejects string"
MARKS = "feed_id string, mark timestamp"
REJECTS = "rss_url string, reason string, detail string"
#: Parts of the stored episodes, by a hash of feed_id. A run reads the parts of its own feeds only.
BUCKETS = 64
STORED = ["feed_id", "guid", "title", "audio_url", "duration", "published_at", "summary"]


def in_order(fetches: DataFrame, key: str = "rss_url", time: str = "fetched_at") -> DataFrame:
    """One row per feed with the effect of its fetches one after the other, for upsert_feeds.

    fetches: key, time, title, GROUP, etag, last_modified, is_not_modified. Validators: the last that is not empty. Title
    and GROUP: the last ones of modified fetches with a title, for GROUP the last that is not empty. created holds GROUP of the
    very first fetch, which an unknown feed starts with whatever its title. Fetches of one instant: not modified ones
    come first, the others by title. One aggregation, so a feed of many fetches is summed up before the shuffle.
    """
    fresh = ~F.coalesce("is_not_modified", F.lit(False))
    order = F.struct(time, fresh, "title", *GROUP, "etag", "last_modified")
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    last = lambda c, when: F.max_by(c, F.when(when, order)).alias(c)
    titled = fresh & there("title")
    return fetches.groupBy(key).agg(
        last("title", titled), *(last(c, titled & there(c)) for c in GROUP), *(last(c, there(c)) for c in ("etag", "last_modified")),
        F.min_by(F.struct(*GROUP), order).alias("created"), F.every(~fresh).alias("is_not_modified"),
    )


def upsert_feeds(old: DataFrame, new: DataFrame, now, key: str = "rss_url") -> DataFrame:
    """All feeds after a fetch. new: key, title, GROUP, etag, last_modified, is_not_modified, and created of in_order, if
    a feed may have several fetches.

    Unknown feed: all metadata, an empty title replaced. Known and modified, with a title: title replaced,
    GROUP new or old; an empty title leaves all of these. Always: validators new or old, fetched now, active.
    Feeds not in new pass through untouched, so a failed fetch changes nothing. Other stored columns stay;
    a new feed has no errors and was created now.
    """
    o, n = old.alias("o"), new.alias("n")
    col = lambda side, c: F.col(f"{side}.{c}")
    fetched, fresh = col("n", key).isNotNull(), col("o", key).isNull()
    modified = fetched & ~fresh & ~F.coalesce(col("n", "is_not_modified"), F.lit(False)) & (F.coalesce(col("n", "title"), F.lit("")) != "")
    start = lambda c: F.coalesce(col("n", c), F.col("n.created")[c]) if "created" in new.columns else col("n", c)
    pick = lambda c: F.when(fresh, start(c)).when(modified, first_truthy(col("n", c), col("o", c))).otherwise(col("o", c)).alias(c)
    made = {"created_at": now, "error_count": F.lit(0)}
    told = {key, "feed_id", "title", *GROUP, "etag", "last_modified", "last_fetched_at", "sync_status"}
    stay = lambda c: (F.when(fresh, made[c]).otherwise(col("o", c)) if c in made else col("o", c)).alias(c)
    return o.join(n, col("o", key) == col("n", key), "full_outer").select(
        F.coalesce(col("o", key), col("n", key)).alias(key),
        F.coalesce(col("o", "feed_id"), key_of(col("n", key).cast("string"))).alias("feed_id"),
        F.when(fresh, first_truthy(col("n", "title"), F.lit("Untitled Podcast"))).when(modified, col("n", "title")).otherwise(col("o", "title")).alias("title"),
        *(pick(c) for c in GROUP),
        *(F.when(fetched, first_truthy(col("n", c), col("o", c))).otherwise(col("o", c)).alias(c) for c in ("etag", "last_modified")),
        F.when(fetched, now).otherwise(col("o", "last_fetched_at")).alias("last_fetched_at"),
        F.when(fetched, "active").otherwise(col("o", "sync_status")).alias("sync_status"),
        *(stay(c) for c in old.columns if c not in told),
    )


def episode_rows(parsed: DataFrame, now) -> DataFrame:
    """Parsed items as rows to append: link and enclosure type aren't stored, nothing is processed yet."""
    return parsed.select(key_of(F.col("feed_id").cast("string"), F.col("guid")).alias("episode_id"), *STORED, F.lit(None).cast("string").alias("transcript"), F.lit(False).alias("processed"), now.alias("created_at"))


def apply_results(episodes: DataFrame, tags: DataFrame, bridge: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(episodes, tags, bridge) after an analysis. results: episode_id, name, category, one row per tag found.

    Episodes with results are processed. A tag is stored once per (name, category): a stored one keeps its id (the
    smallest, if it is stored more than once), a new one gets a hash of both. Pairs are added where missing; rows of
    results with a null part, or of an episode that isn't stored, add no tag. A second call changes nothing.
    """
    pair = ["name", "category"]
    real = results.dropna(subset=["episode_id", *pair]).join(episodes.select("episode_id"), "episode_id", "left_semi")
    ids = tags.groupBy(*pair).agg(F.min("tag_id").alias("tag_id"))
    new = real.select(*pair).distinct().join(ids, pair, "left_anti").withColumn("tag_id", key_of(*map(F.col, pair)))
    added = real.join(ids.unionByName(new), pair).select("episode_id", "tag_id").distinct().join(bridge, ["episode_id", "tag_id"], "left_anti")
    done = results.select("episode_id").distinct().withColumn("_done", F.lit(True))
    marked = episodes.join(done, "episode_id", "left").withColumn("processed", F.coalesce("_done", "processed", F.lit(False))).select(*episodes.columns)
    return marked, tags.unionByName(new, allowMissingColumns=True), bridge.unionByName(added, allowMissingColumns=True)


def apply_insights(episodes: DataFrame, insights: DataFrame, found: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(episodes, insights) after an analysis. found: episode_id, timestamp_seconds, title, detail, insight_type, many an episode.

    An insight's key is a hash of its episode, time, title and type, so it is stored once: repeated in found (the smallest
    detail stays), or left behind by a call that ended before the episodes were marked. Episodes that are processed
    already take no more; those with rows in found are processed after it. Rows without a title, or of an episode that
    isn't stored, add nothing. A second call changes nothing.
    """
    waiting = episodes.filter(~F.coalesce("processed", F.lit(False))).select("episode_id").distinct()
    real = found.join(waiting, "episode_id", "left_semi").filter(F.coalesce("title", F.lit("")) != "")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("episode_id", "timestamp_seconds", "title", "insight_type")]
    keyed = real.withColumn("insight_id", key_of(*parts)).groupBy("insight_id", "episode_id", "timestamp_seconds", "title", "insight_type").agg(F.min("detail").alias("detail"))
    new = keyed.join(insights.select("insight_id"), "insight_id", "left_anti").withColumn("created_at", now)
    done = found.select("episode_id").distinct().withColumn("_done", F.lit(True))
    marked = episodes.join(done, "episode_id", "left").withColumn("processed", F.coalesce("_done", "processed", F.lit(False))).select(*episodes.columns)
    return marked, insights.unionByName(new.select(*insights.columns))


def bucket_of(feed_id: Column) -> Column:
    return F.pmod(F.xxhash64(feed_id.cast("string")), F.lit(BUCKETS)).cast("int")


def append_episodes(episodes: DataFrame, root: str) -> None:
    """Adds rows to the stored episodes, which lie in BUCKETS parts; a large part is written by several tasks."""
    placed = episodes.withColumn("bucket", bucket_of(F.col("feed_id"))).hint("rebalance", F.col("bucket"))
    placed.write.mode("append").partitionBy("bucket").parquet(f"{root}/episodes")


def stored_episodes(spark: SparkSession, root: str, feed_ids: DataFrame | None = None) -> DataFrame:
    """The stored episodes; with feed_ids, those of the parts in which these feeds lie. Only the parts' numbers,
    BUCKETS at most, come to the driver, and other parts aren't read."""
    rows = spark.read.schema(f"{TABLES['episodes']}, bucket int").parquet(f"{root}/episodes")
    if feed_ids is not None:
        rows = rows.filter(F.col("bucket").isin([r[0] for r in feed_ids.select(bucket_of(F.col("feed_id"))).distinct().collect()]))
    return rows.drop("bucket")


def publish(spark: SparkSession, episodes: DataFrame, feeds: DataFrame, root: str, run: int | None = None, source: str | None = None, marks: DataFrame | None = None, rejects: DataFrame | None = None) -> None:
    """Episodes, then feeds, marks and rejects, then one more pointer that names them: what a crash leaves behind is
    skipped as known next time. No file that a reader may hold is overwritten. A run without a number gets the last
    one's plus 1, whatever stream or job it comes from; source tells a later attempt that it was published. Runs into
    one library must come one at a time."""
    append_episodes(episodes, root)
    last = pointer(spark, root)
    number = run if run is not None else (last.run + 1 if last else 0)
    names = {}
    for kind, rows in (("feeds", feeds), ("marks", marks), ("rejects", rejects)):
        if rows is not None:
            names[kind] = f"{kind}_{number}_{uuid.uuid4().hex}"
            rows.write.parquet(f"{root}/{names[kind]}")
    row = (number, names["feeds"], source, names.get("marks"), names.get("rejects"))
    spark.createDataFrame([row], POINTER).coalesce(1).write.mode("append").parquet(f"{root}/pointers")


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    """All pointers: one short row for each run. Made empty where there are none."""
    spark.createDataFrame([], POINTER).write.mode("ignore").parquet(f"{root}/pointers")
    return spark.read.schema(POINTER).parquet(f"{root}/pointers")


def pointer(spark: SparkSession, root: str) -> Row | None:
    """The pointer of the last run that was published whole."""
    return _pointers(spark, root).agg(F.max(F.struct("run", "name", "source", "marks", "rejects"))).first()[0]


def was_published(spark: SparkSession, root: str, source: str) -> bool:
    return not _pointers(spark, root).filter(F.col("source") == source).isEmpty()


def current_feeds(spark: SparkSession, root: str) -> DataFrame:
    """The feeds of the last run that was published whole."""
    return spark.read.parquet(f"{root}/{pointer(spark, root).name}")


def current_marks(spark: SparkSession, root: str) -> DataFrame:
    """feed_id, mark: the latest date of each feed's stored episodes. A library without stored marks has them made once."""
    last = pointer(spark, root)
    if last and last.marks:
        return spark.read.schema(MARKS).parquet(f"{root}/{last.marks}")
    return stored_episodes(spark, root).groupBy("feed_id").agg(F.max("published_at").alias("mark")).dropna()


def advanced(marks: DataFrame, episodes: DataFrame) -> DataFrame:
    """Marks after new episodes: only marks and the new rows are read, never the stored episodes."""
    new = episodes.groupBy("feed_id").agg(F.max("published_at").alias("mark")).dropna()
    return marks.unionByName(new).groupBy("feed_id").agg(F.max("mark").alias("mark"))


def all_rejects(spark: SparkSession, root: str) -> DataFrame:
    """run, rss_url, reason, detail of all runs that were published whole."""
    names = [(r.run, r.rejects) for r in _pointers(spark, root).filter("rejects is not null").select("run", "rejects").collect()]
    if not names:
        return spark.createDataFrame([], f"run long, {REJECTS}")
    rows = spark.read.schema(REJECTS).parquet(*(f"{root}/{n}" for _, n in names))
    of = F.regexp_extract(F.col("_metadata.file_path"), "/rejects_([0-9]+)_[0-9a-f]+/", 1).cast("long")
    return rows.select(of.alias("run"), "rss_url", "reason", "detail")

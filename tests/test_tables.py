"""Cascades, results and stream duplicates on small fixtures."""

from pyspark.sql import functions as F

from feedlake.operators import integrity, upsert
from feedlake.storage import new_path
from feedlake.streaming import ingest


def test_a_repeated_key_takes_no_other_row_along(spark):
    feeds = spark.createDataFrame([("a",), ("b",)], "feed_id string")
    episodes = spark.createDataFrame([("e", "a"), ("e", "b"), ("f", None)], "episode_id string, feed_id string")
    insights = spark.createDataFrame([("i", "e"), ("j", "f"), ("k", None)], "insight_id string, episode_id string")
    tables, references = {"feeds": feeds, "episodes": episodes, "insights": insights}, {"episodes": [("feed_id", "feeds")], "insights": [("episode_id", "episodes")]}
    left = integrity.survivors(tables, references, {"feeds": "feed_id", "episodes": "episode_id", "insights": "insight_id"}, {"feeds": feeds.filter("feed_id = 'a'")})
    assert {(r.episode_id, r.feed_id) for r in left["episodes"].collect()} == {("e", "b"), ("f", None)}
    assert {r.insight_id for r in left["insights"].collect()} == {"j", "k"}


def test_results_with_nulls_strangers_and_repeated_tags(spark):
    episodes = spark.createDataFrame([("e", None), ("f", True), ("g", False)], "episode_id string, processed boolean")
    tags = spark.createDataFrame([("t2", "x", "c"), ("t1", "x", "c")], "tag_id string, name string, category string")
    bridge = spark.createDataFrame([("f", "t1")], "episode_id string, tag_id string")
    results = spark.createDataFrame([("e", "x", "c"), ("e", "x", "c"), ("f", "x", "c"), ("e", None, "c"), ("none", "y", "c"), (None, "z", "c")], "episode_id string, name string, category string")
    once = upsert.apply_results(episodes, tags, bridge, results)
    again = upsert.apply_results(*once, results)
    for e, t, b in (once, again):
        assert sorted(map(tuple, e.collect())) == [("e", True), ("f", True), ("g", False)]
        assert t.count() == 2
        assert sorted(map(tuple, b.collect())) == [("e", "t1"), ("f", "t1")]


def test_stream_duplicates_within_a_delay(spark):
    landed, out = new_path(spark, "landed"), new_path(spark, "out")
    for second in (0, 5, 5):
        rows = spark.range(3).select(F.col("id"), F.timestamp_seconds(F.lit(1_000_000 + second)).alias("ts")).coalesce(1)
        rows.write.mode("append").parquet(landed)
    stream = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(landed)
    rows = ingest.dedup_within(stream, ["id"], "ts", "1 minute")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.schema("id long, ts timestamp").parquet(out).collect()) == [0, 1, 2]

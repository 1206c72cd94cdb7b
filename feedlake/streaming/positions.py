"""Resume positions as a stream: the latest position of each user in each episode, kept over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["user_id", "episode_id"]


def latest(stream: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's last row by order, as a streaming aggregate whose state is one row a key, for ever: a
    row that comes late changes nothing, in whatever batch it comes."""
    picked = F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    return stream.groupBy(*keys).agg(picked).select(*keys, "_last.*")


def run(stream: DataFrame, target: str, checkpoint: str, order: list[str], columns: list[str], keys: list[str] = KEYS) -> None:
    """Runs the stream to its end. Each batch writes the keys that changed into a part of its own, named by the batch's number
    and written over when a batch comes again, so target is the same after a failure."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    out = latest(stream, keys, order, columns)
    out.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str, schema: str, keys: list[str] = KEYS) -> DataFrame:
    """The positions as they stand: each key's row of its last batch."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(target)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")

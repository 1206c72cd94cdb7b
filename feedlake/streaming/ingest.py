"""Streams of landed items: what is new, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key, for ever: state keeps every key that was seen."""
    return stream.dropDuplicates(keys)


def dedup_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key within a delay, with state that is dropped after it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def append_new(stream: DataFrame, target: str, keys: list[str], checkpoint: str, schema: str):
    """Runs a stream to its end, appending to target what it does not hold. Each batch reads the known keys anew,
    so a batch that is repeated after a failure adds nothing."""

    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(schema).parquet(target).select(*keys)
        batch.filter(F.col(keys[-1]).isNotNull()).dropDuplicates(keys).join(known, keys, "left_anti").write.mode("append").parquet(target)

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

"""Where jobs keep their intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own only where it is unset, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not (sc.master.startswith("local[") or sc.master == "local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="feedlake-"))
        given = sc.getCheckpointDir()
    return given.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Corpus pipeline: documents to token shards, stage by stage.

Language identification drops documents of no learned language, the n-gram Jaccard join keeps one
document of each class of near copies, decontamination drops those that hold benchmark items, mixing deals
the sources' documents to their weights, and the last stage writes token shards and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedlake.llm import decontaminate, langid, mixing, similar, wavelet
from feedlake.llm.common import staged

STAGES = [
    ("language_id", langid.stage),
    ("jaccard_join", similar.stage),
    ("decontaminate", decontaminate.stage),
    ("mix_sources", mixing.stage),
    ("token_output", wavelet.stage),
]

#: No stage but the mixing's weights could be stated in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

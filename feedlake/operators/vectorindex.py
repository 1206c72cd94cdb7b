"""A stored index for vector retrieval: cells around centres, probed for each query, and an exact re-rank.

Vectors are scaled to length 1, centres are learned by k-means on a bounded sample, and every vector is stored with its
nearest cell. A query is dealt to its PROBES nearest cells and scored by cosine against their vectors only. A cell of many
vectors (copies of one, say) is stored in blocks, to which the query is dealt as well, so no cell meets in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import staged
from . import library, nearest

#: Rows from which the centres are learned, about, whatever the size of the table; all rows are indexed.
SAMPLE = 100_000
#: Centres at most, and vectors in a block of a cell.
CELLS, BLOCK = 1024, 4096
PROBES = 8
#: Queries that meet a block of a cell in one task, about, and digits to which scores are told apart.
ASKED, DIGITS = 4096, 12
ROW = "vec_id long, v array<double>, cell int, block int"


def unit(vectors: DataFrame) -> DataFrame:
    """vec_id, v of length 1; vectors that are null, zero or hold null or non-finite numbers go, null ids too."""

    def work(batches):
        for batch in batches:
            ids, (lens, at, flat) = batch.column(0), nearest.flat_rows(batch.column(1))
            for dim in np.unique(lens[lens > 0]).tolist():
                own = np.flatnonzero(lens == dim)
                v, good = nearest.units(flat[(at[own][:, None] + np.arange(dim)).ravel()].reshape(-1, dim))
                yield _listed(ids.take(pa.array(own[good])), v[good])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    return rows.filter("vec_id is not null and v is not null").mapInArrow(work, "vec_id long, v array<double>")


def _listed(ids: pa.Array, v: np.ndarray, **more: pa.Array) -> pa.RecordBatch:
    ends = np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ravel())), *more.values()], names=["vec_id", "v", *more])


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _nearest_cells(rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """vec_id, v, cells: the n nearest of the centres (CELLS at most), for vectors of their length."""
    n = min(n, len(centres))

    def work(batches):
        for batch in batches:
            flat = _matrix(batch.column(1), centres.shape[1])
            for lo in range(0, len(flat), 4096):
                far = (centres**2).sum(1) - 2 * flat[lo : lo + 4096] @ centres.T
                cells = np.argpartition(far, n - 1, axis=1)[:, :n] if n > 1 else far.argmin(1)[:, None]
                ends = np.arange(len(cells) + 1, dtype=np.int32) * n
                yield _listed(batch.column(0).slice(lo, len(cells)), flat[lo : lo + 4096], cells=pa.ListArray.from_arrays(pa.array(ends), pa.array(cells.ravel().astype("<i4"))))

    return rows.filter(F.size("v") == centres.shape[1]).select("vec_id", "v").mapInArrow(work, "vec_id long, v array<double>, cells array<int>")


def build(vectors: DataFrame, root: str, cells: int | None = None, seed: int = 1) -> None:
    """Indexes every usable vector (vec_id, v) of the commonest length (of two, the shorter); others can't be compared with
    these. cells: by default the root of their number, CELLS at most."""
    rows = staged(unit(vectors), "units")
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    n = most["count"] if most else 0
    rows = rows.filter(F.size("v") == most.d) if most else rows
    k = max(1, min(CELLS, cells or int(n**0.5)))
    # The sample is chosen by a hash of the id, so it does not depend on the layout of the table.
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20)) + 1
    model = KMeans(k=k, seed=seed, maxIter=10, featuresCol="f").fit(rows.filter(share).select(array_to_vector("v").alias("f"))) if n else None
    centres = np.array(model.clusterCenters()) if model else np.zeros((1, 1))
    spark = vectors.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, v array<double>").write.parquet(f"{root}/centres")
    placed = staged(_nearest_cells(rows, centres, 1).select("vec_id", "v", F.col("cells")[0].alias("cell")), "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = placed.join(F.broadcast(sizes), "cell")  # CELLS rows at most
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).select("vec_id", "v", "cell", "block")
    placed.repartitionByRange("cell", "block").sortWithinPartitions("cell", "block").write.parquet(f"{root}/vectors")


def search(queries: DataFrame, root: str, k: int = 5, probes: int = PROBES) -> DataFrame:
    """query_id, place, vec_id, score: the k best by cosine, to twelve digits, among the vectors of the query's cells, other ids
    only, ties to smaller ids. queries: (vec_id, v)."""
    spark: SparkSession = queries.sparkSession
    centres = np.array([r.v for r in spark.read.parquet(f"{root}/centres").orderBy("cell").collect()])  # CELLS at most
    stored, dim = spark.read.schema(ROW).parquet(f"{root}/vectors"), centres.shape[1]
    asked = _nearest_cells(unit(queries), centres, probes).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode("cells").alias("cell"))
    asked = staged(asked, "asked")
    # A block of a cell meets the cell's queries, ASKED at once: more of them go to several tasks, to which the block is dealt.
    parts = asked.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).alias("parts"))
    blocks = stored.groupBy("cell").agg(F.max("block").alias("last")).join(parts, "cell")  # CELLS rows at most
    asked = asked.join(F.broadcast(blocks), "cell").select("query_id", "q", "cell", F.pmod(F.xxhash64("query_id"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"))
    there = stored.join(F.broadcast(blocks), "cell").select("vec_id", "v", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "block")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        wide = lambda t, i, v: (t.column(i).to_numpy(), _matrix(t.column(v).combine_chunks(), dim))
        found = nearest.Best(*wide(left, "query_id", "q"), k, DIGITS)
        if left.num_rows and right.num_rows:
            found.add(*wide(right, "vec_id", "v"))
        return pa.Table.from_batches([found.rows()])

    key = ["cell", "part", "block"]
    rows = asked.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(best, nearest.FOUND)
    return library.ranked(rows, ["query_id"], [F.desc("score"), "vec_id"], k, "place").select("query_id", "place", "vec_id", "score")

"""Nearest neighbours by an exact block matrix join.

Vectors are packed into blocks. Every block of queries is dealt to every group of candidate blocks, and a
task multiplies one tile at a time: int8 codes give approximate inner products with a bound on the
quantisation error, only pairs whose upper bound reaches the k-th best lower bound survive, survivors are
computed again from the original vectors in double precision, and a heap per query merges the tiles. The
result is exact, so recall is 1.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 1024
#: Pairs computed again at once.
PAIRS = 1 << 16


def usable(v: Column) -> Column:
    """A vector that is not null or zero and whose components are all finite numbers."""
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """vectors (id long, v array) as blocks of one dimension: dim, ids and float64 components as bytes."""

    def pack(batches):
        held: dict[int, list] = {}
        kind = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])

        def block(dim):
            ids, data = zip(*held.pop(dim), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(data).tobytes()], pa.binary())], schema=kind)

        for batch in batches:
            v = batch.column(1)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype("<f8")
            lens = np.diff(v.offsets.to_numpy())
            at = np.concatenate(([0], np.cumsum(lens)))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for dim in np.unique(lens).tolist():
                own = np.flatnonzero(lens == dim)
                for lo in range(0, len(own), rows):
                    part = own[lo : lo + rows]
                    held.setdefault(dim, []).append((ids[part], flat[(at[part][:, None] + np.arange(dim)).ravel()]))
                    if sum(len(i) for i, _ in held[dim]) >= rows:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return vectors.mapInArrow(pack, "dim int, ids binary, data binary")


def _codes(x: np.ndarray):
    """int8 codes (held as float32, whose products of them are exact), scales, error norms and decoded norms."""
    scale = np.abs(x).max(1) / 127
    code = np.rint(x / scale[:, None])
    decoded = code * scale[:, None]
    return code.astype(np.float32 if x.shape[1] <= 1000 else np.float64), scale, np.linalg.norm(x - decoded, axis=1), np.linalg.norm(decoded, axis=1)


def _tile(q_ids, q, c_ids, c, k: int, heaps: dict) -> None:
    """Merges one tile's best pairs into heaps: query id -> {candidate id: score} as a heap of (score, -id)."""
    qc, qs, qe, _ = _codes(q)
    cc, cs, ce, cd = _codes(c)
    about = (qc @ cc.T).astype(np.float64) * (qs[:, None] * cs)
    # |q.x - about| <= |q| |x - x'| + |q - q'| |x'|, and a little for rounding.
    error = np.linalg.norm(q, axis=1)[:, None] * ce + qe[:, None] * cd
    error += 1e-9 * (np.abs(about) + 1e-300)
    about[q_ids[:, None] == c_ids] = -np.inf
    again = np.unique(c_ids, return_counts=True)[1].max()  # rows of one id count as one candidate
    low = about - error
    need = min(k * int(again), len(c_ids))
    floor = np.partition(low, len(c_ids) - need, axis=1)[:, len(c_ids) - need]
    known = np.array([h[0][0] if len(h := heaps.get(i, [])) == k else -np.inf for i in q_ids.tolist()])
    floor = np.maximum(floor, known - 1e-9 * np.abs(known))
    at_q, at_c = np.nonzero((about + error >= floor[:, None]) & np.isfinite(about))
    for lo in range(0, len(at_q), PAIRS):
        a, b = at_q[lo : lo + PAIRS], at_c[lo : lo + PAIRS]
        scores = np.zeros(len(a))  # added up from the first component to the last, so the sum does not depend on the tile
        for j in range(q.shape[1]):
            scores += q[a, j] * c[b, j]
        for query, cand, score in zip(q_ids[a].tolist(), c_ids[b].tolist(), scores.tolist(), strict=True):
            h = heaps.setdefault(query, [])
            item = (score, -cand)
            if len(h) == k and item <= h[0]:
                continue
            same = next((i for i, x in enumerate(h) if x[1] == -cand), None)
            if same is not None:
                if h[same] < item:
                    h[same] = item
                    heapq.heapify(h)
            elif len(h) < k:
                heapq.heappush(h, item)
            else:
                heapq.heapreplace(h, item)


def nearest(queries: DataFrame, candidates: DataFrame, k: int, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The k candidates of the largest inner product with each query: query_id, rank, vec_id, score.

    queries, candidates: (id long, v array of numbers). Ties go to the smaller id. A query's own id is no
    candidate; rows that share an id are one candidate, with the best of their scores. Unusable vectors
    and null ids take no part; vectors of another length than the query's are no candidates. Fewer than k
    candidates: all of them. Empty tables give no rows.
    """
    spark = queries.sparkSession
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keep = lambda df: df.select(F.col("id").cast("long").alias("id"), "v").filter(F.col("id").isNotNull() & usable(F.col("v")))
    cand = packed(keep(candidates), candidate_block).withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    ask = packed(keep(queries), query_block).select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    tiles = ask.join(cand, ["g", "dim"]).select("dim", "q_ids", "q_data", "ids", "data")

    def search(batches):
        """A join gives all candidate blocks of a query block in a row, so heaps are kept for one query block only."""
        heaps: dict[int, list] = {}
        now = None

        def best():
            for lo in range(0, len(ids := list(heaps)), 4096):
                rows = [(i, -c, s) for i in ids[lo : lo + 4096] for s, c in heaps[i]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                if r["q_ids"] != now:
                    yield from best()
                    heaps, now = {}, r["q_ids"]
                shaped = lambda d: np.frombuffer(d, "<f8").reshape(-1, r["dim"])  # noqa: B023, E731
                _tile(np.frombuffer(r["q_ids"], "<i8"), shaped(r["q_data"]), np.frombuffer(r["ids"], "<i8"), shaped(r["data"]), k, heaps)
        yield from best()

    found = tiles.mapInArrow(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest(rows.filter(F.col("id") % 20 == 0), rows, 20)

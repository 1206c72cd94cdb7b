"""The k vectors of the largest cosine for each query, found tile by tile in tasks.

A score is the cosine in double precision, rounded to a number of digits; ties go to the smaller id. Tiles multiply
vectors of length 1; what is so near to a half that a product's own error might round it otherwise is added up again from
the first component to the last, so a result does not depend on the tiles. exact() meets all candidates with all queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import library

#: Vectors of a block, and bytes of one, at most; queries that a task holds, about.
BLOCK, BLOCK_BYTES, QUERIES = 4096, 1 << 22, 1 << 14
#: Queries that meet a block of candidates at once.
SLICE = 256
#: Stored scores of pairs without a number: of a zero or non-finite vector (NaN, the largest), of a null one (null).
NAN, NULL = 2.0, -2.0


def flat_rows(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, starts and components of lists of doubles; null lists and lists that hold nulls have length 0."""
    lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(lens) - lens
    flat = column.flatten()
    if flat.null_count:
        holes = np.unique(np.repeat(np.arange(len(lens)), lens)[flat.is_null().to_numpy(zero_copy_only=False)])
        lens[holes] = 0
    return lens, at, flat.to_numpy(zero_copy_only=False).astype("<f8", copy=False)


def units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows scaled to length 1, and whether a row could be; others are zeros. First by the largest part, so that no
    square leaves the numbers' range."""
    most = np.abs(v).max(1, initial=0.0)
    good = np.isfinite(most) & (most > 0)
    out = np.zeros(v.shape)
    out[good] = v[good] / most[good, None]
    length = np.zeros(good.sum())
    for j in range(v.shape[1]):
        length += out[good, j] ** 2
    out[good] /= np.sqrt(length)[:, None]
    return out, good


def condensed(ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among the k of any query, in order of id: of equal vectors those of the smallest ids.
    A query leaves out one id, so rows of one id count k times at most, and 2 * k rows hold k of other ids than any."""
    order = np.argsort(ids, kind="stable")
    if not len(order):
        return order
    raw = np.ascontiguousarray(v[order]).view(np.dtype((np.void, v.shape[1] * 8))).ravel() if v.shape[1] else np.zeros(len(order))
    _, kind = np.unique(raw, return_inverse=True)
    nth = lambda *keys: _nth(np.lexsort(keys[::-1]), *keys)
    own = nth(kind, ids[order]) < k
    order, kind = order[own], kind[own]
    return order[nth(kind) < 2 * k]


def _nth(by: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """How many rows of equal keys come before each row; by: a stable order by the keys."""
    new = np.concatenate(([True], np.any([x[by][1:] != x[by][:-1] for x in keys], axis=0)))
    starts = np.flatnonzero(new)
    out = np.empty(len(by), np.int64)
    out[by] = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
    return out


class Best:
    """The k best of the candidates that were added, for queries of one length."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, digits: int):
        self.ids, self.k, self.scale = ids, k, 10.0**digits
        self.unit, self.good = units(v)
        self.score = np.full((len(ids), k), -np.inf)  # rounded and scaled, best first
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.far = (v.shape[1] + 8) * 4e-16 * self.scale  # no product is further from the sum in order

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        keep = condensed(ids, v, self.k)
        ids, v = ids[keep], v[keep]
        if not len(ids) or not len(self.ids):
            return
        unit, good = units(v)
        for lo in range(0, len(self.ids), SLICE):
            self._tile(slice(lo, lo + SLICE), ids, unit if v.shape[1] == self.unit.shape[1] else None, good)

    def _tile(self, at: slice, ids: np.ndarray, unit: np.ndarray | None, good: np.ndarray) -> None:
        own, k = self.ids[at], self.k
        if unit is None or not unit.shape[1]:  # of other lengths, or null
            about, sure = np.full((len(own), len(ids)), NULL * self.scale), True
        else:
            about, sure = (self.unit[at] * self.scale) @ unit.T, False
            about[:, ~good] = about[~self.good[at]] = NAN * self.scale
        for i, (a, b) in enumerate(zip(np.searchsorted(ids, own), np.searchsorted(ids, own, "right"), strict=True)):
            about[i, a:b] = -np.inf
        low = self.score[at, -1]
        if len(ids) > k and np.isneginf(low).any():
            low = np.maximum(low, np.floor(np.partition(about, len(ids) - k, axis=1)[:, len(ids) - k] + 0.5 - self.far))
        q, c = np.nonzero((about >= (low - 0.5 - self.far)[:, None]) & (about > -np.inf))
        score = about[q, c]
        whole = np.floor(np.abs(score) + 0.5)
        if not sure:
            near = np.flatnonzero((np.abs(np.abs(score) + 0.5 - np.rint(np.abs(score) + 0.5)) <= self.far) & (score != NAN * self.scale))
            for part in range(0, len(near), 1 << 16):
                p = near[part : part + (1 << 16)]
                a, b, total = self.unit[at][q[p]], unit[c[p]], np.zeros(len(p))
                for j in range(unit.shape[1]):
                    total += a[:, j] * b[:, j]
                score[p] = total * self.scale
                whole[p] = np.floor(np.abs(score[p]) + 0.5)
        score, c = np.copysign(whole, score) + 0.0, ids[c]
        last, last_id = self.score[at, -1][q], self.found[at, -1][q]
        better = (score > last) | ((score == last) & (c < last_id))
        q, score, c = q[better], score[better], c[better]
        rows = np.unique(q)
        if not len(rows):
            return
        q = np.concatenate((q, np.repeat(rows, k)))
        score, c = np.concatenate((score, self.score[at][rows].ravel())), np.concatenate((c, self.found[at][rows].ravel()))
        by = np.lexsort((c, -score, q))
        by = by[_nth(np.arange(len(by)), q[by]) < k]
        self.score[at.start + rows], self.found[at.start + rows] = score[by].reshape(-1, k), c[by].reshape(-1, k)

    def rows(self) -> pa.RecordBatch:
        """query_id, vec_id, score of what was found."""
        q, j = np.nonzero(self.score > -np.inf)
        score = self.score[q, j]
        nan, null = score == NAN * self.scale, score == NULL * self.scale
        told = pa.array(np.where(nan, np.nan, score / self.scale), pa.float64(), mask=null)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q], pa.int64()), pa.array(self.found[q, j], pa.int64()), told], names=["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def packed(vectors: DataFrame) -> DataFrame:
    """vectors (id long, v array<double>) as blocks of one length: dim, ids and components as bytes."""

    def pack(batches):
        held: dict[int, list] = {}

        def block(dim):
            ids, data = zip(*held.pop(dim), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(data).tobytes()], pa.binary())], names=["dim", "ids", "data"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            lens, at, flat = flat_rows(batch.column(1))
            for dim in np.unique(lens).tolist():
                own, most = np.flatnonzero(lens == dim), max(1, min(BLOCK, BLOCK_BYTES // (8 * max(dim, 1))))
                while len(own):
                    room = most - sum(len(i) for i, _ in held.get(dim, []))
                    part, own = own[:room], own[room:]
                    held.setdefault(dim, []).append((ids[part], flat[(at[part][:, None] + np.arange(dim)).ravel()]))
                    if len(part) == room:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return vectors.mapInArrow(pack, "dim int, ids binary, data binary")


def exact(queries: DataFrame, candidates: DataFrame, k: int, digits: int) -> DataFrame:
    """query_id, place, vec_id, score: the k candidates (id, v) of the largest cosine with each query (id, v), all of them if
    fewer; an id that equals the query's is no candidate.

    Scores are rounded to digits; ties go to the smaller id. The score with a zero or non-finite vector is NaN, which comes first, and
    with a vector that is null, empty, of another length or with a null inside it is null, which comes last, as in the SQL.
    Candidates are dealt to groups, to each of which the queries are sent; a task holds QUERIES of them, and candidates
    pass by block by block.
    """
    spark = queries.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups, parts = 2 * tasks, -(-queries.filter("id is not null").count() // QUERIES)
    if not parts:
        parts = 1
    typed = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).filter("id is not null")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    ask = packed(typed(queries)).select(every(groups).alias("g"), dealt(parts).alias("part"), F.lit(0).alias("kind"), "dim", "ids", "data")
    there = packed(typed(candidates)).select(dealt(groups).alias("g"), every(parts).alias("part"), F.lit(1).alias("kind"), "dim", "ids", "data")
    rows = ask.unionByName(there).repartition(tasks, "g", "part").sortWithinPartitions("g", "part", "kind")

    def search(batches):
        """A group's queries come first, by the sort."""
        now, waiting, best = None, {}, []
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                if (r["g"], r["part"]) != now:
                    yield from (b.rows() for b in best)
                    now, waiting, best = (r["g"], r["part"]), {}, []
                ids = np.frombuffer(r["ids"], "<i8")
                v = np.frombuffer(r["data"], "<f8").reshape(len(ids), r["dim"])
                if r["kind"] == 0:
                    waiting.setdefault(r["dim"], []).append((ids, v))
                    continue
                if waiting:
                    best, waiting = [Best(*map(np.concatenate, zip(*x, strict=True)), k, digits) for x in waiting.values()], {}
                for b in best:
                    b.add(ids, v)
        yield from (b.rows() for b in best)

    found = rows.mapInArrow(search, FOUND)
    return library.ranked(found, ["query_id"], [F.desc("score"), "vec_id"], k, "place").select("query_id", "place", "vec_id", "score")

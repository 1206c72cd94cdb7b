"""Hard negatives by exact integer tiles.

Vectors become integer codes and are packed into blocks. Blocks of anchors and of candidates meet in a grid of tasks,
where Strassen's recursion multiplies one tile at a time: sizes are padded with zeros to halve evenly, additions and
products are those of 64-bit integers, whose wrapping does no harm as long as the scores themselves fit (Python's own
integers stand in where they might not). A first pass over the tiles keeps a heap of positives for each anchor, a second
one a heap for each window of scores that a positive opens. Heaps of several tasks are merged by Spark's windows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_rows, staged, table

CANDIDATE_BLOCK, ANCHOR_BLOCK = 2048, 256
#: A side of a tile at which the recursion ends.
LEAF = 32
#: Scores below this bound in size are added up in 64 bits.
SAFE = 1 << 62


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of two integer matrices, by seven products of halves; odd sides get a row or column of zeros."""
    m, d = a.shape
    n = b.shape[1]
    if min(m, d, n) <= LEAF:
        return a @ b
    if m % 2 or d % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, d % 2)))
        b = np.pad(b, ((0, d % 2), (0, n % 2)))
        return strassen(a, b)[:m, :n]
    i, j, k = m // 2, d // 2, n // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((m, n), a.dtype)
    out[:i, :k] = p1 + p4 - p5 + p7
    out[:i, k:] = p3 + p5
    out[i:, :k] = p2 + p4
    out[i:, k:] = p1 - p2 + p3 + p6
    return out


def products(a: np.ndarray, b: np.ndarray):
    """Inner products of a's rows with b's as 64-bit integers, and which of them fit (None: all). a, b: whole doubles."""
    most = float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0))
    if most[0] * most[1] * max(1, a.shape[1]) < SAFE and max(most) < SAFE:
        return strassen(a.astype(np.int64), b.astype(np.int64).T), None
    exact = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    found = strassen(exact(a), exact(b).T)
    fits = (np.abs(found) < (1 << 63)).astype(bool)
    return np.where(fits, found, 0).astype(np.int64), fits


def best(scores: np.ndarray, ids: np.ndarray, k: int):
    """The k of the largest scores, ties to smaller ids, in that order."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
        if len(keep) > 4 * k:  # many ties at the edge: of those the smallest ids
            tied = keep[scores[keep] == edge]
            keep = np.concatenate((keep[scores[keep] > edge], tied[np.argpartition(ids[tied], k)[:k]] if len(tied) > k else tied))
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Heap:
    """The k best of what was added; merges with others by adding their rows."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.k:
            better = scores >= self.scores[-1]
            scores, ids = scores[better], ids[better]
        if len(scores):
            self.scores, self.ids = best(np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids)), self.k)


def usable(v: Column) -> Column:
    """A vector that is not null and whose components are all finite numbers, also when scaled."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double") * 256) < F.lit(float("inf"))))


_BLOCK = "dim int, ids binary, labels binary, codes binary, kind string, asks binary, counts binary"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows (id, label long, v array of doubles, asks array of longs) as blocks of one dimension, with the smallest
    type that holds the codes. asks are the scores of an anchor's positives, none for candidates and in the first pass."""
    kind = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("codes", pa.binary()), ("kind", pa.string()), ("asks", pa.binary()), ("counts", pa.binary())])

    def pack(batches):
        held: dict[int, list] = {}

        def block(dim):
            ids, labels, codes, asks, counts = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            as_type = next((t for t in ("<i2", "<i4") if np.abs(codes).max(initial=0) <= np.iinfo(t).max), "<f8")
            made = dict(dim=dim, ids=ids.astype("<i8").tobytes(), labels=labels.astype("<i8").tobytes(), codes=codes.astype(as_type).tobytes(), kind=as_type, asks=asks.astype("<i8").tobytes(), counts=counts.astype("<i4").tobytes())
            return pa.RecordBatch.from_pylist([made], schema=kind)

        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            v, asked = batch.column(2), batch.column(3)
            flat = np.floor(v.flatten().to_numpy(zero_copy_only=False).astype("<f8") * 256)
            at = np.concatenate(([0], np.cumsum(lens := np.diff(v.offsets.to_numpy()))))
            asks, counts = asked.flatten().to_numpy(zero_copy_only=False), np.diff(asked.offsets.to_numpy())
            ask_at = np.concatenate(([0], np.cumsum(counts)))
            for dim in np.unique(lens).tolist():
                own = np.flatnonzero(lens == dim)
                for lo in range(0, len(own), size):
                    part = own[lo : lo + size]
                    mine = np.concatenate([asks[ask_at[i] : ask_at[i + 1]] for i in part.tolist()])
                    held.setdefault(dim, []).append((ids[part], labels[part], flat[(at[part][:, None] + np.arange(dim)).ravel()], mine, counts[part]))
                    if sum(len(x[0]) for x in held[dim]) >= size:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.select("id", "label", "v", "asks").mapInArrow(pack, _BLOCK)


class Block:
    def __init__(self, r: dict, side: str):
        get = lambda n, t: np.frombuffer(r[f"{side}_{n}"], t)
        self.ids, self.labels, self.asks = get("ids", "<i8"), get("labels", "<i8"), get("asks", "<i8")
        self.codes = get("codes", r[f"{side}_kind"]).reshape(len(self.ids), r["dim"]).astype(float)
        self.ends = np.concatenate(([0], np.cumsum(get("counts", "<i4"))))


def grid(groups: int) -> tuple[int, int]:
    """Parts of the candidates and of the anchors. Each anchor block goes to every part of the candidates and the
    other way round, so with a hundred candidates for an anchor the former may be a hundred times as many."""
    cands = min(groups, 10 * math.isqrt(max(1, groups - 1)) + 10)
    return cands, max(1, groups // cands)


def _tiles(anchors: DataFrame, cands: DataFrame) -> DataFrame:
    groups = max(1, int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    of_c, of_a = grid(groups)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    named = lambda df, side: [F.col(c).alias(f"{side}_{c}") for c in df.columns if c != "dim"]
    left = anchors.select("dim", *named(anchors, "a"), F.pmod(F.xxhash64("ids", "labels"), F.lit(of_a)).cast("int").alias("ga")).withColumn("gc", each(of_c))
    right = cands.select("dim", *named(cands, "c"), F.pmod(F.xxhash64("ids", "labels"), F.lit(of_c)).cast("int").alias("gc")).withColumn("ga", each(of_a))
    return left.join(right, ["dim", "ga", "gc"]).drop("ga", "gc")


def _searched(anchors: DataFrame, cands: DataFrame, k: int, same_label: bool, low: int, high: int, name: str) -> DataFrame:
    """The best k candidates of each anchor (of the same label) or of each of its windows (of other labels), by task:
    anchor_id, label, ask, score, id. Written, since Arrow batches of two blocks in a row must be short."""
    kind = pa.schema([(n, pa.int64()) for n in ("anchor_id", "label", "ask", "score", "id")])

    def search(batches):
        heaps: dict[tuple, Heap] = {}
        now = None

        def rows():
            for lo in range(0, len(keys := list(heaps)), 4096):
                part = [(key, heaps[key]) for key in keys[lo : lo + 4096] if len(heaps[key].ids)]
                if part:
                    sizes = [len(h.ids) for _, h in part]
                    told = [np.repeat([key[j] for key, _ in part], sizes) for j in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*told, np.concatenate([h.scores for _, h in part]), np.concatenate([h.ids for _, h in part]))], schema=kind)

        for batch in batches:
            for r in batch.to_pylist():
                own = (r["dim"], r["a_ids"], r["a_labels"], r["a_codes"])
                if own != now:  # a join gives all candidates of an anchor block in a row: heaps of one such block are held
                    yield from rows()
                    heaps, now = {}, own
                a, c = Block(r, "a"), Block(r, "c")
                scores, fits = products(a.codes, c.codes)
                for i in range(len(a.ids)):
                    able = (c.ids != a.ids[i]) & ((c.labels == a.labels[i]) == same_label)
                    if fits is not None:
                        able &= fits[i]
                    at = np.flatnonzero(able)
                    mine, ids = scores[i, at], c.ids[at]
                    anchor = int(a.ids[i]), int(a.labels[i])
                    if same_label:
                        heaps.setdefault((*anchor, 0), Heap(k)).add(mine, ids)
                        continue
                    for ask in set(a.asks[a.ends[i] : a.ends[i + 1]].tolist()):
                        inside = (mine >= -(-low * ask // 100)) & (mine <= high * ask // 100)
                        heaps.setdefault((*anchor, ask), Heap(k)).add(mine[inside], ids[inside])
        yield from rows()

    with batch_rows(anchors.sparkSession, 8):
        return staged(_tiles(anchors, cands).mapInArrow(search, "anchor_id long, label long, ask long, score long, id long"), name)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    rows: (id, label, v array of numbers); anchor: a condition on id. Each component x becomes floor(256 * x), a score
    is an integer inner product. An anchor's positives are its best other rows of its label, a positive's negatives the
    best rows of other labels with low * positive score <= 100 * score <= high * positive score; ties go to smaller ids.
    Rows with a null id, label or vector, or a component that is null or not finite (also when scaled) take no part. Rows
    of another length than the anchor's and of the anchor's id are no candidates. Of rows that repeat an id each is a
    candidate; an anchor that is repeated with the same label and codes counts once, otherwise rows of one anchor id and
    label share their lists. A score that does not fit 64 bits is left out. Without positives, or without negatives in
    the window, an anchor has no rows; an empty table gives none.
    """
    whole = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "v")
    whole = whole.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).withColumn("v", F.col("v").cast("array<double>"))
    none = F.array().cast("array<bigint>")
    cands = staged(blocks(whole.withColumn("asks", none), CANDIDATE_BLOCK), "candidates")
    asking = whole.filter(anchor).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).dropDuplicates(["id", "label", "v"])
    first = _searched(blocks(asking.withColumn("asks", none), ANCHOR_BLOCK), cands, positives, True, 0, 0, "positives")
    order = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    found = first.withColumn("rank", F.row_number().over(order("anchor_id", "label"))).filter(F.col("rank") <= positives)
    found = staged(found.select("anchor_id", "label", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    asks = found.groupBy(F.col("anchor_id").alias("id"), "label").agg(F.collect_set("positive_score").alias("asks"))
    second = _searched(blocks(asking.join(asks, ["id", "label"]), ANCHOR_BLOCK), cands, negatives, False, low, high, "negatives")
    kept = second.withColumn("rank", F.row_number().over(order("anchor_id", "label", "ask"))).filter(F.col("rank") <= negatives)
    kept = kept.select("anchor_id", "label", F.col("ask").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(kept, ["anchor_id", "label", "positive_score"]).select("anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose vec_id is divisible by 7 are (label + 1) % 10."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("v"))
    out = hard_negatives(rows, F.col("id") % 100 == 0)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

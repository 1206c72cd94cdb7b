"""N-gram Jaccard self-join by T-occurrence search, and the classes that its links form.

Texts of equal shingle sets form one class first. A set's shingles are ordered from rare to common by a count
sketch of fixed size. Two sets of Jaccard t share one of their rarest n - ceil(t n) + 1 shingles: these are the
short inverted lists, and Spark brings the members of each together.

First round: the member whose lists are longest, so the most typical text of a group of near copies, is each
list's query (pivot) for its other members; a group costs about one search for each member, not one for each
pair. Second round: of a list whose members are not all of one component by now, every pair from different
components is compared by histograms, an exact upper bound of the overlap, in blocks of members, and what may
be linked is searched too. So no link between components is lost.

A search takes a query and a block of candidates and runs DivideSkip: the L longest of the query's lists over
the block are set aside, the short rest is heap-merged, and a candidate that has T - L occurrences there is
looked up in the long lists by binary search until it reaches its required overlap T or can't any more.
"""

from __future__ import annotations

import heapq
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, U64, batch_rows, bitmap, cut, free_names, mix64, staged, table, text_chunks, word_hash, words

WORDS, PERCENT = 4, 85
#: Words of a shingle and least similarity where the pipeline looks for near duplicates.
STAGE_WORDS, STAGE_PERCENT = 5, 80
#: Counters of the sketch that orders shingles by rarity.
SKETCH = 1 << 21
#: A shingle whose counter is beyond this is dealt by itself and its member together, as its list may be very long.
HOT_LIST = 1 << 20
#: Candidates in a block of a search, and members in a block of a list.
BLOCK, LIST_BLOCK = 256, 2048
#: Memory of the searches' targets up to which they are broadcast to where the texts are; beyond it sets are shuffled to them.
BROADCAST_BYTES, TARGET_BYTES = 32 << 20, 100
#: Texts, or sets of shingles, in an Arrow batch: the JVM and its Python worker each hold some at once, outside the heap.
BATCH_ROWS = 512
#: DivideSkip's weight of a merged element against a search.
MU = 0.0085
#: Bins of a class's histogram, and the count that stands for any larger one.
BINS, FULL = 256, 255
#: Classes that a task remembers to pass over copies; forgetting some costs only repeats.
SEEN = 100_000
_MIX = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5)]


def shingles(data: np.ndarray, offs: np.ndarray, k: int = WORDS):
    """Hashes of all runs of k words of each text (of all its words, where fewer), and their bounds by text."""
    data = LOWER[data]
    start, end, first = words(data, offs)
    w = word_hash(data, start, end)
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(n)))
    text = np.repeat(np.arange(len(n)), n)
    at = first[:-1][text] + np.arange(bounds[-1]) - bounds[:-1][text]
    h = np.zeros(len(at), U64)
    for j in range(k if len(w) else 0):
        there = j < count[text]
        h += np.where(there, w[np.minimum(at + j, len(w) - 1)] * _MIX[j % 4] * U64(2 * (j // 4) + 1), U64(0))
    return mix64(h + np.minimum(count, k)[text].astype(U64)), bounds


def sets(data: np.ndarray, offs: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, their bounds by text, and one number for each set (0: empty)."""
    h, bounds = shingles(data, offs, k)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:b].sort()
    first = np.zeros(len(h) + 1, bool)
    first[bounds] = True
    keep = first[:-1].copy()
    keep[1:] |= h[1:] != h[:-1]
    at = np.concatenate(([0], np.cumsum(keep)))[bounds]
    h = h[keep]
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix64(h), dtype=U64)))
    n = np.diff(at)
    return h, at, np.where(n > 0, mix64(total[at[1:]] - total[at[:-1]] + n.astype(U64)).view(np.int64), 0)


def rarity(docs: DataFrame, k: int = WORDS) -> np.ndarray:
    """Counts of shingles in SKETCH counters, over all texts; the parts of tasks' sketches meet as they stream in."""
    part = 1 << 14
    kind = pa.schema([("part", pa.int32()), ("n", pa.binary())])

    def rows(n):
        for p in np.flatnonzero(n.reshape(-1, part).any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([n[p * part : (p + 1) * part].astype("<u4").tobytes()], pa.binary())], schema=kind)

    def count(batches):
        n = np.zeros(SKETCH, np.int64)
        for _, data, offs in text_chunks(batches):
            n += np.bincount((shingles(data, offs, k)[0] & U64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        yield from rows(np.minimum(n, (1 << 32) - 1))

    def meet(batches):
        n = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for p, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[p * part : (p + 1) * part] += np.frombuffer(body, "<u4")
        yield from rows(np.minimum(n, (1 << 32) - 1))

    out = np.zeros(SKETCH, np.uint32)
    for r in docs.select("text").mapInArrow(count, "part int, n binary").repartition("part").mapInArrow(meet, "part int, n binary").toLocalIterator():
        out[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(bytes(r["n"]), "<u4")
    return out


def prefix_size(n, percent: int):
    return n + (-percent * n) // 100 + 1


def prefix(s: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
    """Places of the rarest members of a sorted set, by their counts; ties by the hash."""
    return np.argsort(count, kind="stable")[: prefix_size(len(s), percent)]


def histograms(s: np.ndarray, at: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """Of the sets in rows: how many members fall into each of BINS bins."""
    out = []
    for lo in range(0, len(rows), 1024):
        own = rows[lo : lo + 1024]
        size = at[own + 1] - at[own]
        place = np.repeat(at[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        bins = np.repeat(np.arange(len(own)), size) * BINS + ((s[place] >> U64(40)).astype(np.int64) & (BINS - 1))
        n = np.minimum(np.bincount(bins, minlength=len(own) * BINS), FULL).astype(np.uint8).reshape(-1, BINS)
        out += [x.tobytes() for x in n]
    return out


def _may_reach(x: np.ndarray, y: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether the overlap of sets of n members together may reach the required one, by their histograms."""
    least = np.minimum(x, y)
    return (least == FULL).any(1) | (least.sum(1, dtype=np.int64) * (100 + percent) >= percent * n)


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Sets of such sizes may be linked."""
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def divide_skip(query: np.ndarray, cands: list[np.ndarray], need: list[int]) -> dict[int, int]:
    """Overlap of each candidate that shares at least need[c] members with query, by T-occurrence search."""
    if not cands or not len(query):
        return {}
    flat = np.concatenate(cands)
    who = np.repeat(np.arange(len(cands)), [len(c) for c in cands])
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    hit = query[at] == flat
    at, who = at[hit], who[hit]
    order = np.lexsort((who, at))
    lists = np.split(who[order], np.flatnonzero(np.diff(at[order])) + 1) if len(at) else []
    lists.sort(key=len)
    least = max(1, min(need))
    longest = len(lists[-1]) if lists else 0
    aside = min(least - 1, len(lists), int(least / (MU * log2(longest + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    count: dict[int, int] = {}
    for c in heapq.merge(*(x.tolist() for x in short)):
        count[c] = count.get(c, 0) + 1
    left = np.array([c for c in sorted(count) if count[c] + len(long) >= need[c]], np.int64)
    have = np.array([count[c] for c in left.tolist()], np.int64)
    wants = np.array(need, np.int64)[left]
    for i, x in enumerate(long):
        if not len(left):
            break
        j = np.minimum(np.searchsorted(x, left), len(x) - 1)
        have = have + (x[j] == left)
        live = have + (len(long) - i - 1) >= wants
        left, have, wants = left[live], have[live], wants[live]
    return {c: n for c, n in zip(left.tolist(), have.tolist(), strict=True) if n >= need[c]}


def measured(docs: DataFrame, counts: np.ndarray, k: int, percent: int, hot_list: int = HOT_LIST) -> DataFrame:
    """(doc_id, th, cid, n_shingles, hist, sigs, hot) of each row. th: hash of its text; cid: its class, null for
    empty sets; hist and the signatures only where a task first meets a class; hot: those of long lists."""

    def measure(batches):
        seen: set[int] = set()
        for r, data, offs in text_chunks(batches):
            s, at, cids = sets(data, offs, k)
            fresh = []
            for i, c in enumerate(cids.tolist()):
                if c and c not in seen:
                    seen.add(c)
                    fresh.append(i)
            if len(seen) > SEEN:
                seen.clear()
            count = counts[(s & U64(SKETCH - 1)).astype(np.int64)]
            places = [at[i] + prefix(s[at[i] : at[i + 1]], count[at[i] : at[i + 1]], percent) for i in fresh]
            size = np.zeros(len(cids), np.int64)
            size[fresh] = [len(p) for p in places]
            place = np.concatenate(places) if places else np.zeros(0, np.int64)
            hot = count[place] > hot_list
            ends, whose = np.concatenate(([0], np.cumsum(size))), np.repeat(np.arange(len(cids)), size)
            many = np.concatenate(([0], np.cumsum(np.bincount(whose[hot], minlength=len(cids)))))
            hist = np.full(len(cids), None, object)
            hist[fresh] = histograms(s, at, np.array(fresh, np.int64))
            signs = s.view(np.int64)[place]
            yield pa.RecordBatch.from_arrays(
                [r.column("doc_id"), r.column("th"), pa.array(cids, mask=cids == 0), pa.array(np.diff(at)), pa.array(hist, pa.binary()), cut(signs[~hot], ends - many, pa.int64()), cut(signs[hot], many, pa.int64())],
                names=["doc_id", "th", "cid", "n_shingles", "hist", "sigs", "hot"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(measure, "doc_id long, th long, cid long, n_shingles long, hist binary, sigs array<long>, hot array<long>")


def _shared(batches):
    """Of rows (sig, c, n) sorted by sig and c: those of lists with two members and more, each once."""
    held = None  # the last row, and whether its list is known to have two members
    for batch in batches:
        sig, c, n = (batch.column(i).to_numpy() for i in range(3))
        told = False
        if held:
            sig, c, n = np.concatenate(([held[0]], sig)), np.concatenate(([held[1]], c)), np.concatenate(([held[2]], n))
            told = held[3]
        if not len(sig):
            continue
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (c[1:] != c[:-1])))
        sig, c, n = sig[new], c[new], n[new]
        edge = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1], [True])))
        size = np.diff(edge)
        size[0] += told
        many = np.repeat(size > 1, np.diff(edge))
        held = (sig[-1], c[-1], n[-1], bool(size[-1] > 1))
        many[0] &= not told  # it left with the batch before
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (sig, c, n)], names=["sig", "c", "n"])
    # A row that is alone in its list by the end was held and never left.


def lists_of(rows: DataFrame) -> DataFrame:
    """(sig, c, n): the members of all lists of two members and more; long lists may hold fewer."""
    post = lambda name: rows.filter(F.size(name) > 0).select(F.explode(name).alias("sig"), F.col("cid").alias("c"), F.col("n_shingles").alias("n"))
    some = post("sigs").repartition("sig").sortWithinPartitions("sig", "c").mapInArrow(_shared, "sig long, c long, n long")
    return some.unionByName(post("hot").distinct())


def with_pivots(lists: DataFrame) -> DataFrame:
    """(sig, c, n, p, np): the members with their list's pivot p, the one whose own lists are longest for its size."""
    size = lists.groupBy("sig").agg(F.count("*").alias("size"))
    typical = lists.join(size, "sig").groupBy("c").agg((F.sum("size") / F.first("n")).alias("typical"))
    best = lists.join(typical, "c").groupBy("sig").agg(F.max(F.struct("typical", "c", "n")).alias("best"))
    return lists.join(best, "sig").select("sig", "c", "n", F.col("best.c").alias("p"), F.col("best.n").alias("np"))


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """pairs (p, c) whose overlap may reach the one required: two sets can't share more than the sum over all
    bins of the lesser count. Exact: it only drops pairs that can't be similar enough, and needs no sets."""

    def bound(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                r = batch.slice(lo, 4096)
                x, y = (np.frombuffer(b"".join(r.column(n).to_pylist()), np.uint8).reshape(-1, BINS) for n in ("hp", "hc"))
                keep = _may_reach(x, y, r.column("np").to_numpy() + r.column("nc").to_numpy(), percent)
                yield r.select(["p", "c"]).filter(pa.array(keep))

    side = lambda a: classes.select(F.col("cid").alias(a), F.col("n").alias(f"n{a}"), F.col("hist").alias(f"h{a}"))
    both = pairs.join(side("p"), "p").join(side("c"), "c")
    return both.select("p", "c", "np", "nc", "hp", "hc").mapInArrow(bound, "p long, c long")


def search(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (p, c) whose Jaccard is at least percent / 100. The sets come from one text of each class, found
    again in a scan by a bit map; each goes to the blocks of the searches that ask for it, and nowhere else."""
    spread = pairs.groupBy("p").agg(F.count("*").alias("size"))
    blocks = pairs.join(spread, "p").select("p", F.pmod(F.xxhash64("c"), F.ceil(F.col("size") / F.lit(BLOCK))).alias("block"), "c")
    asks = blocks.select("p", "block").distinct().select("p", "block", F.lit(None).cast("long").alias("c"), F.col("p").alias("cid"))
    targets = asks.unionByName(blocks.withColumn("cid", F.col("c"))).join(classes.select("cid", "key"), "cid")
    targets = staged(targets.select("p", "block", "c", "key"), "targets")
    bits = bitmap(targets.select("key"))

    def fetch(batches):
        for batch in batches:
            wanted = bits.has(batch.column("key").to_numpy())
            for r, data, offs in text_chunks([batch.filter(pa.array(wanted))]):
                s, at, _ = sets(data, offs, k)
                body = [s[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([r.column("key"), pa.array(body, pa.binary())], names=["key", "s"])

    def run(batches):
        asked, q, was, ids, cs, size = None, None, None, [], [], 0

        def found():
            got = divide_skip(q, cs, [ceil(percent * (len(q) + len(c)) / (100 + percent)) for c in cs])
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([asked[0]] * len(got), pa.int64()), pa.array([ids[i] for i in got], pa.int64())], names=["p", "c"])

        for batch in batches:
            for p, block, c, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c is None:
                    if asked == (p, block):  # a repeated row
                        continue
                    if cs:
                        yield from found()
                    asked, q, was, ids, cs, size = (p, block), np.frombuffer(s, U64), None, [], [], 0
                elif c != was:
                    was = c
                    ids.append(c)
                    cs.append(np.frombuffer(s, U64))
                    size += len(cs[-1])
                    if size > 1 << 20:
                        yield from found()
                        ids, cs, size = [], [], 0
        if cs:
            yield from found()

    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"), "text").mapInArrow(fetch, "key long, s binary")
    rows = rows.join(F.broadcast(targets) if targets.count() * TARGET_BYTES <= BROADCAST_BYTES else targets, "key").select("p", "block", "c", "s").repartition("p", "block").sortWithinPartitions("p", "block", F.col("c").asc_nulls_first())
    return rows.mapInArrow(run, "p long, c long")


def searched(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The similar pairs as links (a, b), written."""
    links = search(pairs, docs, classes, k, percent).select(F.col("p").alias("a"), F.col("c").alias("b"))
    with batch_rows(pairs.sparkSession, BATCH_ROWS):
        return staged(links, "links")


def components(links: DataFrame) -> DataFrame:
    """(v, root): the smallest id reachable over links (a, b); one row per id that has a link."""
    edges = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    label = staged(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("b")).select("v", F.least("v", "b").alias("root")), "labels")
    while True:
        near = edges.join(label, edges["b"] == label["v"]).groupBy(F.col("a").alias("v")).agg(F.min("root").alias("other"))
        step = label.join(near, "v").select("v", F.least("root", "other").alias("root"), F.col("root").alias("was"))
        hop = label.select(F.col("v").alias("at"), F.col("root").alias("far"))
        step = step.join(hop, step["root"] == hop["at"]).select("v", F.least("root", "far").alias("root"), "was")
        step = staged(step, "labels")
        label = step.select("v", "root")
        if step.filter("root < was").isEmpty():
            return label


def crossing(stars: DataFrame, roots: DataFrame, classes: DataFrame, percent: int, block: int = LIST_BLOCK) -> DataFrame:
    """Pairs (p, c) that share a list, are in different components so far, don't hold the list's pivot, and may be
    linked by sizes and histograms. stars: sig, c, p. Lists with the same members are looked at once.

    A list is dealt in blocks of its members, and every two blocks of it meet in a task.
    """
    root = roots.select(F.col("v").alias("c"), "root")
    every = stars.select("sig", "c", "p").join(root, "c", "left").withColumn("root", F.coalesce("root", "c"))
    lists = every.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("c")).alias("alike"))
    lists = lists.filter("lo < hi and k > 2")  # of two members one was the other's pivot
    lists = lists.groupBy("alike", "k", "lo", "hi").agg(F.min("sig").alias("sig")).select("sig", F.ceil(F.col("k") / F.lit(block)).alias("blocks"))
    rows = every.join(staged(lists, "lists"), "sig").withColumn("mine", F.pmod(F.xxhash64("c"), F.col("blocks")))
    rows = rows.join(classes.select(F.col("cid").alias("c"), "n", "hist"), "c")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("sig", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "c", "p", "root", "n", "hist")

    def meet(batches):
        told: set[tuple[int, int]] = set()  # pairs sent; forgetting some costs only repeats
        for parts in _groups(batches, 3):
            for a, b in _pairs_between(pa.Table.from_batches(parts), percent):
                new = [x for x in zip(a.tolist(), b.tolist(), strict=True) if x not in told]
                if len(told) > SEEN:
                    told.clear()
                told.update(new)
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*new, strict=True)], names=["p", "c"])

    return rows.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y").mapInArrow(meet, "p long, c long").distinct()


def _groups(batches, width: int):
    """Runs of rows that agree in the first columns, as lists of slices."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(width)], 1)
        edge = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if held and key != keys[a].tolist():
                yield held
                held = []
            key = keys[a].tolist()
            held.append(batch.slice(a, b - a))
    if held:
        yield held


#: Pairs of a block compared at once.
AT_ONCE = 1 << 15


def _pairs_between(t: pa.Table, percent: int):
    """Of the members of one or two blocks of a list: pairs from different components that may be linked."""
    x, y, mine, c, p, root, n = (t.column(i).to_numpy() for i in range(1, 8))
    if root.min() == root.max():
        return
    order = np.argsort(n, kind="stable")
    h = np.frombuffer(b"".join(t.column(8).to_pylist()), np.uint8).reshape(-1, BINS)[order]
    across = x[0] != y[0]
    mine, c, p, root, n = (v[order] for v in (mine, c, p, root, n))
    last = np.searchsorted(n, n * 100 // percent, "right")  # sizes rise: those after it are too large
    count = np.maximum(last - np.arange(len(c)) - 1, 0)
    total = np.cumsum(count)
    i = 0
    while i < len(c):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + AT_ONCE, "right")))
        own = count[i:j]
        a = np.repeat(np.arange(i, j), own)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
        ok = (root[a] != root[b]) & (c[a] != p[a]) & (c[b] != p[b])
        if across:
            ok &= mine[a] != mine[b]
        a, b = a[ok], b[ok]
        ok = _may_reach(h[a], h[b], n[a] + n[b], percent)
        if ok.any():
            yield np.minimum(c[a[ok]], c[b[ok]]), np.maximum(c[a[ok]], c[b[ok]])
        i = j


def linked(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, hot_list: int = HOT_LIST, list_block: int = LIST_BLOCK) -> DataFrame:
    """(doc_id, th, cid, root, n_shingles, component_id) of each row; th: hash of its text; cid: its class, null for empty sets.

    Null text, or text without words, is an empty set: no links, its own doc_id. A null doc_id is passed
    over as a smallest id, and stays null where a class has no other. Repeated rows are rows of one
    class, unless empty. Empty tables give no rows; other columns are not read.
    """
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        rows = staged(measured(docs, rarity(docs, k), k, percent, hot_list), "sets")
    classes = rows.filter(F.col("cid").isNotNull()).groupBy("cid").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"), F.max("hist").alias("hist"), F.min(F.xxhash64("doc_id", "th")).alias("key"))
    classes = staged(classes, "classes")
    stars = staged(with_pivots(staged(lists_of(rows), "members")), "stars")
    first = stars.filter((F.col("c") != F.col("p")) & _fits(F.col("n"), F.col("np"), percent)).select("p", "c").distinct()
    first = staged(plausible(first, classes, percent), "pairs")
    links = searched(first, docs, classes, k, percent)
    roots = components(links)
    more = crossing(stars, roots, classes, percent, list_block)
    more = staged(more.join(first.select(F.least("p", "c").alias("p"), F.greatest("p", "c").alias("c")), ["p", "c"], "left_anti"), "more")
    if not more.isEmpty():
        again = searched(more, docs, classes, k, percent)
        roots = components(staged(links.union(again), "links"))
    of = roots.withColumnRenamed("v", "cid").join(classes.select("cid", "least"), "cid")
    of = of.join(of.groupBy("root").agg(F.min("least").alias("first")), "root").select("cid", "root", "first")
    verdict = staged(classes.select("cid", "least").join(of, "cid", "left").select("cid", F.coalesce("root", "cid").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("first")).alias("least")), "verdict")
    out = rows.select("doc_id", "th", "cid", "n_shingles").join(verdict, "cid", "left")
    return out.select("doc_id", "th", "cid", "root", "n_shingles", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class (five words, similarity of 0.8) the row of the smallest doc_id, by text hash where ids
    tie and null after all numbers, and every empty text. Columns of any names are kept."""
    found = staged(linked(docs, STAGE_WORDS, STAGE_PERCENT).select("doc_id", "th", "cid", "root"), "linked").filter(F.col("cid").isNotNull())
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    first = found.groupBy("root").agg(F.min(place).alias("first"))
    h, i, t = free_names(docs, "hash", "id", "th")
    gone = found.join(first, "root").filter(place != F.col("first")).select(F.col("doc_id").alias(i), F.col("th").alias(t)).distinct()
    again = staged(found.groupBy(F.col("doc_id").alias(i), F.col("th").alias(t)).count().filter("count > 1").select(i, t), "again")
    gone = staged(gone, "gone")
    bits = bitmap(gone.union(again).select(F.xxhash64(i, t)))

    @F.arrow_udf("boolean")
    def named(key: pa.Array) -> pa.Array:
        return pa.array(bits.has(key.to_numpy()))

    # Only rows that the map names meet the verdicts; all others stay where they are.
    every = docs.withColumn(h, F.xxhash64("text"))
    key = F.xxhash64(F.col("doc_id").cast("long"), h)
    keyed = every.filter(named(key))

    def on(x: DataFrame):
        return keyed["doc_id"].cast("long").eqNullSafe(x[i]) & (keyed[h] == x[t])

    kept = keyed.join(gone, on(gone), "left_anti")
    if not again.isEmpty():  # rows that are alike in id and text
        one = keyed.join(gone, on(gone), "left_anti").join(again, on(again), "left_semi").dropDuplicates(["doc_id", h])
        kept = kept.join(again, on(again), "left_anti").unionByName(one)
    return every.filter(~named(key)).unionByName(kept).select(*(F.col(f"`{c}`") for c in docs.columns))

"""Exact removal of repeated byte strings by depth-limited radix sort of suffixes.

Suffixes need ordering only through their first DEPTH bytes: those equal so far are a repeated window.
The most significant digit is the window's anchor, the least hash of its GRAM-byte strings, which equal
windows share wherever they are; windows of one anchor are neighbours and form a segment. A task meets
all segments of its anchors. Segments equal as a whole give their windows at once. Of different segments of
one anchor that agree on one side of it, those of the smallest documents are asked for: their bytes go to
tasks by anchor and are sorted by further digits of eight bytes, most significant first, keeping only groups
of two and more; what is equal at the last digit is a repeated window. An anchor of very many segments is
split by the next digits: its windows are dealt one by one, by their place about the anchor and their first
eight bytes, and equal ones of a task go as one. Every group removes its windows from all documents but the
smallest doc_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, binaries, mix64, prefix_hash, span_hash, staged, table, text_chunks

DEPTH, GRAM = 50, 16
#: A window has at least this many bytes before or after its anchor's gram.
SIDE = (DEPTH - GRAM) // 2
#: Longest piece of a text looked at at once; pieces overlap by DEPTH - 1 bytes.
PIECE = 1 << 22
POSITION_BITS = 24
#: Segments that a task gathers before it sends them on, in parts by anchor: at least BUCKETS, at most MOST_BUCKETS.
FLUSH, BUCKETS, MOST_BUCKETS = 1 << 19, 256, 1 << 20
#: An anchor of more different segments than this is split by the next digits.
HOT = 1 << 14
#: Windows compared at once.
AT_ONCE = 1 << 18

POSTING = np.dtype([("anchor", "<u4"), ("seg", "<u8"), ("left", "<u2"), ("right", "<u2"), ("doc", "<u4"), ("lo", "<u4"), ("len", "u1"), ("off", "u1")])
#: A segment whose bytes are asked for: its anchor's key, first window, number of windows, place of the anchor.
ASK = np.dtype([("key", "<u8"), ("lo", "<u4"), ("len", "u1"), ("off", "u1"), ("hot", "u1")])


def segments(data: np.ndarray, offs: np.ndarray, depth: int = DEPTH, gram: int = GRAM):
    """Segments of all texts: row, first window lo and past-the-last window hi (chunk positions), anchor
    position, anchor hash, segment hash, hashes of the gram with the bytes on either side."""
    base, ends, rows = [], [], []
    for row, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        for lo in range(a, max(b - depth + 1, a), PIECE):
            base.append(lo)
            ends.append(min(b, lo + PIECE + depth - 1))
            rows.append(row)
    parts = []
    first = 0
    while first < len(base):  # pieces that lie one after the other are looked at together
        last = first
        while last + 1 < len(base) and base[last + 1] >= ends[last] and ends[last + 1] - base[first] <= PIECE + depth:
            last += 1
        parts.append(_segments(data, base[first : last + 1], ends[first : last + 1], rows[first : last + 1], depth, gram))
        first = last + 1
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else None


def _segments(data, base, ends, rows, depth, gram):
    zero, n = base[0], ends[-1] - base[0]
    base, ends, rows = np.array(base) - zero, np.array(ends) - zero, np.array(rows)
    h = prefix_hash(data[zero : zero + n])
    at = np.arange(n - gram + 1)
    key = (span_hash(h, at, at + gram) & ~U64((1 << POSITION_BITS) - 1)) | at.astype(U64)
    least, width, wide = key, 1, depth - gram + 1
    while width * 2 <= wide:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if wide > width:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, base, 1)
    np.add.at(edge, ends - depth + 1, -1)
    start = np.flatnonzero(np.cumsum(edge[:-1]))
    anchor = (least[start] & U64((1 << POSITION_BITS) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    lo, a = start[new], anchor[new]
    hi = start[np.concatenate((new[1:], [len(start)])) - 1] + 1
    piece = np.searchsorted(base, lo, "right") - 1
    ahash = span_hash(h, a, a + gram)
    seg = mix64(span_hash(h, lo, hi + depth - 1) + (a - lo).astype(U64))
    side = (depth - gram) // 2
    # Without enough bytes on a side no window needs it: a value of its own.
    l, r = np.maximum(a - side, base[piece]), np.minimum(a + gram + side, ends[piece])
    left = np.where(a - l == side, span_hash(h, l, a + gram), ~seg)
    right = np.where(r - a == gram + side, span_hash(h, a, r), ~seg)
    return rows[piece], lo + zero, hi + zero, a + zero, ahash, seg, left, right


def _flushes(batches, depth, gram):
    """Gathers segments over a task's documents and yields them in flushes of one posting per anchor,
    segment and least document: (docs as (d, th), fields, followers). followers are segments of documents that
    also hold a smaller one's: all their windows are repeated."""
    docs, held, size, count = [], [], 0, 0

    def flush():
        doc, lo, hi, a, ah, seg, left, right = (np.concatenate(x) for x in zip(*held, strict=True))
        names = np.concatenate(docs)
        ids = names[doc, 0]
        order = np.lexsort((ids, seg, ah))
        new = np.concatenate(([True], (seg[order][1:] != seg[order][:-1]) | (ah[order][1:] != ah[order][:-1])))
        ids = ids[order]
        least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        lead = np.sort(order[ids == least])
        rest = np.sort(order[ids != least])
        fields = {"doc": doc, "lo": lo, "hi": hi, "a": a, "anchor": ah, "seg": seg, "left": left, "right": right}
        return names, {k: v[lead] for k, v in fields.items()}, {k: fields[k][rest] for k in ("doc", "lo", "hi")}

    for rows, data, offs in text_chunks(batches):
        found = segments(data, offs, depth, gram)
        if found is None:
            continue
        row, lo, hi, a, ah, seg, left, right = found
        held.append((row + count, lo - offs[row], hi - offs[row], a - offs[row], ah, seg, left, right))
        docs.append(np.stack((rows.column("d").to_numpy(), rows.column("th").to_numpy()), 1))
        count += len(offs) - 1
        size += len(lo)
        if size >= FLUSH:
            yield flush()
            docs, held, size, count = [], [], 0, 0
    if size:
        yield flush()


#: Rows that tasks exchange. kind: a posting's bucket, or what body holds.
ROWS = "kind int, d long, th long, body binary"
SPAN, ASKS = -1, -2


def _rows_of(kind: int, names: np.ndarray, doc: np.ndarray, items: np.ndarray):
    """Rows of one document each, with its items as bytes; doc rises."""
    if not len(doc):
        return
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    ends = np.concatenate((first, [len(doc)]))
    for lo in range(0, len(first), 4096):
        own = first[lo : lo + 4096]
        ids = names[doc[own]]
        part = ends[lo : lo + len(own) + 1]
        body = binaries(items[part[0] : part[-1]].view(np.uint8).ravel(), (part - part[0]) * items.itemsize * (items.size // len(items)))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(ids[:, 0]), pa.array(ids[:, 1]), body], names=["kind", "d", "th", "body"])


def _spans(names: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Rows of removed byte ranges: pairs (lo, hi); ranges of a document that meet are joined."""
    if not len(doc):
        return
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order].astype(np.int64), lo[order].astype(np.int64), hi[order].astype(np.int64)
    base = doc << 33  # beyond any place in a text, so documents stay apart
    a, b = joined(base + lo, base + hi)
    doc = a >> 33
    yield from _rows_of(SPAN, names, doc, np.stack((a - (doc << 33), b - (doc << 33)), 1).astype("<u4"))


def joined(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges sorted by lo."""
    if not len(lo):
        return lo, hi
    reach = np.maximum.accumulate(hi)
    new = np.concatenate(([True], lo[1:] > reach[:-1]))
    return lo[new], reach[np.concatenate((np.flatnonzero(new)[1:], [len(lo)])) - 1]


def n_buckets(spark: SparkSession) -> int:
    """A power of two that gives each shuffle partition four buckets and more."""
    n = BUCKETS
    while n < min(MOST_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))):
        n *= 2
    return n


def _rows(docs: DataFrame, *more: str) -> DataFrame:
    """d orders the documents (null before all numbers), th tells texts of one d apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("th"), "text", *more)


def repeated_spans(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Removed byte ranges: (d, th, body), possibly several rows per document."""

    buckets = n_buckets(docs.sparkSession)

    def post(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for names, lead, rest in _flushes(batches, depth, gram):
            yield from _spans(names, rest["doc"], rest["lo"], rest["hi"] + depth - 1)
            bucket = (lead["anchor"] & U64(buckets - 1)).astype(np.int64)
            rows = np.empty(len(bucket), POSTING)
            rows["anchor"], rows["seg"], rows["left"], rows["right"] = lead["anchor"] >> U64(32), lead["seg"], lead["left"] & U64(0xFFFF), lead["right"] & U64(0xFFFF)
            rows["doc"], rows["lo"], rows["len"], rows["off"] = lead["doc"], lead["lo"], lead["hi"] - lead["lo"], lead["a"] - lead["lo"]
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            out = []
            for own in np.split(rows, np.flatnonzero(np.diff(bucket)) + 1):
                used, doc = np.unique(own["doc"], return_inverse=True)
                own["doc"] = doc
                out.append((len(used), len(own), squeeze.compress(names[used].tobytes() + b"".join(own[f].tobytes() for f in POSTING.names))))
            at = np.unique(bucket).astype(np.int32)
            for k in range(0, len(out), 512):
                used, size, body = zip(*out[k : k + 512], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 512]), pa.array(used, pa.int64()), pa.array(size, pa.int64()), pa.array(body, pa.binary())], names=["kind", "d", "th", "body"])

    def meet(batches):
        grow = zstandard.ZstdDecompressor()
        held: dict[int, list] = {}
        for batch in batches:
            spans = pc.equal(batch.column(0), SPAN)
            if (own := batch.filter(spans)).num_rows:
                yield own
            for b, used, size, body in zip(*(c.to_pylist() for c in batch.filter(pc.invert(spans)).columns), strict=True):
                held.setdefault(b, []).append((used, size, body))
        for b in list(held):
            names, posts, n = [], [], 0
            for used, size, body in held.pop(b):
                body = grow.decompress(body)
                names.append(np.frombuffer(body, "<i8", 2 * used).reshape(-1, 2))
                rows, at = np.empty(size, POSTING), 16 * used
                for f in POSTING.names:
                    rows[f] = np.frombuffer(body, POSTING[f], size, at)
                    at += POSTING[f].itemsize * size
                rows["doc"] += n
                n += used
                posts.append(rows)
            names, p = np.concatenate(names), np.concatenate(posts)
            d = names[p["doc"], 0]
            order = np.lexsort((d, p["seg"], p["anchor"]))
            p, d = p[order], d[order]
            new = np.concatenate(([True], (p["seg"][1:] != p["seg"][:-1]) | (p["anchor"][1:] != p["anchor"][:-1])))
            at, of = np.flatnonzero(new), np.cumsum(new) - 1
            follows = d > d[at][of]
            gone = p[follows]
            lo = gone["lo"].astype(np.int64)
            yield from _spans(names, gone["doc"], lo, lo + gone["len"] + depth - 1)
            one = p[at]  # one of each different segment
            ask = _agree(one["anchor"], one["left"]) | _agree(one["anchor"], one["right"])
            _, first, many = np.unique(one["anchor"], return_index=True, return_counts=True)
            lead = ~follows & ask[of]
            p, asks = p[lead], np.zeros(lead.sum(), ASK)
            asks["key"] = p["anchor"].astype(np.uint64) << U64(32) | U64(b)
            asks["hot"] = np.repeat(many > hot, many)[of][lead]
            for f in ("lo", "len", "off"):
                asks[f] = p[f]
            order = np.argsort(p["doc"], kind="stable")
            yield from _rows_of(ASKS, names, p["doc"][order].astype(np.int64), asks[order])

    rows = _rows(docs)
    spread = F.when(F.col("kind") == SPAN, F.pmod(F.xxhash64("d", "th"), F.lit(buckets)).cast("int")).otherwise(F.col("kind"))
    found = staged(rows.mapInArrow(post, ROWS).repartition(spread).mapInArrow(meet, ROWS), "spans")
    asks = found.filter(F.col("kind") == ASKS).groupBy("d", "th").agg(F.collect_list("body").alias("asks"))

    def fetch(batches):
        for rows, data, offs in text_chunks(batches):
            bodies = [b"".join(x) for x in rows.column("asks").to_pylist()]
            ask = np.frombuffer(b"".join(bodies), ASK)
            row = np.repeat(np.arange(len(bodies)), [len(b) // ASK.itemsize for b in bodies])
            ids = np.stack((rows.column("d").to_numpy(), rows.column("th").to_numpy()), 1)[row]
            start, size = offs[row] + ask["lo"], ask["len"].astype(np.int64) + depth - 1
            key = ask["key"].view(np.int64)
            own = np.flatnonzero(ask["hot"] == 0)
            for lo in range(0, len(own), 1 << 13):
                s = own[lo : lo + (1 << 13)]
                ends = np.concatenate(([0], np.cumsum(size[s])))
                place = np.repeat(start[s] - ends[:-1], size[s]) + np.arange(ends[-1])
                yield _contexts(key[s], ids[s], ask["lo"][s], ask["off"][s], binaries(data[place], ends))
            own = np.flatnonzero(ask["hot"])
            if len(own):
                yield from _single(data, key[own], ids[own], start[own], ask[own], depth)

    def sort(batches):
        held, size = [], 0
        for batch in batches:
            told = batch.filter(pc.is_null(batch.column(5)))
            if told.num_rows:
                names, lo = np.stack((told.column(1).to_numpy(), told.column(2).to_numpy()), 1), told.column(3).to_numpy()
                names, doc = np.unique(names, axis=0, return_inverse=True)
                yield from _spans(names, doc.ravel(), lo, lo + depth)
            batch = batch.filter(pc.is_valid(batch.column(5)))
            while batch.num_rows:
                key = batch.column(0).to_numpy()
                if size > AT_ONCE:  # whole anchors only
                    n = int(np.searchsorted(key, held[-1].column(0)[-1].as_py(), "right"))
                    if n:
                        held.append(batch.slice(0, n))
                    if n == batch.num_rows:
                        break
                    yield from _sorted(pa.Table.from_batches(held), depth)
                    held, size, batch = [], 0, batch.slice(n)
                    continue
                held.append(batch.slice(0, 1 << 12))
                size += 20 * held[-1].num_rows
                batch = batch.slice(1 << 12)
        if held:
            yield from _sorted(pa.Table.from_batches(held), depth)

    texts = rows.join(asks, ["d", "th"]).select("d", "th", "text", "asks")
    fetched = texts.mapInArrow(fetch, "key long, d long, th long, lo long, off long, ctx binary")
    more = fetched.repartition("key").sortWithinPartitions("key").mapInArrow(sort, ROWS)
    return found.filter(F.col("kind") == SPAN).unionByName(more).select("d", "th", "body")


def _contexts(key, ids, lo, off, ctx) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(lo.astype(np.int64)), pa.array(off.astype(np.int64)), ctx], names=["key", "d", "th", "lo", "off", "ctx"])


def _single(data, key, ids, start, ask, depth):
    """The windows of hot anchors, each by itself: of equal ones those of the smallest document go on, keyed by the
    anchor, their place about it and their first eight bytes; the others are removed here (ctx is null)."""
    n = ask["len"].astype(np.int64)
    row = np.repeat(np.arange(len(ask)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    for lo in range(0, len(row), 1 << 15):
        r, k = row[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
        window = data[(start[r] + k)[:, None] + np.arange(depth)]
        about = (ask["off"][r].astype(np.int64) - k).astype(U64)
        digit = mix64(key[r].view(U64) ^ mix64(np.ascontiguousarray(window[:, :8]).view("<u8").ravel() + about))
        _, group = np.unique(np.ascontiguousarray(np.concatenate((about[:, None].view(np.uint8).reshape(len(r), -1), window), 1)).view(f"V{depth + 8}").ravel(), return_inverse=True)
        _, group = np.unique(np.stack((group.ravel(), key[r]), 1), axis=0, return_inverse=True)
        group = group.ravel()
        least = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids[r, 0])
        first = ids[r, 0] == least[group]
        ctx = binaries(window.ravel(), np.arange(len(r) + 1) * depth)
        yield _contexts(digit.view(np.int64), ids[r], ask["lo"][r] + k, np.zeros(len(r)), pc.if_else(pa.array(first), ctx, pa.scalar(None, pa.binary())))


def _sorted(t: pa.Table, depth: int):
    """Spans of the windows of some whole anchors that also start in a smaller document."""
    key, d, th, lo, off = (t.column(i).to_numpy() for i in range(5))
    ctx = t.column(5).combine_chunks()
    ctx = ctx.chunk(0) if isinstance(ctx, pa.ChunkedArray) else ctx
    ends = np.frombuffer(ctx.buffers()[1], np.int32)[ctx.offset : ctx.offset + len(ctx) + 1].astype(np.int64)
    flat = np.frombuffer(ctx.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    row, place = repeated_windows(key, d, off, flat, ends - ends[0], depth)
    if len(row):
        names, doc = np.unique(np.stack((d[row], th[row]), 1), axis=0, return_inverse=True)
        start = lo[row] + place
        yield from _spans(names, doc.ravel(), start, start + depth)


def _agree(anchor: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which segments agree on a side with a different one of their anchor."""
    order = np.lexsort((side, anchor))
    a, s = anchor[order], side[order]
    same = np.concatenate(([False], (a[1:] == a[:-1]) & (s[1:] == s[:-1]), [False]))
    out = np.zeros(len(a), bool)
    out[order] = same[1:] | same[:-1]
    return out


def repeated_windows(anchor, d, off, flat: np.ndarray, ends: np.ndarray, depth: int):
    """(row, place) of every window of the contexts that also starts in a smaller d, by radix passes.
    Rows are sorted by anchor; a row's context is flat[ends[row] : ends[row + 1]]."""
    count = np.diff(ends) - depth + 1
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = ends[row] + place
    # First digit: the anchor and the window's place about it.
    run = np.cumsum(np.concatenate(([False], anchor[1:] != anchor[:-1])))
    group = run[row] * (4 * depth) + (place - off[row] + 2 * depth)
    _, group = np.unique(group, return_inverse=True)
    words = np.ndarray(len(flat) + 1, "<u8", np.concatenate((flat, np.zeros(8, np.uint8))), strides=(1,))
    for k in range(0, depth, 8):
        live = np.bincount(group)[group] > 1
        row, place, start, group = row[live], place[live], start[live], group[live]
        if not len(row):
            return row, place
        digit = words[start + k]
        if depth - k < 8:
            digit = digit & U64((1 << 8 * (depth - k)) - 1)
        order = np.lexsort((digit, group))
        g, x = group[order], digit[order]
        new = np.concatenate(([0], np.cumsum((g[1:] != g[:-1]) | (x[1:] != x[:-1]))))
        group = np.empty(len(g), np.int64)
        group[order] = new
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, d[row])
    gone = d[row] > least[group]
    return row[gone], place[gone]


def remove_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes).

    Null text is empty. A null doc_id comes before all numbers; rows of one doc_id do not remove from each
    other, so repeated rows give repeated results. Empty tables give no rows; other columns are not read.
    """
    spans = repeated_spans(docs, depth, gram, hot).groupBy("d", "th").agg(F.collect_list("body").alias("bodies"))
    rows = _rows(docs, "doc_id")

    def finish(batches):
        for rows, data, offs in text_chunks(batches):
            out = []
            for i, bodies in enumerate(rows.column("bodies").to_pylist()):
                text = data[offs[i] : offs[i + 1]]
                gone, n_spans = 0, 0
                if bodies:
                    pairs = np.frombuffer(b"".join(bodies), "<u4").reshape(-1, 2).astype(np.int64)
                    a, b = joined(*pairs[np.argsort(pairs[:, 0], kind="stable")].T)
                    edge = np.zeros(len(text) + 1, np.int32)
                    edge[a] += 1
                    edge[b] -= 1
                    text = text[np.cumsum(edge[:-1]) == 0]
                    gone, n_spans = int((b - a).sum()), len(a)
                body = text.tobytes()
                out.append((int(offs[i + 1] - offs[i]), gone, n_spans, hashlib.sha256(body).hexdigest(), body))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(x) for x in zip(*out, strict=True))], names=["doc_id", *names])

    full = rows.join(spans, ["d", "th"], "left").select("doc_id", "text", "bodies")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return full.mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op9_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")

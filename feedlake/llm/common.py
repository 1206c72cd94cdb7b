"""Helpers shared by the training-data operators: shared-folder staging, Arrow chunks, byte hashing."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once in a task; bounds the numpy temporaries, never the text.
CHUNK_BYTES = 2 << 20

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own only where it is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="feedlake-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df into the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what is written inside; the session's own setting comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, str(min(int(own), rows) if int(own) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo mod, equals rest; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


_KEPT: dict = {}


def kept(key, make):
    """What a Python worker holds from one task to the next, one thing only; made anew where another was held."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Frees what kept() holds, and Arrow's free pages: Spark gives a worker to any later task, whose memory it would take."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def text_chunks(batches, col: str = "text", max_bytes: int = CHUNK_BYTES):
    """Yields (rows, data, offsets): Arrow rows, their UTF-8 bytes as one uint8 array, and len+1 offsets.

    Null texts are empty. A chunk holds whole texts only, so a very long text is a chunk of its own.
    """
    let_go()
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(col)).cast(pa.large_string()).fill_null("")
        offs = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        start = 0
        while start < len(text):
            end = max(start + 1, int(np.searchsorted(offs, offs[start] + max_bytes, "right")) - 1)
            lo, hi = int(offs[start]), int(offs[end])
            body = text.buffers()[2]
            data = np.frombuffer(body, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
            yield batch.slice(start, end - start), data, offs[start : end + 1] - lo
            start = end
    pa.default_memory_pool().release_unused()


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), in wrapping arithmetic."""
    h = h ^ (h >> U64(32))
    h = h * U64(0x9E3779B97F4A7C15)
    h = h ^ (h >> U64(29))
    h = h * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


#: One fixed random 64-bit value for each byte value.
BYTE_RANDOM = np.random.RandomState(20240101).randint(0, 1 << 63, 256).astype(U64) * U64(2) + U64(1)
_POW = {"r": np.ones(1, U64)}
RADIX = U64(0x5851F42D4C957F2D)


def powers(n: int) -> np.ndarray:
    """RADIX ** 0..n-1 modulo 2**64."""
    if len(_POW["r"]) < n:
        p = np.full(max(n, 1 << 16), RADIX, U64)
        p[0] = 1
        _POW["r"] = np.multiply.accumulate(p)
    return _POW["r"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j]-H[i] the sum of value(byte k) * RADIX**k for i <= k < j, wrapping."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_RANDOM[data] * powers(len(data)), out=out[1:])
    return out


def inverse_powers(n: int) -> np.ndarray:
    key = "i"
    if key not in _POW or len(_POW[key]) < n:
        inv = U64(pow(int(RADIX), -1, 1 << 64))
        p = np.full(max(n, 1 << 16), inv, U64)
        p[0] = 1
        _POW[key] = np.multiply.accumulate(p)
    return _POW[key][:n]


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hash of each byte span [start, end)."""
    h = (prefix[end] - prefix[start]) * inverse_powers(len(prefix))[start]
    return mix64(h + (end - start).astype(U64) * U64(0x94D049BB133111EB))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offs: np.ndarray):
    """Starts and ends of the maximal runs of non-space bytes, never across texts, and each text's first word."""
    solid = ~IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    start = np.flatnonzero(solid & (first[:-1] | ~np.concatenate(([False], solid[:-1]))))
    end = np.flatnonzero(solid & (first[1:] | ~np.concatenate((solid[1:], [False])))) + 1
    return start, end, np.searchsorted(start, offs)


def cut(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array: values between consecutive bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array: the bytes between consecutive ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


#: Spans up to this many bytes are hashed eight bytes at a time, longer ones by BLAKE2.
LONG = 64
_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span [start, end). Every eight bytes are mixed before the next are added, so unlike
    a polynomial modulo 2**64 it has no known pairs of equal hash."""
    n = end - start
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    h = n.astype(U64) * U64(0x94D049BB133111EB)
    for k in range(0, min(LONG, int(n.max(initial=0))), 8):
        live = np.flatnonzero((n > k) & (n <= LONG))
        own = eight[start[live] + k] & _BYTES[np.minimum(n[live] - k, 8)]
        h[live] = mix64(h[live] ^ own)
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores as keep them apart from df's columns, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns of these names, in whatever case."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone))


#: Bits of a map at most, and its parts.
MOST_BITS, PARTS = 28, 256


class Bits:
    """A bit map of 64-bit hashes, asked by their low bits."""

    def __init__(self, power: int):
        self.power, self.bits = power, np.zeros((1 << power) // 8, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h.astype(np.int64) & ((1 << self.power) - 1)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bitmap(keys: DataFrame) -> Bits:
    """A bit map of the one column of keys, 64-bit hashes: 16 bits for each row and 2**MOST_BITS (32 MB) at most.
    Beyond that more hashes are taken for keys; the caller joins with the keys after it, so results are the same."""
    out = Bits(min(MOST_BITS, max(16, (16 * keys.count()).bit_length())))
    per = (1 << out.power) // PARTS
    at = F.col(keys.columns[0]).bitwiseAND(F.lit((1 << out.power) - 1).cast("long"))
    spread = keys.select((at / per).cast("int").alias("part"), (at % per).cast("int").alias("at")).repartition("part")

    def fill(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            part, at = (batch.column(i).to_numpy() for i in (0, 1))
            for p in np.unique(part).tolist():
                own = at[part == p]
                np.bitwise_or.at(held.setdefault(p, np.zeros(per // 8, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        for p, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["part", "bits"])

    for r in spread.mapInArrow(fill, "part int, bits binary").toLocalIterator():  # PARTS rows
        out.bits[r["part"] * (per // 8) : (r["part"] + 1) * (per // 8)] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out

"""Token-ID output: whole texts as token ids in one wavelet-matrix file image per shard.

A shard image starts with a fixed header (magic, bits, documents, tokens), then the document starts, then one
bit plane per bit of an id, highest bit first. A plane is its count of zeros and a directory, which holds for
each chunk of CHUNK bits the number of ones before it and where its zstd-compressed bytes end, and the chunks.
Token access, counting and occurrence lookup walk the planes by rank and select: rank reads a number of the
directory and opens one chunk, select searches the directory and opens one chunk.

Spark writes the images as rows of Parquet files, so the output committer deals with lost executors
and any Hadoop file system will do.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_rows, kept, new_path, table

MAGIC = b"WMX2"
HEAD = struct.Struct("<4sBxxxIQ")
#: A plane's zeros, chunks, and bytes of all its chunks.
PLANE = struct.Struct("<QIQ")
CHUNK = 1 << 16
#: Tokens after which a task closes a shard and begins another (a longer document fills its own).
SHARD_TOKENS = 1 << 21
#: Distinct words whose ids a worker remembers; beyond it only words seen again stay. Results are the same.
CACHE_WORDS = 250_000
END_ID = 1
#: Texts in an Arrow batch: a task holds one batch on either side of its Python worker, besides the worker's words.
BATCH_ROWS = 512


def pack(ids: np.ndarray, starts: np.ndarray, bits: int) -> bytes:
    """The shard image of ids; starts: each document's first position, and the end."""
    ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    squeeze = zstandard.ZstdCompressor(level=1)
    out = [HEAD.pack(MAGIC, bits, len(starts) - 1, len(ids)), (body := squeeze.compress(starts.astype("<u8").tobytes()))]
    out.insert(1, struct.pack("<I", len(body)))
    for b in range(bits - 1, -1, -1):
        one = ((ids >> ids.dtype.type(b)) & ids.dtype.type(1)).astype(bool)
        chunks = [squeeze.compress(np.packbits(one[lo : lo + CHUNK], bitorder="little").tobytes()) for lo in range(0, len(one), CHUNK)]
        ones = np.cumsum([0, *(int(one[lo : lo + CHUNK].sum()) for lo in range(0, len(one), CHUNK))])[:-1]
        ends = np.cumsum([len(c) for c in chunks], dtype=np.int64)
        low, high = np.compress(~one, ids), np.compress(one, ids)  # several times faster than ids[one]
        out += [PLANE.pack(len(low), len(chunks), int(ends[-1]) if len(ends) else 0), ones.astype("<u8").tobytes(), ends.astype("<u8").tobytes(), *chunks]
        ids = np.concatenate((low, high))
    return b"".join(out)


class WaveletMatrix:
    """Reads a shard image. Positions and occurrence numbers count from 0."""

    def __init__(self, image: bytes):
        magic, self.bits, n_docs, self.n = HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        at = HEAD.size
        self.grow, self.image, self.open = zstandard.ZstdDecompressor(), image, {}
        (size,) = struct.unpack_from("<I", image, at)
        at += 4
        self.starts = np.frombuffer(self.grow.decompress(image[at : at + size]), "<u8").astype(np.int64)
        at += size
        self.zeros, self.ones, self.ends, self.base = [], [], [], []
        for _ in range(self.bits):
            z, chunks, size = PLANE.unpack_from(image, at)
            at += PLANE.size
            self.zeros.append(z)
            self.ones.append(np.frombuffer(image, "<u8", chunks, at).astype(np.int64))
            self.ends.append(np.frombuffer(image, "<u8", chunks, at + 8 * chunks).astype(np.int64))
            self.base.append(at + 16 * chunks)
            at += 16 * chunks + size

    def _chunk(self, level: int, c: int) -> np.ndarray:
        """The bits of one chunk; the last few that were opened are kept."""
        got = self.open.get((level, c))
        if got is None:
            ends, base = self.ends[level], self.base[level]
            body = self.grow.decompress(self.image[base + (ends[c - 1] if c else 0) : base + ends[c]])
            got = np.unpackbits(np.frombuffer(body, np.uint8), count=min(CHUNK, self.n - c * CHUNK), bitorder="little")
            if len(self.open) >= 4 * self.bits:
                self.open.pop(next(iter(self.open)))
            self.open[level, c] = got
        return got

    def decode(self) -> np.ndarray:
        """All ids: each stable partition is undone from the lowest plane upwards."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.concatenate([self._chunk(level, c) for c in range(len(self.ends[level]))] or [np.zeros(0, np.uint8)]).view(bool)
            z, up = self.zeros[level], np.empty(self.n, kind)
            up[np.flatnonzero(~one)] = ids[:z]
            up[np.flatnonzero(one)] = ids[z:] | kind(1 << (self.bits - 1 - level))
            ids = up
        return ids

    def _rank1(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        c, rest = divmod(i, CHUNK)
        if not rest:
            return int(self.ones[level][c]) if c < len(self.ones[level]) else self.n - self.zeros[level]
        return int(self.ones[level][c]) + int(self._chunk(level, c)[:rest].sum())

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of a plane's k-th one, or zero."""
        before = self.ones[level] if bit else np.arange(len(self.ones[level])) * CHUNK - self.ones[level]
        c = int(np.searchsorted(before, k, "right")) - 1
        return c * CHUNK + int(np.flatnonzero(self._chunk(level, c) == bit)[k - before[c]])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            r = self._rank1(level, i)
            if self._rank1(level, i + 1) - r:
                value, i = value * 2 + 1, self.zeros[level] + r
            else:
                value, i = value * 2, i - r
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before position i."""
        lo, hi = 0, i
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            one = token >> (self.bits - 1 - level) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if one else (lo - a, hi - b)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence of token, -1 if there are fewer: down to where its occurrences begin on
        the last plane, and up again from the k-th of them."""
        if not 0 <= k < self.count(token):
            return -1
        at = 0
        for level in range(self.bits):
            a = self._rank1(level, at)
            at = self.zeros[level] + a if token >> (self.bits - 1 - level) & 1 else at - a
        at += k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at


#: Marks that a stem of letters may carry at its end; each run of them is one piece of the pattern.
TAIL = ",.!?;:%*$&#|"
#: Lower-cases A-Z, and makes a line feed a blank.
ASCII_LOWER = bytes(range(10)) + b" " + bytes(range(11, 65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The one way of splitting and normalising for which pieces may be encoded one by one.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
NORMAL = ["NFC", "Replace", "Lowercase"]
#: A stem of letters that stay single letters in every normal form and case, so that it never joins the marks after it.
STEM = re.compile(f"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(TAIL)}]*)")
#: Bytes that end such a letter after a byte 0xC3; a-z; and the marks of which a lone one between a letter and a blank is a piece of its own.
LATIN, SMALL, COMMA = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
SMALL[97:123] = True
COMMA[[*b",.!?"]] = True


def spans(data: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Where the words of data begin, each with the blank after it; data ends with a blank. Where plain is set, a lone mark
    between a letter and a blank is a word of its own. Cut at blanks and after letters only, so ids stay the same."""
    blank = data == 32
    at = np.flatnonzero(COMMA[data] & plain)
    at = at[at > 0]
    at = at[blank[at + 1]]
    before = data[at - 1]
    at = at[SMALL[before] | (LATIN[before] & (at > 1) & (data[at - 2] == 0xC3))]
    first = np.zeros(len(data) + 1, bool)
    first[0] = True
    first[1:] = blank
    first[at] = True
    return np.flatnonzero(first[:-1])


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct word once.

    The tokenizer's own pattern never matches across a blank or a line feed, nor across the end of a run
    of letters, and it lower-cases; so the ids of a text are those of its pieces, one after the other.
    The words of a batch are numbered by Arrow, so that Python sees only distinct ones. Stems of ASCII and Latin-1
    letters are parted from the marks after them, lower-cased here and given to the tokenizer's model as they are: each
    is one piece. Other letters may change and join a mark when lower-cased, so words with them go the whole way.
    A tokenizer that splits or normalises in another way gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.known, self.old = Tokenizer.from_file(path), {}, {}
        self.bits = max(1, (self.tok.get_vocab_size() - 1).bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")
        how = json.loads(self.tok.to_str())
        normal = [x["type"] for x in (how["normalizer"] or {}).get("normalizers", [])]
        split = (how["pre_tokenizer"] or {}).get("pretokenizers", [])
        cut = len(split) == 2 and split[0].get("pattern", {}).get("Regex") == SPLIT and [split[1].get(k) for k in ("type", "add_prefix_space", "use_regex")] == ["ByteLevel", False, False]
        added = any(x["content"].isalpha() for x in how["added_tokens"])
        self.pieces = normal == NORMAL and cut and how["post_processor"] is None and how["model"]["type"] == "BPE" and not how["model"]["dropout"] and not added
        self.model, self.code = self.tok.model, self.kind.char
        # The byte-level alphabet: printable bytes stand for themselves, all others for letters from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.letters = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}

    def _each(self, pieces: list[str]) -> None:
        for w, e in zip(pieces, self.tok.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, self.kind).tobytes()

    def _stem(self, stem: str) -> bytes:
        low = stem.lower()
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(low)]).tobytes()

    def _learn(self, new: set[str]) -> None:
        whole, made = set(), []
        for w in new:
            found = STEM.fullmatch(w)
            if not found:
                whole.add(w)
            elif found[2]:
                made.append((w, *found.groups()))
            else:
                self.known[w] = self._stem(w)
        self._each(list(whole | {t for _, _, t in made if t not in self.known}))
        for w, stem, tail in made:
            if stem not in self.known:
                self.known[stem] = self._stem(stem)
            self.known[w] = self.known[stem] + self.known[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        end = np.array([END_ID], self.kind).tobytes()
        if not self.pieces:
            return [np.array(e.ids, self.kind).tobytes() + end for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        if not texts:
            return []
        # A special token's text is matched before lower-casing, so such texts keep their case.
        special = np.array(["<|" in t for t in texts], bool)
        low = [t.encode() if own else t.encode().translate(ASCII_LOWER) for t, own in zip(texts, special.tolist(), strict=True)]
        size = np.array([len(b) + 1 for b in low])
        low.append(b"")
        body = b" ".join(low)
        data = np.frombuffer(body, np.uint8)
        start = spans(data, np.repeat(~special, size) if special.any() else np.True_)
        offsets = np.append(start, len(data)).astype("<i8")
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        ids = self._ids(pc.utf8_rtrim(coded.dictionary.cast(pa.large_string()), " ").to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(ids), self.kind)
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        code = coded.indices.to_numpy()
        n = count[code]
        ends = np.concatenate(([0], np.cumsum(n)))
        made = flat[np.repeat((np.cumsum(count) - count)[code] - ends[:-1], n) + np.arange(ends[-1])]
        cut = ends[np.searchsorted(start, np.concatenate(([0], np.cumsum(size))))].tolist()
        return [made[a:b].tobytes() + end for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _ids(self, words: list[str]) -> list[bytes]:
        ids = list(map(self.known.get, words))
        new = [i for i, x in enumerate(ids) if x is None]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.old, self.known = self.known, {}
            new, ids = range(len(words)), [b""] * len(words)
        need = {words[i] for i in new}
        back = {w: self.old[w] for w in need if w in self.old}
        self.known.update(back)
        self._learn(need.difference(back))
        for i in new:
            ids[i] = self.known[words[i]]
        return ids


SHARD_SCHEMA = "part int, seq int, n_tokens long, n_docs long, doc_ids binary, nulls binary, image binary"


def write_shards(docs: DataFrame, out: str, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes documents in ascending doc_id order (null first, ties by text) and writes shard images.

    Range partitions by doc_id and the beginning of the text, so that rows of one id may be many; part and seq
    are a shard's place in the order. Each task closes a shard after shard_tokens ids.
    """

    def shards(batches):
        enc, part, seq = kept(tokenizer, lambda: WordEncoder(tokenizer)), TaskContext.get().partitionId(), 0
        ids, parts, size = [], [], 0

        def image():
            ends = np.cumsum([0, *(len(p) // enc.kind.itemsize for p in parts)])
            keys = np.array([x or 0 for x in ids], "<i8")
            null = np.array([x is None for x in ids], bool)
            body = pack(np.frombuffer(b"".join(parts), enc.kind), ends, enc.bits)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_tokens": int(ends[-1]), "n_docs": len(ids), "doc_ids": keys.tobytes(), "nulls": np.packbits(null).tobytes(), "image": body}], schema=kind)

        kind = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("doc_ids", pa.binary()), ("nulls", pa.binary()), ("image", pa.binary())])
        for batch in batches:
            rows = batch.to_pydict()
            for doc, own in zip(rows["doc_id"], enc.encode(rows["text"]), strict=True):
                ids.append(doc)
                parts.append(own)
                size += len(own) // enc.kind.itemsize
                if size >= shard_tokens:
                    yield image()
                    ids, parts, size, seq = [], [], 0, seq + 1
        if ids:
            yield image()

    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    with batch_rows(spark, BATCH_ROWS):
        rows.mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "none").parquet(out)


def read_shards(spark: SparkSession, out: str) -> DataFrame:
    """Per document, from the shard files: doc_id, start, n_tokens, ids_crc32, shard (its place in the order)."""

    def digest(batches):
        for batch in batches:
            for r in batch.to_pylist():
                wm = WaveletMatrix(r["image"])
                ids = wm.decode().astype("<u4")
                s = wm.starts
                null = np.unpackbits(np.frombuffer(r["nulls"], np.uint8), count=r["n_docs"]).view(bool)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(s[:-1].tolist(), s[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(r["n_docs"], r["shard"])), pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=null), pa.array(s[:-1]), pa.array(np.diff(s)), pa.array(crc, pa.int64())],
                    names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    stored = spark.read.schema(SHARD_SCHEMA).parquet(out)
    named = stored.withColumn("shard", F.shiftleft(F.col("part").cast("long"), 32) + F.col("seq"))
    # The ids before a shard: those of the parts before its own (one short row for each part), and in its part.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("ahead"))
    meta = named.select("part", "seq", "shard", "n_tokens").withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    meta = meta.join(parts, "part").select("shard", (F.col("ahead") + F.col("inside")).alias("before"))
    rows = named.select("shard", "n_docs", "doc_ids", "nulls", "image").mapInArrow(digest, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(meta, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_and_read(docs: DataFrame, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Every whole text (null: empty) as ids plus the end id, written as shards and read back.

    Rows with a null doc_id come first; rows that share a doc_id are ordered by text and all kept;
    an empty table gives no shard and no row; other columns are not carried.
    """
    out = new_path(docs.sparkSession, "tokens")
    write_shards(docs, out, tokenizer or tokenizer_path(), shard_tokens)
    return read_shards(docs.sparkSession, out)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, written as shards and read back."""
    return write_and_read(docs)

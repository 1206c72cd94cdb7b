"""Byte-level BPE by an Aho-Corasick automaton and backtracking.

The vocabulary's byte strings, read as Latin-1, are the words of an automaton, which gives the longest token that
begins at each byte of a piece in one pass. The encoder takes longest tokens from left to right. A token may follow
another if merging by ranks would put a boundary just there; this is found by undoing the two tokens' own merges
from the last one backwards, and is remembered for each pair. Where no token can follow, the last one is taken back
and the next shorter prefix token tried; a byte from which nothing led to the end is not tried again, so the work
is linear in the piece. The result is the only sequence whose neighbours are all compatible, which is that of the merges.

This needs a vocabulary in which each token is the merge of two tokens of lower rank (as training makes them); another
vocabulary is refused.
"""

from __future__ import annotations

import base64
import itertools
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Pairs of tokens whose compatibility a worker remembers, and pieces whose ids it does. Results are the same beyond it.
PAIRS, PIECES = 1 << 20, 600_000
#: Letters of a text split at once; a longer text is split lazily, some pieces at a time.
AT_ONCE, LAZY = 1 << 20, 1 << 16
#: Rows and bytes of a batch on its way back to Spark.
ROWS, BYTES = 512, 8 << 20


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (lines of base64 and rank) in the order of ranks, which are 0, 1, ..."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    tokens = [ranks.get(i) for i in range(len(ranks))]
    if None in tokens or len(set(tokens)) < len(tokens):
        raise ValueError("ranks must be 0, 1, ... and tokens distinct")
    if not {bytes([b]) for b in range(256)} <= set(tokens):
        raise ValueError("every byte must be a token")
    return tokens


class Vocabulary:
    """Automaton, last merges and shorter prefixes of a list of tokens in the order of ranks."""

    def __init__(self, tokens: list[bytes]):
        import ahocorasick

        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.size = array("i", map(len, tokens))
        self.find = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.find.add_word(t.decode("latin-1"), i)
        self.find.make_automaton()
        #: The longest token that is a proper prefix of each, or -1.
        self.shorter = array("i", (next((self.rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank), -1) for t in tokens))
        self.fits: dict[int, bool] = {}
        self.left, self.right = array("i", range(len(tokens))), array("i", range(len(tokens)))
        self.merge: dict[int, int] = {}
        for i, t in enumerate(tokens):
            if len(t) > 1:
                self.left[i], self.right[i] = self._last_merge(t, i)
                self.merge[self.left[i] << 32 | self.right[i]] = i
        self.fits.clear()

    def _last_merge(self, token: bytes, own: int) -> tuple[int, int]:
        """The two tokens of lower rank that the merges below own leave of a token."""
        for n in range(1, len(token)):
            a, b = self.rank.get(token[:n], own), self.rank.get(token[n:], own)
            if a < own and b < own and self._may_follow(a, b):
                return a, b
        raise ValueError(f"token {own} is not a merge of two tokens of lower rank")

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging by ranks keeps the boundary between a and b.

        The merges inside either token are undone, the latest first (of equal ranks, the left token's was earlier).
        A merge of what then meets at the boundary that ranks below all that was undone would have come before it.
        """
        latest, of_right = len(self.tokens), False
        while True:
            made = self.merge.get(a << 32 | b)
            if made is not None and (made < latest or (made == latest and of_right)):
                return False
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            if whole_a and whole_b:
                return True
            if whole_b or (not whole_a and a > b):
                latest, of_right, a = a, False, self.right[a]
            else:
                latest, of_right, b = b, True, self.left[b]

    def follows(self, a: int, b: int) -> bool:
        """Whether b may come after a."""
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._may_follow(a, b)
        return known

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n, size, shorter, follows = len(piece), self.size, self.shorter, self.follows
        longest = [-1] * (n + 1)
        for end, token in self.find.iter(piece.decode("latin-1")):  # of tokens that begin at a byte the longest ends last
            longest[end + 1 - size[token]] = token
        out, at, dead, token, last = [], 0, bytearray(n + 1), longest[0], -1
        while at < n:
            while token >= 0 and (dead[at + size[token]] or (last >= 0 and not follows(last, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = at + size[token], token
                token = longest[at]
            else:
                dead[at] = 1
                token = out.pop()
                at, last = at - size[token], out[-1] if out else -1
                token = shorter[token]
        return out


def splitter(pattern: str, newer: str):
    """A function that gives a text's matches. newer: letters and digits that count as neither (see newer_letters)."""
    plain = regex.compile(pattern)
    if newer:
        found = regex.compile(f"[{newer}]")
        less = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[NEW]|[^\s\p{L}\p{N}])").replace(r"\p{L}+", r"(?:(?![NEW])\p{L})+").replace(r"\p{N}+", r"(?:(?![NEW])\p{N})+").replace("NEW", newer))

    def split(text: str):
        use = less if newer and not text.isascii() and found.search(text) else plain
        if len(text) <= AT_ONCE:
            yield use.findall(text)
            return
        matches = (m.group() for m in use.finditer(text))
        while part := list(itertools.islice(matches, LAZY)):
            yield part

    return split


def newer_letters() -> str:
    """Code points that the installed regex library, whose Unicode tables may be newer, takes for letters or digits
    and the installed tiktoken library does not: ranges for a character class. Empty where tiktoken is missing."""
    try:
        import tiktoken
    except ImportError:
        return ""
    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    bytes_only = {bytes([b]): b for b in range(256)}
    seen = tiktoken.Encoding("classes", pat_str=r"[\p{L}\p{N}]", mergeable_ranks=bytes_only, special_tokens={})
    theirs = bytes(seen.encode_ordinary(every)).decode()
    new = sorted(map(ord, set(regex.findall(r"[\p{L}\p{N}]", every)) - set(theirs)))
    runs = [[c for _, c in g] for _, g in itertools.groupby(enumerate(new), lambda x: x[1] - x[0])]
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)


class Known(dict):
    """Ids of pieces, worked out where they are missing. Beyond half of PIECES only what is asked for again stays."""

    def __init__(self, words: Vocabulary):
        super().__init__()
        self.words, self.older = words, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.pop(piece, None)
        if ids is None:
            ids = np.array(self.words.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= PIECES // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, tokens: list[bytes], pattern: str, newer: str):
        self.known, self.split = Known(Vocabulary(tokens)), splitter(pattern, newer)

    def encode(self, text: str) -> bytes:
        return b"".join(itertools.chain.from_iterable(map(self.known.__getitem__, pieces) for pieces in self.split(text)))


_WORKER: dict[tuple, object] = {}


def _once(key: tuple, make):
    """What make gives, made once in a Python worker."""
    if key not in _WORKER:
        _WORKER[key] = make()
    return _WORKER[key]


def _given(spark: SparkSession, path: str) -> str:
    """The rank file, sent to every executor; its name there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _added(names: list[str], new: str) -> None:
    if new.lower() in {n.lower() for n in names}:
        raise ValueError(f"a column {new} is there already")


def _mapped(df: DataFrame, key: str, source: str, new: str, kind: str, work) -> DataFrame:
    """df's columns key and source, and a binary column made of source by work(one value) in batches of bounded size."""

    def run(batches):
        one = work()
        for batch in batches:
            keys, values = batch.column(0), batch.column(1)
            lo, made, size = 0, [], 0
            for i in range(batch.num_rows):
                made.append(one(values[i].as_py()))
                size += len(made[-1])
                if len(made) == ROWS or size >= BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([keys.slice(lo, i + 1 - lo), values.slice(lo, i + 1 - lo), pa.array(made, pa.binary())], names=[key, source, new])
                    lo, made, size = i + 1, [], 0

    held = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{source}`").alias(source))
    return held.mapInArrow(run, f"`{key}` {held.schema[0].dataType.simpleString()}, `{source}` {held.schema[1].dataType.simpleString()}, `{new}` {kind}")


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, and `ids`: the whole text's ids as little-endian unsigned 32-bit integers in a binary.

    A null text is empty and has no ids. Letters that match nothing of the pattern have none. Rows that repeat are
    each encoded; other columns are not carried; an empty table gives no rows. Bytes that are no UTF-8 are read as U+FFFD.
    """
    name, newer = _given(docs.sparkSession, ranks), newer_letters()

    def work():
        own = _once((name, pattern, newer), lambda: Encoder(read_ranks(SparkFiles.get(name)), pattern, newer))
        return lambda t: own.encode(t.decode(errors="replace"))

    held = docs.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    return _mapped(held, key, "text", "ids", "binary", work).select(key, "ids")


def decode(encoded: DataFrame, ranks: str, key: str = "doc_id") -> DataFrame:
    """key, ids and `decoded`: the bytes of a binary column ids as encode writes it. A null counts as no ids."""
    name = _given(encoded.sparkSession, ranks)

    def work():
        tokens = _once((name,), lambda: read_ranks(SparkFiles.get(name)))
        return lambda ids: b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    return _mapped(encoded.withColumn("ids", F.coalesce("ids", F.lit(b""))), key, "ids", "decoded", "binary", work)


def ids_array(ids):
    """The ids of a binary column as an array of integers, in Spark's own functions."""
    digits, at = F.hex(ids), F.sequence(F.lit(0), (F.length(ids) / 4).cast("int") - 1)
    byte = lambda i, k: F.substring(digits, i * 8 + 2 * k + 1, F.lit(2))
    one = lambda i: F.conv(F.concat(*(byte(i, k) for k in (3, 2, 1, 0))), 16, 10).cast("long")
    return F.when(F.length(ids) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(at, one))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

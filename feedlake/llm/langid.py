"""Language identification by prediction by partial matching over byte context trees.

For each language a tree of contexts of 0 to ORDER bytes holds symbol counts. A text costs the sum of
its bytes' code lengths: a symbol seen n times in its longest context costs -log2(n / (total + distinct)),
an unseen one pays the escape -log2(distinct / (total + distinct)) and is tried in the next shorter
context; below the empty context every byte costs 8 bits. The counts are frozen before scoring, and the
cheapest language wins. Texts are preceded by line feeds as their first context.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_names, held_out, staged, table, text_chunks, without

#: Longest context in bytes.
ORDER = 3
#: Labelled documents learned from, at most, per language: the first of each of SALTS hash groups.
SAMPLE_DOCS, SALTS = 256, 64
#: Bits a byte at which the best tree saves nothing over raw bytes: the text is in no learned language.
REJECT_BITS = 8.0
NO_LANGUAGE = "und"

_LATIN = re.compile(rb"[A-Za-z]")


def _keys(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """At each byte: it and the three before it in one integer, the newest byte lowest."""
    d = data.astype(np.uint32)
    key = d.copy()
    for k in range(1, ORDER + 1):
        key[k:] |= d[:-k] << np.uint32(8 * k)
    lens = np.diff(offs)
    for j in range(ORDER):
        at = offs[:-1][lens > j] + j
        value = np.zeros(len(at), np.uint32)
        for k in range(ORDER + 1):
            value |= (d[at - k] if k <= j else np.uint32(10)) << np.uint32(8 * k)
        key[at] = value
    return key


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bytes k, gram, n) over the whole texts of docs, summed per task before the shuffle."""

    def count(batches):
        kind = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])
        for rows, data, offs in text_chunks(batches):
            lang = rows.column("lang").to_numpy(zero_copy_only=False)
            key = _keys(data, offs)
            which = np.repeat(np.arange(len(lang)), np.diff(offs))
            for name in sorted(set(lang)):
                own = key[(lang == name)[which]]
                for k in range(1, ORDER + 2):
                    gram, n = np.unique(own & np.uint32((1 << 8 * k) - 1), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], schema=kind)

    return docs.select("lang", "text").mapInArrow(count, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen code lengths of every gram seen in training, for all languages at once."""

    def __init__(self, langs: list[str], grams: dict[int, tuple[np.ndarray, np.ndarray]]):
        """grams: k -> sorted grams of k bytes and their counts, one column per language."""
        self.langs, self.keys, self.cost, self.ctx, self.esc = langs, [], [], [], []
        for k in range(1, ORDER + 2):
            keys, n = grams[k]
            ctx, of = np.unique(keys >> np.uint32(8) if k > 1 else np.zeros(len(keys), np.uint32), return_inverse=True)
            total, distinct = np.zeros((len(ctx), len(langs))), np.zeros((len(ctx), len(langs)))
            np.add.at(total, of, n)
            np.add.at(distinct, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                esc = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                seen = -np.log2(n / (total + distinct)[of])
            shorter = 8.0 if k == 1 else self.cost[-1][np.searchsorted(self.keys[-1], keys & np.uint32((1 << 8 * (k - 1)) - 1))]
            self.keys.append(keys)
            self.cost.append(np.where(n > 0, seen, esc[of] + shorter).astype(np.float32))
            self.ctx.append(ctx)
            self.esc.append(esc.astype(np.float32))
        # A table from hashed gram to row for the longest grams; those that share a slot are searched for.
        bits = max(8, int(np.ceil(np.log2(max(1, len(self.keys[-1])) * 8))))
        self.shift = np.uint32(32 - min(bits, 22))
        self.slots = np.full(1 << int(32 - self.shift), -1, np.int32)
        self.slots[self._slot(self.keys[-1])] = np.arange(len(self.keys[-1]), dtype=np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(2654435761)) >> self.shift

    def _lengths(self, key: np.ndarray, k: int) -> np.ndarray:
        """Code lengths, tried from grams of k bytes down."""
        gram = key & np.uint32((1 << 8 * k) - 1)
        row = np.minimum(np.searchsorted(self.keys[k - 1], gram), len(self.keys[k - 1]) - 1)
        out = self.cost[k - 1][row]
        new = np.flatnonzero(self.keys[k - 1][row] != gram)
        if len(new):
            ctx = gram[new] >> np.uint32(8) if k > 1 else np.zeros(len(new), np.uint32)
            at = np.minimum(np.searchsorted(self.ctx[k - 1], ctx), len(self.ctx[k - 1]) - 1)
            escape = np.where((self.ctx[k - 1][at] == ctx)[:, None], self.esc[k - 1][at], np.float32(0))
            out[new] = escape + (self._lengths(key[new], k - 1) if k > 1 else np.float32(8))
        return out

    def bits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(offs) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(offs))
        if not len(full) or not self.langs:
            return out
        key = _keys(data, offs)
        row = self.slots[self._slot(key)]
        each = self.cost[-1][row]
        new = np.flatnonzero((row < 0) | (self.keys[-1][row] != key))
        if len(new):
            each[new] = self._lengths(key[new], ORDER + 1)
        out[full] = np.add.reduceat(each, offs[:-1][full], axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from whole texts of a bounded sample: at most sample_docs documents of each non-null lang,
    the smallest by a hash of doc_id in each of SALTS groups, so that no language meets in one task."""
    each = max(1, sample_docs // SALTS)
    order = Window.partitionBy("lang", "salt").orderBy("h", "doc_id")
    h = F.xxhash64(F.col("doc_id").cast("string"))
    picked = docs.filter(F.col("lang").isNotNull()).select("doc_id", "lang", h.alias("h"), F.pmod(h, F.lit(SALTS)).alias("salt")).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each).select("doc_id", "lang").distinct()
    picked = staged(picked, "picked")  # so its size is known, and the texts of all others stay where they are
    sample = docs.select("doc_id", "lang", "text").join(picked, ["doc_id", "lang"], "left_semi")
    rows = gram_counts(sample).toPandas()
    langs = sorted(rows["lang"].unique())
    grams = {}
    for k in range(1, ORDER + 2):
        own = rows[rows["k"] == k]
        keys, at = np.unique(own["gram"].to_numpy(np.uint32), return_inverse=True)
        n = np.zeros((len(keys), len(langs)))
        n[at, np.searchsorted(langs, own["lang"].to_numpy(str)) if len(own) else at] = own["n"]
        grams[k] = keys, n
    if not langs or not len(grams[1][0]):
        return Model([], {k: (np.zeros(1, np.uint32), np.zeros((1, 0))) for k in range(1, ORDER + 2)})
    return Model(langs, grams)


NAMES = ["lang_pred", "score", "bits_per_byte"]


def identify(docs: DataFrame, model: Model, new: list[str] = NAMES) -> DataFrame:
    """docs with lang_pred, score (posterior of the winner under equal priors) and bits_per_byte, named as in new.

    Null text, or text without a letter: und, score 0. Without any learned language: und. Ties go to the
    first language in order. Columns of docs that bear these names, in whatever case, are replaced; repeated
    rows stay, very long texts are scored whole.
    """
    kept = without(docs, new)

    def score(batches):
        for rows, data, offs in text_chunks(batches):
            bits = model.bits(data, offs)
            view = data.tobytes()
            known = np.array([bool(_LATIN.search(view, a, b)) or any(map(str.isalpha, view[a:b].decode())) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], bool) & bool(model.langs)
            if model.langs:
                best = bits.argmin(1)
                least = bits[np.arange(len(bits)), best]
                p = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                name = np.array(model.langs, object)[best]
            else:
                least, p, name = np.zeros(len(bits)), np.zeros(len(bits)), np.full(len(bits), NO_LANGUAGE, object)
            name = np.where(known, name, NO_LANGUAGE)
            rate = least / np.maximum(np.diff(offs), 1)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(name, pa.string()), pa.array(np.where(known, p, 0.0)), pa.array(rate)], names=[*rows.schema.names, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(score, f"{fields}, `{new[0]}` string, `{new[1]}` double, `{new[2]}` double")


def learn_from(docs: DataFrame) -> DataFrame:
    """The labelled rows that may be learned from."""
    return docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(learn_from(docs)))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no learned language: no letter at all, or REJECT_BITS a byte and more."""
    lang, score, rate = new = free_names(docs, *NAMES)
    found = identify(docs, train(learn_from(docs)), new)
    return found.filter((F.col(lang) != NO_LANGUAGE) & (F.col(rate) < REJECT_BITS)).drop(*new)

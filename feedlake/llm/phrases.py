"""Phrase collocations by Rabin-Karp fingerprints.

Texts are tokenised once: a chunk of texts of one language becomes a row of word numbers and the chunk's distinct words,
in which a phrase's occurrence is a pointer (chunk, position). Words are counted by their bytes: a task sends a row for each
distinct word that it holds, so that rows grow with the text, whatever is frequent in it. The frequent words then have
numbers, which a task gives to its own by their bytes.

Prefix polynomials over these numbers' hashes give the fingerprint of every n-gram. One length after the other, n-grams are
counted where both n-grams of one word less were frequent by their fingerprints: counts by fingerprint are never too small,
so what is rare by them is rare. From three words on, a sketch of fixed size first counts fingerprints in buckets, and n-grams of
a bucket that holds too few are not sent at all. A task sums the others up by fingerprint and compares the word numbers of those that share one,
and sends on the numbers, so that the shuffle counts the phrases themselves and none has to be read again. Only frequent
phrases are ever spelled out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, MOST_BITS, PARTS, U64, Bits, batch_rows, binaries, inverse_powers, let_go, mix64, powers, staged, table, text_chunks, word_hash

LEAST, LONGEST, TOP = 100, 5, 2000
#: Distinct fingerprints or phrases, and bytes of phrases, that a task sums up before it sends them on. Results are the same.
HELD_PRINTS, HELD_PHRASES, HELD_BYTES = 1 << 20, 1 << 19, 32 << 20
#: Bits of a bucket's number within its part of the sketch.
PART_BITS = 16
#: A chunk's end of a piece of text, among its word numbers; also a word that is not frequent.
STOP = -1

#: What a byte is: 0 of a word, 1 blank, 2 the end of a piece.
KIND = np.zeros(256, np.uint8)
KIND[[32, 9]] = 1
KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2

_CHUNK = "lang string, n_words long, ids binary, words array<binary>"


def _distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Each word's number, and the distinct words, of byte spans. Exact: words are compared as bytes."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    held = data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(held.tobytes())])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.cast(pa.binary())


def chunks(docs: DataFrame) -> DataFrame:
    """docs (lang string, text string) as chunks of one language: numbers of words, with STOP between pieces, and words."""
    kind = pa.schema([("lang", pa.string()), ("n_words", pa.int64()), ("ids", pa.binary()), ("words", pa.list_(pa.binary()))])

    def cut(batches):
        for rows, data, offs in text_chunks(batches):
            data = LOWER[data]
            what = KIND[data]
            solid = what == 0
            edge = np.zeros(len(data) + 1, bool)
            edge[offs] = True
            start = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate(([False], solid[:-1]))))
            end = np.flatnonzero(solid & (edge[1:] | ~np.concatenate((solid[1:], [False])))) + 1
            piece = np.cumsum((what == 2) | edge[:-1])[start]  # a word's piece: ends of pieces and texts up to it
            doc = np.searchsorted(offs, start, "right") - 1
            lang = rows.column(rows.schema.get_field_index("lang")).dictionary_encode()
            of = lang.indices.to_numpy()[doc]
            for k, name in enumerate(lang.dictionary.to_pylist()):
                own = np.flatnonzero(of == k)
                if not len(own):
                    continue
                ids, words = _distinct(data, start[own], end[own])
                at = np.flatnonzero(np.diff(piece[own])) + 1
                made = np.append(np.insert(ids, at, STOP), STOP).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(own)], pa.int64()), pa.array([made.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)], schema=kind)

    return docs.select("lang", "text").mapInArrow(cut, _CHUNK)


class Frequent:
    """Fingerprints that were frequent, as two bit maps, of their low and of their high bits: few others seem so too.

    16 bits of either map for each fingerprint, 2**MOST_BITS (32 MB) at most. They are made in PARTS parts by tasks; those
    parts, of a known size, are all that the driver gets."""

    def __init__(self, keys: DataFrame):
        power = min(MOST_BITS, max(16, (16 * keys.count()).bit_length()))
        self.maps, per = [Bits(power), Bits(power)], (1 << power) // PARTS
        low = lambda h: h.bitwiseAND(F.lit((1 << power) - 1).cast("long"))
        rows = keys.select(F.posexplode(F.array(low(F.col("h")), low(F.shiftrightunsigned("h", 32)))).alias("map", "at"))
        rows = rows.select("map", (F.col("at") / per).cast("int").alias("part"), (F.col("at") % per).cast("int").alias("at")).repartition("map", "part")

        def fill(batches):
            held: dict[tuple, np.ndarray] = {}
            for batch in batches:
                which, part, at = (batch.column(i).to_numpy() for i in range(3))
                for m, p in set(zip(which.tolist(), part.tolist(), strict=True)):
                    own = at[(which == m) & (part == p)]
                    np.bitwise_or.at(held.setdefault((m, p), np.zeros(per // 8, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
            for (m, p), bits in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([p], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["map", "part", "bits"])

        for r in rows.mapInArrow(fill, "map int, part int, bits binary").collect():  # 2 * PARTS rows
            self.maps[r["map"]].bits[r["part"] * (per // 8) : (r["part"] + 1) * (per // 8)] = np.frombuffer(bytes(r["bits"]), np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        return self.maps[0].has(h) & self.maps[1].has((h.astype(U64) >> U64(32)).astype(np.int64))


def _hashes(words: pa.BinaryArray) -> np.ndarray:
    if not len(words):
        return np.zeros(0, U64)
    ends = np.frombuffer(words.buffers()[1], "<i4")[words.offset : words.offset + len(words) + 1].astype(np.int64)
    body = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return word_hash(body, ends[:-1] - ends[0], ends[1:] - ends[0])


class Chunk:
    """A chunk's word numbers and fingerprints. live[n]: the n-gram at a position lies in one piece."""

    def __init__(self, lang: str, ids: pa.Scalar, words: pa.BinaryArray):
        self.lang, self.words = lang, words
        self.ids = np.frombuffer(ids.as_buffer(), "<i4").astype(np.int64)
        self.hash = np.append(_hashes(words), U64(0))[self.ids]
        self.salt = mix64(word_hash(b := np.frombuffer(self.lang.encode(), np.uint8), np.array([0]), np.array([len(b)])))
        self._roll()

    def numbered(self, numbers: np.ndarray) -> Chunk:
        """From now on words are what these numbers say, and those without one (STOP) are in no n-gram."""
        self.ids = np.append(numbers, STOP)[self.ids]
        self.hash = _number_hash(self.ids)
        self.salt = np.zeros(1, U64)
        self._roll()
        return self

    def _roll(self):
        self.prefix = np.zeros(len(self.ids) + 1, U64)
        np.cumsum(self.hash * powers(len(self.ids)), out=self.prefix[1:])
        self.stops = np.concatenate(([0], np.cumsum(self.ids == STOP)))

    def prints(self, n: int):
        """Positions of the n-grams that lie in one piece, and their fingerprints (64 bits, signed, never 0)."""
        at = np.arange(max(0, len(self.ids) - n + 1))
        at = at[self.stops[at + n] == self.stops[at]]
        h = (self.prefix[at + n] - self.prefix[at]) * inverse_powers(len(self.prefix))[at]
        return at, mix64(h + self.salt + U64(n)).astype(np.int64)

    def wanted(self, n: int, frequent: Frequent | None, crowded: Bits | None = None):
        """The n-grams of which both n-grams of one word less may be frequent, in crowded buckets."""
        at, h = self.prints(n)
        if crowded is not None:
            keep = crowded.has(h)
            at, h = at[keep], h[keep]
        if frequent is None or not len(at):
            return at, h
        less, print_of = self.prints(n - 1)
        may = np.zeros(len(self.ids) + 1, bool)
        may[less[frequent.has(print_of)]] = True
        keep = may[at] & may[at + 1]
        return at[keep], h[keep]


def _number_hash(ids: np.ndarray) -> np.ndarray:
    return mix64((ids + 1).astype(U64))


class Vocabulary:
    """The frequent words of all languages, numbered from the most frequent: lang, phrase, n. They go to every task."""

    def __init__(self, words: DataFrame):
        t = words.select("lang", "phrase", "n").toArrow().combine_chunks().sort_by([("n", "descending"), ("lang", "ascending"), ("phrase", "ascending")])
        one = lambda c, kind: pa.concat_arrays([pa.array([], kind), *t.column(c).cast(kind).chunks])
        self.langs, self.words = one("lang", pa.string()).dictionary_encode(), one("phrase", pa.binary())
        h, lang = _hashes(self.words), self.langs.indices.to_numpy()
        order = np.lexsort((h, lang))
        edge = np.searchsorted(lang[order], np.arange(len(self.langs.dictionary) + 1))
        self.of = {name: (h[order[a:b]], order[a:b]) for name, a, b in zip(self.langs.dictionary.to_pylist(), edge[:-1], edge[1:], strict=True)}

    def numbers(self, lang: str, words: pa.BinaryArray) -> np.ndarray:
        """The words' numbers, STOP where they have none. Hashes find them and bytes decide."""
        out = np.full(len(words), STOP, np.int64)
        if lang not in self.of:
            return out
        h, number = self.of[lang]
        own = _hashes(words)
        place = np.searchsorted(h, own)
        left = np.arange(len(words))
        while len(left := left[place[left] < len(h)]) and len(left := left[h[place[left]] == own[left]]):
            found = number[place[left]]
            same = pc.equal(words.take(pa.array(left)), self.words.take(pa.array(found))).to_numpy(zero_copy_only=False)
            out[left[same]] = found[same]
            left = left[~same]
            place[left] += 1
        return out


def opened(batch: pa.RecordBatch):
    """The chunks of a batch of (lang, ids, words)."""
    for i in range(batch.num_rows):
        yield Chunk(batch.column(0)[i].as_py(), batch.column(1)[i], batch.column(2)[i].values)


def _crowded(cut: DataFrame, n: int, vocabulary, frequent, least: int, power: int) -> Bits:
    """The buckets, by low bits of fingerprints, whose n-grams together occur at least so often: what is frequent lies in one.

    A task sends its buckets with their counts, up to least, in parts of 2**PART_BITS buckets; the driver gets a bit of each."""
    kind = np.min_scalar_type(least)

    def sketch(batches):
        held, size = [], 0

        def summed():
            b, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return b, np.minimum(np.bincount(back, np.concatenate([k for _, k in held]), len(b)), least).astype(kind)

        def sent(b, k):
            part = b >> PART_BITS
            edge = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(b)]))
            at = (b & ((1 << PART_BITS) - 1)).astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]], pa.int32()), binaries(at, edge * at.itemsize), binaries(k, edge * k.itemsize)], names=["part", "at", "n"])

        for batch in batches:
            for c in opened(batch):
                h = c.numbered(vocabulary.value.numbers(c.lang, c.words)).wanted(n, frequent.value)[1]
                held.append(np.unique(h & ((1 << power) - 1), return_counts=True))
                size += len(held[-1][0])
                if size >= 2 * HELD_PRINTS:
                    held = [summed()]
                    size = len(held[0][0])
                    if size >= HELD_PRINTS:
                        yield from sent(*held[0])
                        held, size = [], 0
        if size:
            yield from sent(*summed())

    def fill(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, at, k in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                held.setdefault(part, np.zeros(1 << PART_BITS, np.int64))[np.frombuffer(at, "<u2")] += np.frombuffer(k, kind)
        for part, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(counts >= least, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    out, per = Bits(power), (1 << PART_BITS) // 8
    parts = cut.select("lang", "ids", "words").mapInArrow(sketch, "part int, at binary, n binary").repartition("part")
    for r in parts.mapInArrow(fill, "part int, bits binary").collect():  # 2 ** (power - PART_BITS) rows, 32 MB at most
        out.bits[r["part"] * per : (r["part"] + 1) * per] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _keys(ids: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The word numbers of the n-grams at these positions, two in an integer."""
    low = lambda j: ids[at + j] if j < n else 0
    return [ids[at + j] << 32 | low(j + 1) for j in range(0, n, 2)]


def _key_prints(keys: list[np.ndarray], n: int) -> np.ndarray:
    """What Chunk.prints gives for n-grams of these numbers."""
    h = np.zeros(len(keys[0]), U64)
    for j in range(n):
        h += _number_hash(keys[j // 2] >> 32 if j % 2 == 0 else keys[j // 2] & 0xFFFFFFFF) * powers(n)[j]
    return mix64(h + U64(n)).astype(np.int64)


def _summed(h: np.ndarray, keys: list[np.ndarray], weight: np.ndarray):
    """Fingerprints, keys and summed weights of the distinct keys. n-grams that share a fingerprint are told apart."""
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    if any((k != k[first][number]).any() for k in keys):
        _, first, number = np.unique(np.stack(keys, 1), axis=0, return_index=True, return_inverse=True)
        number = number.ravel()
    return h[first], [k[first] for k in keys], np.bincount(number, weight, len(first)).astype(np.int64)


def _key_names(n: int) -> list[str]:
    return [f"k{j}" for j in range((n + 1) // 2)]


def _counted_keys(cut: DataFrame, n: int, vocabulary, frequent, crowded=None) -> DataFrame:
    """n-grams of frequent words, in crowded buckets, as keys with their counts by task: k0 and so on, n. Exact."""
    names = _key_names(n)
    most = HELD_PRINTS // len(names)

    def count(batches):
        held, size = [], 0

        def summed():
            parts = list(zip(*((h, *keys, k) for h, keys, k in held), strict=True))
            h, *keys, k = (np.concatenate(x) for x in parts)
            return _summed(h, keys, k)

        def sent(keys, k):
            for lo in range(0, len(k), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (*keys, k)], names=[*names, "n"])

        for batch in batches:
            for c in opened(batch):
                at, h = c.numbered(vocabulary.value.numbers(c.lang, c.words)).wanted(n, frequent and frequent.value, crowded and crowded.value)
                keys = _keys(c.ids, at, n)
                if len(keys) == 1:  # its own fingerprint
                    h, k = np.unique(keys[0], return_counts=True)
                    held.append((h, [h], k))
                else:
                    held.append(_summed(h, keys, np.ones(len(h))))
                size += len(held[-1][0])
                if size >= 2 * most:
                    held = [summed()]
                    size = len(held[0][0])
                    if size >= most:
                        yield from sent(*held[0][1:])
                        held, size = [], 0
        if size:
            yield from sent(*summed()[1:])

    return cut.select("lang", "ids", "words").mapInArrow(count, ", ".join(f"{x} long" for x in [*names, "n"]))


def _prints_of(keys: DataFrame, n: int) -> DataFrame:
    """h: the keys' fingerprints."""

    def prints(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_key_prints([x.to_numpy() for x in b.columns], n))], names=["h"])

    return keys.select(*_key_names(n)).mapInArrow(prints, "h long")


def _spelled(keys: DataFrame, n: int, vocabulary) -> DataFrame:
    """keys with their counts as lang, words, phrase, n."""

    def spell(batches):
        v = vocabulary.value
        for b in batches:
            ids = [(k >> 32, k & 0xFFFFFFFF) for k in (x.to_numpy() for x in b.columns[:-1])]
            ids = [pa.array(x) for pair in ids for x in pair][:n]
            phrase = pc.binary_join_element_wise(*(v.words.take(x) for x in ids), pa.scalar(b" ", pa.binary()))
            lang = v.langs.take(ids[0]).dictionary_decode()
            yield pa.RecordBatch.from_arrays([lang, pa.array([n] * len(lang), pa.int32()), phrase, b.columns[-1]], names=["lang", "words", "phrase", "n"])

    return keys.select(*_key_names(n), "n").mapInArrow(spell, "lang string, words int, phrase binary, n long")


def _same_phrases(phrases: list[pa.Array], weight: list[np.ndarray]):
    """The distinct ones of these phrases, compared as bytes, and their summed weights."""
    coded = pa.concat_arrays(phrases).dictionary_encode()
    return coded.dictionary, np.bincount(coded.indices.to_numpy(), np.concatenate(weight), len(coded.dictionary)).astype(np.int64)


def _verified(cut: DataFrame, frequent: list) -> DataFrame:
    """lang, phrase, words, n by task: the phrases whose fingerprints may be frequent (None: all), read where their pointers point."""
    kind = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.binary()), ("n", pa.int64())])

    def read(batches):
        let_go()
        held: dict[tuple, tuple[list, list]] = {}

        def summed():
            for key, parts in held.items():
                phrases, weight = _same_phrases(*parts)
                held[key] = [phrases], [weight]
            return large(1)

        def large(times: int):
            parts = [p for phrases, _ in held.values() for p in phrases]
            return sum(map(len, parts)) >= times * HELD_PHRASES or sum(p.nbytes for p in parts) >= times * HELD_BYTES

        def sent():
            for (lang, n), ((phrases,), (weight,)) in held.items():
                for lo in range(0, len(phrases), 1 << 14):
                    part = phrases[lo : lo + (1 << 14)].cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([n] * len(part), pa.int32()), part, pa.array(weight[lo : lo + (1 << 14)])], schema=kind)
            held.clear()

        for batch in batches:
            for c in opened(batch):
                words = c.words.cast(pa.large_binary())
                for n, may in enumerate(frequent, 1):
                    at, h = c.prints(n)
                    if may is not None:
                        at = at[may.value.has(h)]
                    if n == 1:
                        k = np.bincount(c.ids[at], minlength=len(words))
                        phrases, weight = words.filter(pa.array(k > 0)), k[k > 0]
                    else:
                        of = [words.take(pa.array(c.ids[at + j])) for j in range(n)]
                        phrases, weight = _same_phrases([pc.binary_join_element_wise(*of, pa.scalar(b" ", pa.large_binary()))], [np.ones(len(at))])
                    parts = held.setdefault((c.lang, n), ([], []))
                    parts[0].append(phrases)
                    parts[1].append(weight)
                if large(2) and summed():
                    yield from sent()
        summed()
        yield from sent()
        let_go()

    return cut.select("lang", "ids", "words").mapInArrow(read, "lang string, words int, phrase binary, n long")


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """lang, words, phrase, n of all phrases of up to so many words that occur at least so often, by language, and
    lang, n of all words. docs: lang, text."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    cut = staged(chunks(rows), "chunks")
    share = spark.sparkContext.broadcast
    with batch_rows(spark, 4):
        seen = _verified(cut, [None]).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        words = staged(seen.filter(F.col("n") >= least).select("lang", F.lit(1).alias("words"), "phrase", "n"), "words")
    vocabulary, frequent, crowded, found = share(Vocabulary(words)), None, None, words
    n_words = cut.agg(F.sum("n_words")).first()[0] or 0
    power = min(MOST_BITS, max(PART_BITS, (8 * n_words // least).bit_length()))  # a bucket holds an eighth of least or fewer on average, below 2**MOST_BITS of them
    for n in range(2, longest + 1):
        with batch_rows(spark, 4):
            if frequent:
                crowded = share(_crowded(cut, n, vocabulary, frequent, least, power))
            counts = _counted_keys(cut, n, vocabulary, frequent, crowded).groupBy(*_key_names(n)).agg(F.sum("n").alias("n"))
            keys = staged(counts.filter(F.col("n") >= least), "prints")
        found = found.unionByName(_spelled(keys, n, vocabulary))
        if n < longest:
            frequent = share(Frequent(_prints_of(keys, n)))  # 64 MB at most
    found = staged(found.withColumn("phrase", F.col("phrase").cast("string")), "phrases")
    return found, cut.groupBy("lang").agg(F.sum("n_words").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to longest words of each language.

    Texts are lower-cased (A-Z) and split at .,;:!? and line ends into pieces, those at blanks and tabs into words. A
    phrase's score is the least floor(1000 * a * n / (l * r)) over its cuts (ties: the first), where a, l and r count
    the phrase and its parts, and n all words. A phrase that never occurs without a longer one around it goes. A null
    language is `und`, a null or empty text holds no word; rows that repeat count each time; other columns are not
    read; an empty table gives no rows. Order: score, then a, both falling, then the phrase's bytes.
    """
    found, totals = phrase_counts(docs, least, longest)
    count = F.col("a").cast("decimal(18,0)")
    whole = found.withColumnRenamed("n", "a").filter(F.col("words") > 1)
    # A longer phrase around one, and as frequent, has a phrase of one word more between them that is so too.
    parts = F.split("phrase", " ")
    inner = lambda lo: F.array_join(F.slice(parts, F.lit(lo), F.col("words") - 1), " ")
    around = found.filter(F.col("words") > 2).select("lang", F.explode(F.array(inner(1), inner(2))).alias("phrase"), F.col("n").alias("a")).distinct()
    alone = whole.join(around, ["lang", "phrase", "a"], "left_anti")
    k = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = alone.withColumn("k", k)
    cuts = cuts.withColumn("left", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ")).withColumn("right", F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    of = lambda side, name: found.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(totals, "lang")
    d = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("times", (count * d("n")).cast("decimal(38,0)") * F.lit(1000)).withColumn("by", (d("l") * d("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("times div by"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))

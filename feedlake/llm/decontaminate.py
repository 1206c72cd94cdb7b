"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes its words; numbers, names (a capital, then small letters) and units become typed
placeholders, so a question asked again with other numbers or names has the same template. Windows of
WINDOW template words are joined by hash with those of the benchmark. For each alignment of an item with
a text the slots must be consistent: one value of the item stands for one value of the text. Windows with
too few words that are no placeholder, and items too short to have others, are joined by all their words in
small letters instead, and must agree in every one. A text is contaminated by an item of whose windows at
least COVERAGE lie in consistent alignments; one of exact windows alone is always consistent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, staged, table

WINDOW = 8
#: Words in a window that must be no placeholder for a match by template; windows of fewer are matched word for word.
LITERALS = 5
COVERAGE = 0.2
#: Share of an alignment's slot values that must be bound to one value of the text.
CONSISTENT = 0.8
#: Words that an item must have for the pipeline's stage to drop documents by it. The report lists shorter items too, which
#: hold in every text that happens to use their few words.
STAGE_WORDS = 8
#: Bytes of all benchmark windows, words and templates included, up to which they are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20

# Words taken for units.
UNITS = "km kg cm mm ml mg lb lbs oz mph kmh percent dollar dollars euro euros cent cents pound pounds mile miles meter meters metre metres liter liters litre litres gram grams kilogram kilograms kilometer kilometers inch inches foot feet yard yards hour hours minute minutes second seconds day days week weeks month months year years degree degrees ton tons".split()


def words(text: Column) -> Column:
    """Runs of letters and digits; a mark between digits belongs to the number. None in null."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[0-9])[.,](?=[0-9])", "")
    return F.filter(F.split(joined, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def template_word(w: Column) -> Column:
    low = F.lower(w)
    name = (F.length(w) > 1) & (F.substring(w, 1, 1) != F.substring(low, 1, 1)) & (F.substring(w, 2, 1) == F.substring(low, 2, 1))
    return F.when((w >= "0") & (w < ":"), F.lit("#number")).when(low.isin(*UNITS), F.lit("#unit")).when(name, F.lit("#name")).otherwise(low)


def _window(n: int, exact: bool):
    """The window of n words that begins at a position: length, exact, pos, h."""
    hashes = "plain" if exact else "hashes"  # used twice at least, so the optimizer does not copy it into the lambda
    return lambda i: F.struct(F.lit(n).alias("length"), F.lit(exact).alias("exact"), i.alias("pos"), F.xxhash64(*(F.get(hashes, i + k) for k in range(n))).alias("h"))


def _windows(rows: DataFrame, keys: list[str], kinds: list[tuple[int, bool]]) -> DataFrame:
    """rows (keys, hashes, plain) with one row per window of each kind (words, exact): keys, length, exact, pos, h."""
    starts = lambda n: F.when(F.size("plain") >= n, F.sequence(F.lit(0), F.size("plain") - n)).otherwise(F.array().cast("array<int>"))
    # Hashes in a projection of their own: the generator then runs in generated code.
    # The outer form keeps the optimizer from filtering on a copy of the expression; the join drops its nulls.
    every = F.concat(*(F.transform(starts(n), _window(n, exact)) for n, exact in kinds))
    part = rows.withColumn("windows", every).select(*keys, F.explode_outer("windows").alias("w"))
    return part.select(*keys, "w.*")


def _tokens(df: DataFrame, keys: list[Column]) -> DataFrame:
    raw = df.select(*keys, words(F.col("text")).alias("raw"))
    return raw.withColumn("hashes", F.transform("raw", lambda w: F.xxhash64(template_word(w)))).withColumn("plain", F.transform("raw", lambda w: F.xxhash64(F.lower(w))))


def _compared(words_of: str) -> Column:
    """The words by which a window is compared: all in small letters, or its template."""
    return F.when(F.col("exact"), F.transform(words_of, F.lower)).otherwise(F.transform(words_of, template_word))


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[tuple[int, bool]], int]:
    """Windows of all items that have a word, their kinds (length, exact), and their size in memory, about.

    An item of fewer words than window has itself as its one window. Windows of fewer than LITERALS words
    that are no placeholder are exact. item_windows counts all of an item's windows, item_templates the others.
    """
    items = _tokens(bench, [F.col("item_id")]).distinct()
    lengths = [r[0] for r in items.select(F.least(F.size("raw"), F.lit(window)).alias("n")).filter(F.col("n") > 0).distinct().collect()]
    if not lengths:
        return None, [], 0
    w = None
    for n in sorted(lengths):  # window at most different values
        own = items.filter(F.size("raw") >= n if n == window else F.size("raw") == n)
        part = _windows(own, ["item_id", "raw"], [(n, False), (n, True)])
        w = part if w is None else w.unionByName(part)
    slots = lambda c: F.slice(c, F.col("pos") + 1, F.col("length"))
    literals = F.size(F.filter(F.transform(slots("raw"), template_word), lambda x: ~x.startswith("#")))
    w = w.filter((literals < LITERALS) == F.col("exact"))
    w = w.select("item_id", "length", "exact", "h", F.col("pos").alias("item_pos"), slots("raw").alias("item_raw"))
    w = w.withColumn("template", _compared("item_raw"))
    n_windows = w.groupBy("item_id").agg(F.count("*").alias("item_windows"), F.count_if(~F.col("exact")).alias("item_templates"))
    w = staged(w.join(n_windows, "item_id"), "benchmark")
    return w, sorted((r[0], r[1]) for r in w.select("length", "exact").distinct().collect()), w.agg(F.sum(F.lit(200) + sum((F.octet_length(F.array_join(c, "")) + 16 * F.size(c) for c in ("template", "item_raw")), F.lit(0)))).first()[0]


FOUND = "doc_id long, text_hash long, item_id long, windows long, item_windows long, coverage double, slots long, consistent_slots long"


def contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, consistent: float = CONSISTENT) -> DataFrame:
    """One row per document and item found in it: FOUND. text_hash tells documents of one doc_id apart.

    Null or empty texts hold nothing; repeated rows of either table count once; other columns are not
    read, so they may bear any name; very long texts are searched whole. An empty benchmark or an empty table gives
    no rows. Ties: an item found equally well in several places of a text is one row. Coverage is the share of an item's windows that are found, or of its
    windows matched by template alone where that is larger; windows and item_windows are the two numbers of it.
    """
    w, kinds, n = benchmark_windows(bench, window)
    if not n:
        return docs.sparkSession.createDataFrame([], FOUND)
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")]
    # Windows are joined as slim rows; only the texts of hits are split into words again, for the words of each hit.
    found = _windows(_tokens(docs, key), ["doc_id", "text_hash"], kinds).join(F.broadcast(w) if n <= BROADCAST_BYTES else w, ["h", "length", "exact"])
    found = staged(found.select("doc_id", "text_hash", "item_id", "item_windows", "item_templates", "exact", "length", "item_pos", "pos", "template", "item_raw"), "windows")
    # Written, so that Spark knows their size: where they are few they are broadcast, and other texts stay where they are.
    asked = staged(found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct(), "asked")
    texts = docs.select(*key, "text").join(asked, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left_semi")
    texts = texts.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), words(F.col("text")).alias("raw"))
    hits = found.join(texts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")))
    hits = staged(hits.select(*found.columns, (F.col("pos") - F.col("item_pos")).alias("shift"), F.slice("raw", F.col("pos") + 1, F.col("length")).alias("doc_raw")), "hits")
    # The joined templates are compared, so a shared hash alone is no match.
    hits = hits.filter(_compared("doc_raw") == F.col("template"))
    slots = F.filter(F.arrays_zip("template", "item_raw", "doc_raw"), lambda s: s["template"].startswith("#"))
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k"), "text_hash", "item_id"]
    names = ["k", "text_hash", "item_id"]
    bound = hits.filter("not exact").select(*key, "shift", F.explode(slots).alias("s")).select(*names, "shift", "s.template", F.lower("s.item_raw").alias("item_value"), F.lower("s.doc_raw").alias("doc_value"))
    # One value of the text for a value of the item; the other way round two names may share a substitute.
    bound = bound.groupBy(*names, "shift", "template", "item_value").agg((F.min("doc_value") == F.max("doc_value")).cast("long").alias("one"))
    bound = bound.groupBy(*names, "shift").agg(F.count("*").alias("slots"), F.sum("one").alias("consistent_slots"))
    seen = hits.select("doc_id", *key, "item_windows", "item_templates", "exact", "item_pos", "shift").distinct()
    good = seen.join(bound, [*names, "shift"], "left").fillna(0, ["slots", "consistent_slots"]).filter(F.col("consistent_slots") >= F.lit(consistent) * F.col("slots"))
    once = [F.first(c).alias(c) for c in ("doc_id", "item_windows", "item_templates")]
    most = [F.max(c).alias(c) for c in ("slots", "consistent_slots")]
    found = good.groupBy(*names, "item_pos", "exact").agg(*once, *most)
    found = found.groupBy(*names).agg(*once, *most, F.count("*").alias("windows"), F.count_if(~F.col("exact")).alias("templates"))
    alone = (F.col("item_templates") > 0) & (F.col("templates") * F.col("item_windows") > F.col("windows") * F.col("item_templates"))
    found = found.withColumn("windows", F.when(alone, F.col("templates")).otherwise(F.col("windows"))).withColumn("item_windows", F.when(alone, F.col("item_templates")).otherwise(F.col("item_windows")))
    found = found.withColumn("coverage", F.col("windows") / F.col("item_windows")).filter(F.col("coverage") >= coverage)
    return found.select("doc_id", "text_hash", "item_id", "windows", "item_windows", "coverage", "slots", "consistent_slots")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which an item of STAGE_WORDS words or more is found."""
    i, h = free_names(docs, "id", "hash")
    bench = table(spark, sf_dir, "benchmark").filter(F.size(words(F.col("text"))) >= STAGE_WORDS)
    found = staged(contaminated(docs, bench).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct(), "found")
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found[i]) & (F.xxhash64(docs["text"]) == found[h]), "left_anti")

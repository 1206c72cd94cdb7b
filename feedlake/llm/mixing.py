"""Mixing sources to target weights.

A source's share p of all tokens becomes the weight p**a / sum(p**a). The exponent a is found by
bisection: the largest a in [0, 1] whose weights have at least the target entropy, and, where a
repetition limit is set, under which no source is passed over more often than the limit; a budget in
tokens then gives each source its number of whole passes and a rest. Every pass deals the source's
blocks in an order of its own, and the documents in each block likewise; the rest is the beginning of
one more such pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Least entropy of the weights, as a part of that of equal weights.
ENTROPY = 0.95
#: Most passes over one source.
PASSES = 4.0
#: Tokens of a block, about.
BLOCK_TOKENS = 1 << 16
#: Exponents tried at once in a job, and jobs: 31 midpoints are five steps of bisection.
WAYS, ROUNDS = 32, 6


def n_tokens(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, entropy: float = ENTROPY, passes: float = PASSES, budget: float | None = None) -> tuple[float, float]:
    """(a, sum of tokens**a) by bisection; sources: one row per source with its tokens, all above 0.

    Lower exponents are flatter: entropy rises and so do the passes over the smallest source. The
    entropy asks for a <= some value, the limit for a >= some value; where both can't be met the limit
    wins. A limit that even a = 1 exceeds (budget / all tokens) can't be met by any weights: the entropy alone
    then sets a. budget: tokens to deal; None: as many as show each source whole once.
    """
    n, total = sources.agg(F.count("*"), F.sum("tokens")).first()
    if not n:
        return 1.0, 1.0
    share = F.col("tokens") / F.lit(float(total))

    def measures(tried: list[float]) -> list[tuple[float, float]]:
        """(entropy, most passes) at each exponent, all in one aggregation."""
        z = [F.sum(F.pow(share, F.lit(a))) for a in tried]
        s = [F.sum(F.pow(share, F.lit(a)) * F.log(share)) for a in tried]
        row = sources.agg(F.min(share), F.max(share), *z, *s).first()
        low, high, zs, ss = row[0], row[1], row[2 : 2 + len(tried)], row[2 + len(tried) :]
        out = []
        for a, zz, t in zip(tried, zs, ss, strict=True):
            ends = low ** (a - 1), high ** (a - 1)  # passes over the smallest and the largest source, to scale
            scale = budget / total / zz if budget else 1 / min(ends)
            out.append((math.log(zz) - a / zz * t, max(ends) * scale))
        return out

    def last_true(good, rising: bool) -> float:
        """Bisects [0, 1] for the end of the exponents for which good holds: from 0 up, or from 1 down."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            mids = [lo + (hi - lo) * i / WAYS for i in range(1, WAYS)]
            ok = [good(m) for m in measures(mids)]
            k = sum(1 for _ in iter_while(ok)) if rising else len(ok) - sum(1 for _ in iter_while(ok[::-1]))
            edge = [lo, *mids, hi]
            lo, hi = edge[k], edge[k + 1]
        return lo if rising else hi

    ends = measures([0.0, 1.0])
    want, a = entropy * math.log(n), 1.0
    if ends[1][0] < want:
        a = last_true(lambda m: m[0] >= want, True)
    if measures([a])[0][1] > passes and ends[1][1] <= passes:
        a = max(a, last_true(lambda m: m[1] <= passes, False))
    return a, sources.agg(F.sum(F.pow(share, F.lit(a)))).first()[0]


def iter_while(ok: list[bool]):
    for x in ok:
        if not x:
            return
        yield x


def plan(docs: DataFrame, entropy: float = ENTROPY, passes: float = PASSES, budget: float | None = None) -> DataFrame:
    """One row per source: source, tokens, weight, budget_tokens. docs: source, tokens.

    Sources without a token get weight 0. A null source is a source of its own.
    """
    sources = staged(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    live = sources.filter("tokens > 0")
    a, z = exponent(live, entropy, passes, budget)
    total = float(live.agg(F.sum("tokens")).first()[0] or 0)
    share = F.col("tokens") / F.lit(total or 1.0)
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(a)) / F.lit(z)).otherwise(F.lit(0.0))
    if budget is None:
        top = live.agg(F.max(F.pow(share, F.lit(1 - a)))).first()[0] or 0.0  # largest tokens / weight, over total / z
        budget = total * z * top
    return sources.select("source", F.col("tokens").alias("source_tokens"), weight.alias("weight"), F.greatest(F.round(weight * F.lit(budget)), F.lit(0)).cast("long").alias("budget_tokens"))


def _key() -> Column:
    """A source's name as a key that null can't break."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def _ordered(rows: DataFrame) -> DataFrame:
    """rows with block, turn (place of the block) and row_turn (place in it) of the last, partial pass."""
    h = F.xxhash64(F.col("doc_id").cast("string"), F.col("text_hash"))
    rows = rows.withColumn("block", F.pmod(h, F.col("n_blocks")))
    return rows.withColumn("turn", F.xxhash64("block", "whole", F.lit("block"))).withColumn("row_turn", F.xxhash64(h, "whole"))


def cutoffs(slim: DataFrame, entropy: float = ENTROPY, passes: float = PASSES, budget: float | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per source: its weight, whole passes, blocks, and where its last pass ends (cut_turn, cut_row).

    The end is found from sums of tokens per block, then inside the one block that holds it, so no task
    holds a source.
    """
    p = plan(slim, entropy, passes, budget).withColumn("skey", _key()).drop("source")
    live = F.greatest(F.col("source_tokens"), F.lit(1))
    some = F.col("source_tokens") > 0
    p = p.withColumn("whole", F.when(some, F.floor(F.col("budget_tokens") / live)).otherwise(F.lit(1)).cast("long"))
    p = p.withColumn("rest", F.when(some, F.col("budget_tokens") - F.col("whole") * live).otherwise(F.lit(0)))
    p = staged(p.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_tokens") / F.lit(block_tokens))).cast("long")), "plan")
    rows = _ordered(slim.withColumn("skey", _key()).join(p.select("skey", "whole", "n_blocks"), "skey"))
    blocks = rows.groupBy("skey", "turn").agg(F.sum("tokens").alias("n"))
    # Tokens before a block: sums over groups of blocks (by leading bits of the turn), then inside a group.
    blocks = staged(blocks.withColumn("group", F.shiftright("turn", 52)), "blocks")
    ahead = Window.partitionBy("skey").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = blocks.groupBy("skey", "group").agg(F.sum("n").alias("all")).select("skey", "group", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("groups_before"))
    inside = Window.partitionBy("skey", "group").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("groups_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    ends = blocks.join(groups, ["skey", "group"]).withColumn("before", before).join(p.select("skey", "rest"), "skey")
    ends = ends.filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("n")))
    ends = ends.select("skey", "turn", "before", "rest")
    within = Window.partitionBy("skey").orderBy("row_turn").rangeBetween(Window.unboundedPreceding, -1)
    last = rows.select("skey", "turn", "row_turn", "tokens").join(ends, ["skey", "turn"])
    last = last.withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    cut = last.filter(F.col("at") < F.col("rest")).groupBy("skey").agg(F.first("turn").alias("cut_turn"), F.max("row_turn").alias("cut_row"))
    # Written, so that its size is known: rows meet it where they are, or by key where the sources are too many.
    return staged(p.join(cut, "skey", "left").select("skey", "weight", "whole", "n_blocks", "cut_turn", "cut_row"), "cuts")


def schedule(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows with weight, block and copies: how often each is dealt.

    A row is dealt once in each whole pass and once more if it lies before the end of the last one. Rows
    alike in doc_id and text are dealt alike. Rows without a token are dealt like others; a source
    without any token is passed over once. An empty table gives an empty schedule.
    """
    out = _ordered(rows.withColumn("skey", _key()).join(cuts, "skey"))
    more = (F.col("turn") < F.col("cut_turn")) | ((F.col("turn") == F.col("cut_turn")) & (F.col("row_turn") <= F.col("cut_row")))
    out = out.withColumn("copies", F.col("whole") + F.coalesce(more, F.lit(False)).cast("long"))
    return out.drop("skey", "whole", "n_blocks", "turn", "row_turn", "cut_turn", "cut_row")


def deal(planned: DataFrame) -> DataFrame:
    """The schedule's rows, one per dealing, with pass_no and the place of block and row in that pass."""
    each = planned.filter("copies > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    h = F.xxhash64(F.col("doc_id").cast("string"), F.col("text_hash"))
    return each.withColumn("block_order", F.xxhash64("block", "pass_no", F.lit("block"))).withColumn("row_order", F.xxhash64(h, "pass_no"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, tokens and a hash of the text, of every row."""
    return docs.select("doc_id", "source", n_tokens(F.col("text")).alias("tokens"), F.xxhash64("text").alias("text_hash"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per dealing of a document: doc_id, source, tokens, weight, pass_no, block, block_order, row_order."""
    slim = staged(measured(table(spark, sf_dir, "documents")), "measured")
    return deal(schedule(slim, cutoffs(slim))).select("doc_id", "source", "tokens", "weight", "pass_no", "block", "block_order", "row_order")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for, at least once whole."""
    cuts = cutoffs(staged(measured(docs), "measured"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    row = docs.select(F.struct(*own).alias("row"), "doc_id", "source", F.xxhash64("text").alias("text_hash"))
    got = schedule(row, cuts).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("copies"), F.lit(1)))))
    return got.select("row.*")

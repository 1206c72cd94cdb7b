"""Constraints as set checks, and cascading deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import LENGTHS, PRIMARY_KEYS, REFERENCES, UNIQUE


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with n; a key with a null part is exempt, as in SQL."""
    there = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return rows.filter(there).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is set and missing in parent."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def null_report(rows: DataFrame, required: list[str], limits: dict[str, int]) -> DataFrame:
    """One row per check: check, column, n of the rows that break it; all in one pass."""
    sums = [F.sum(F.col(c).isNull().cast("long")).alias(f"null:{c}") for c in required] + [F.sum((F.length(c) > n).cast("long")).alias(f"length:{c}") for c, n in limits.items()]
    wide = rows.agg(*sums)
    pairs = F.array(*(F.struct(F.lit(n.split(":")[0]).alias("check"), F.lit(n.split(":")[1]).alias("column_name"), F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias("n")) for n in wide.columns))
    return wide.select(F.inline(pairs))


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Every constraint of the library's schemas over tables: table_name, check, column_name, n of what breaks it.
    key and unique count keys that repeat (columns joined by a comma), reference counts rows without their parent."""
    found = []
    told = lambda rows, *names: rows.select(*(F.lit(v).alias(c) for v, c in zip(names, ("table_name", "check", "column_name"))), "n")
    for name, rows in tables.items():
        for check, keys in (("key", PRIMARY_KEYS[name]), ("unique", UNIQUE.get(name))):
            if keys:
                found.append(told(duplicates(rows, keys).agg(F.count("*").alias("n")), name, check, ",".join(keys)))
        for column, parent in REFERENCES.get(name, []):
            if parent in tables:
                lost = orphans(rows, column, tables[parent], PRIMARY_KEYS[parent][0])
                found.append(told(lost.agg(F.count("*").alias("n")), name, "reference", column))
        report = null_report(rows, PRIMARY_KEYS[name], LENGTHS.get(name, {}))
        found.append(report.select(F.lit(name).alias("table_name"), "check", "column_name", "n"))
    return reduce(DataFrame.unionByName, found)


def admitted(new: DataFrame, name: str, stored: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) rows of a batch for the table name, judged before they are appended.

    rejected has check and column_name, the first that a row breaks: null (a part of the primary key), length, reference
    (set, and missing in the stored parent), key, unique (both stored, or repeated in the batch, where the smallest row that
    breaks nothing else stays; a key with a null part is exempt). Of the stored tables only the columns of keys are read, and
    only the batch's own keys go on from there.
    """
    limits, columns = LENGTHS.get(name, {}), new.columns
    why = lambda check, column: F.struct(F.lit(check).alias("check"), F.lit(column).alias("column_name"))
    plain = [F.when(F.col(c).isNull(), why("null", c)) for c in PRIMARY_KEYS[name]] + [F.when(F.length(c) > n, why("length", c)) for c, n in limits.items() if c in columns]
    rows = new.withColumn("_why", F.coalesce(*plain))
    for column, parent in REFERENCES.get(name, []):
        asked = rows.select(column).dropna().distinct()
        there = asked.join(stored[parent].select(F.col(PRIMARY_KEYS[parent][0]).alias(column)), column, "left_semi").withColumn("_there", F.lit(True))
        rows = rows.join(there, column, "left").withColumn("_why", F.coalesce("_why", F.when(F.col(column).isNotNull() & F.col("_there").isNull(), why("reference", column)))).drop("_there")
    for check, keys in (("key", PRIMARY_KEYS[name]), ("unique", UNIQUE.get(name))):
        if keys:
            asked = rows.select(*keys).dropna().distinct()
            held = asked.join(stored[name].select(*keys), keys, "left_semi").withColumn("_held", F.lit(True))
            whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
            spread = F.when(~whole, F.xxhash64(*columns))  # exempt rows need no order, nor to be together
            place = F.row_number().over(Window.partitionBy(*keys, spread).orderBy(F.col("_why").isNotNull(), F.struct(*columns)))
            again = whole & (F.col("_held").isNotNull() | (F.col("_place") > 1))
            rows = rows.join(held, keys, "left").withColumn("_place", place)
            rows = rows.withColumn("_why", F.coalesce("_why", F.when(again, why(check, ",".join(keys))))).drop("_held", "_place")
    return rows.filter("_why is null").select(*columns), rows.filter("_why is not null").select(*columns, "_why.*")


def survivors(tables: dict[str, DataFrame], references: dict[str, list[tuple[str, str]]], keys: dict[str, str], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tables after a cascading delete. gone: table -> deleted keys. Victims are pushed down level by level;
    a row goes by its own references, so that a repeated key takes no other row of its table along."""
    left, dead = {}, dict(gone)
    parents = {p for refs in references.values() for _, p in refs}
    for name in _parents_first(tables, references):
        stored = rows = tables[name]
        for column, parent in references.get(name, []):
            if parent in dead:
                victims = dead[parent].select(F.col(keys[parent]).alias(column))
                rows = rows.join(victims, column, "left_anti")
                if name in parents:
                    lost = stored.join(victims, column, "left_semi").select(keys[name])
                    dead[name] = dead[name].unionByName(lost) if name in dead else lost
        left[name] = rows.join(gone[name].select(keys[name]), keys[name], "left_anti") if name in gone else rows
    return left


def _parents_first(tables, references) -> list[str]:
    order: list[str] = []
    while len(order) < len(tables):
        more = [t for t in tables if t not in order and all(p in order or p not in tables for _, p in references.get(t, []))]
        if not more:
            raise ValueError(f"references form a cycle among {sorted(set(tables) - set(order))}")
        order += more
    return order

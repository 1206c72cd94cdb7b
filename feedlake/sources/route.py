"""Payloads of both kinds, and the response side of conditional fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import first_truthy, trim_ws
from . import jsonfeed, xmlfeed


def kind_of(content: Column) -> Column:
    """'json' where the stripped payload starts with a brace, else 'xml' (a bracket too). content: text, or bytes of ASCII's kind."""
    return F.when(trim_ws(content.cast("string")).startswith("{"), "json").otherwise("xml")


def parse_items(payloads: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """Episodes of all payloads of either kind: key, pos and the episode columns.

    known: (key, guid) of stored items, which are dropped before dates and durations are parsed.
    """
    routed = payloads.withColumn("_kind", kind_of(F.col("content")))
    out = None
    for kind, source in (("xml", xmlfeed), ("json", jsonfeed)):
        rows = source.identified(source.items(source.parse(routed.filter(F.col("_kind") == kind)), key))
        if known is not None:
            rows = rows.join(known.select(key, "guid"), [key, "guid"], "left_anti")
        rows = source.episodes(rows, key, "pos")
        out = rows if out is None else out.unionByName(rows)
    return out


def parse_metadata(payloads: DataFrame, *keep: str) -> DataFrame:
    """Feed rows of all payloads of either kind."""
    routed = payloads.withColumn("_kind", kind_of(F.col("content")))
    return xmlfeed.metadata(xmlfeed.parse(routed.filter("_kind = 'xml'")), *keep).unionByName(jsonfeed.metadata(jsonfeed.parse(routed.filter("_kind = 'json'")), *keep))


def fetch_gate(log: DataFrame) -> DataFrame:
    """log (status, etag, last_modified, and the stored old_etag, old_last_modified) with outcome.

    304: not modified; 2xx: modified; all else: rejected. Validators fall back to the stored ones.
    """
    outcome = F.when(F.col("status") == 304, "not_modified").when(F.col("status").between(200, 299), "modified").otherwise("rejected")
    return log.withColumn("outcome", outcome).withColumn("etag", first_truthy(F.col("etag"), F.col("old_etag"))).withColumn("last_modified", first_truthy(F.col("last_modified"), F.col("old_last_modified")))


def request_headers(etag: Column, last_modified: Column) -> Column:
    """The conditional headers as a map; empty validators give none."""
    pairs = F.array(F.struct(F.lit("If-None-Match").alias("key"), etag.alias("value")), F.struct(F.lit("If-Modified-Since").alias("key"), last_modified.alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] != ""))

"""Feed payloads made from the given tables, so that every scan has a plain table to be compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents in one JSON payload, and orders in one XML payload, about: a hot source becomes many payloads, not one.
PAGE, XML_PAGE = 50, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def escaped(c: Column) -> Column:
    c = c.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def tag(name: str, *body: Column, attrs: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attrs}>"), *body, F.lit(f"</{name}>"))


def total_seconds() -> Column:
    return F.floor("o_totalprice").cast("int")


def clock_text(seconds: Column) -> Column:
    return F.format_string("%d:%02d:%02d", (seconds / 3600).cast("int"), (seconds % 3600 / 60).cast("int"), seconds % 60)


def mail_date(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss")


def enclosure_shape(key: Column) -> Column:
    """Five ways to name the audio, by key % 5."""
    url = lambda end: F.concat(F.lit("https://a.example/"), key.cast("string"), F.lit(end))
    return (
        F.when(key % 5 == 0, F.concat(F.lit('<enclosure url="'), url(".mp3"), F.lit('" type="audio/mpeg"/>')))
        .when(key % 5 == 1, F.concat(F.lit('<enclosure url="x.pdf" type="application/pdf"/><enclosure url="'), url(".M4A"), F.lit('" type="application/octet-stream"/>')))
        .when(key % 5 == 2, F.concat(F.lit('<enclosure url="'), url(".mp3?x=1"), F.lit('"/>')))
        .when(key % 5 == 3, F.concat(F.lit('<media:content url="'), url(".opus"), F.lit('"/><media:content url="'), url(".ogg"), F.lit('"/>')))
        .otherwise(F.concat(F.lit('<atom:link rel="self" href="s"/><atom:link rel="enclosure" type="audio/aac" href="'), url(""), F.lit('"/>')))
    )


def xml_payloads(orders: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """(feed_id, content): RSS payloads of the customers that have orders, items in order of key; of XML_PAGE orders and
    more a customer has several payloads."""
    key = F.col("o_orderkey")
    item = tag("item", tag("title", F.lit("Order "), escaped(key)), tag("guid", escaped(key), attrs=' isPermaLink="false"'), tag("pubDate", mail_date(F.col("o_orderdate")), F.lit(" GMT")), tag("itunes:duration", clock_text(total_seconds())), tag("description", escaped(F.col("o_orderpriority"))), enclosure_shape(key))
    pages = orders.groupBy("o_custkey").agg(F.ceil(F.count("*") / F.lit(XML_PAGE)).alias("pages"))
    feeds = orders.join(pages, "o_custkey").groupBy(F.col("o_custkey").alias("feed_id"), (key % F.col("pages")).alias("page")).agg(F.sort_array(F.collect_list(F.struct(key.alias("k"), item.alias("xml")))).alias("items"))
    head = F.lit("<title>feed</title>")
    if customers is not None:
        feeds = feeds.join(customers.select(F.col("c_custkey").alias("feed_id"), "c_name", "c_mktsegment"), "feed_id")
        k = F.col("feed_id")
        odd = lambda c: F.when(k % 2 == 1, c).otherwise(F.lit(""))
        head = F.concat(
            tag("title", F.lit(" "), escaped(F.col("c_name")), F.lit("\n")),
            odd(tag("author", escaped(F.col("c_name")))),
            tag("itunes:author", F.lit("A &amp; B")),
            F.when(k % 3 == 0, F.lit("")).otherwise(tag("description", F.lit("D"), k.cast("string"))),
            tag("itunes:summary", F.lit("S"), k.cast("string")),
            tag("link", F.lit("https://f.example/"), k.cast("string")),
            odd(F.concat(F.lit("<image><url>https://i.example/"), k.cast("string"), F.lit("</url></image>"))),
            F.lit('<itunes:image href="https://j.example/x"/>'),
            F.when(k % 4 == 0, F.lit("")).otherwise(tag("category", escaped(F.col("c_mktsegment")))),
            F.lit('<itunes:category text="Arts"/>'),
        )
    body = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel>'), head, F.array_join(F.transform("items", lambda x: x["xml"]), ""), F.lit("</channel></rss>"))
    return feeds.select("feed_id", body.alias("content"))


def json_payloads(docs: DataFrame) -> DataFrame:
    """(feed, page, content): JSON Feed payloads of a source's documents, PAGE at most in each."""
    item = F.struct(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit(" T"), F.col("doc_id"), F.lit(" "))).alias("title"), F.col("text").alias("content_text"), F.when(F.col("doc_id") % 4 != 1, F.concat(F.lit("https://p.example/"), F.col("doc_id"))).alias("url"), F.when(F.col("doc_id") % 4 == 2, F.concat(F.lit("https://p.example/"), F.col("doc_id"), F.lit(".mp3"))).alias("audio_url"))
    pages = docs.groupBy(F.col("source").alias("feed"), F.floor(F.col("doc_id") / (PAGE * 20)).alias("page")).agg(F.sort_array(F.collect_list(F.struct(F.col("doc_id").alias("k"), item.alias("item")))).alias("rows"))
    names = F.when(F.col("page") % 2 == 0, F.col("feed"))
    feed = F.struct(F.concat(F.lit(" "), F.col("feed"), F.lit(" ")).alias("title"), F.struct(names.alias("name")).alias("author"), F.when(F.col("page") % 3 != 0, F.lit("d")).alias("description"), F.when(F.col("page") % 2 == 0, F.lit("")).otherwise(F.lit("h")).alias("home_page_url"), F.lit("u").alias("feed_url"), F.lit("f").alias("favicon"), F.transform("rows", lambda r: r["item"]).alias("items"))
    return pages.select("feed", "page", F.to_json(feed).alias("content"))


def attachment_items(docs: DataFrame) -> DataFrame:
    """(doc_id, content): one small JSON Feed per document, in five shapes by doc_id % 5."""
    k = F.col("doc_id").cast("string")
    shape = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('"attachments":[{"url":"a'), k, F.lit('.mp3","mime_type":"audio/mpeg","duration_in_seconds":'), k, F.lit("}]")))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit('"audio_url":"o'), k, F.lit('","duration":"1:30","attachments":[{"url":"v.mp4","mime_type":"video/mp4"}]')))
        .when(F.col("doc_id") % 5 == 2, F.lit('"duration":2.5,"attachments":[{"mime_type":"audio/ogg"},{"url":"v.mp4","mime_type":"video/mp4"}]'))
        .when(F.col("doc_id") % 5 == 3, F.concat(F.lit('"audio_url":"o'), k, F.lit('","duration":7,"attachments":[{"url":"g.ogg","mime_type":"audio/ogg","duration_in_seconds":null}]')))
        .otherwise(F.lit('"duration":"bad"'))
    )
    return docs.select("doc_id", F.concat(F.lit('{"title":"t","items":[{"id":'), k, F.lit(","), shape, F.lit("}]}")).alias("content"))

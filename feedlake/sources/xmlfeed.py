"""XML feeds (RSS 2.0, RSS 1.0, Atom, iTunes and Media RSS) from a payload column.

The payload is parsed once with a schema that holds all roots; all else are projections of the struct.
Prefixed names stay as they are written. Elements that may repeat are arrays, of which the first counts.
A broken payload gives a null struct and goes to the rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import bound, date_text, date_value, decode_payload, duration_seconds, first_truthy, held, trim_ws

_LINK = "array<struct<_rel:string,_href:string,_url:string,_type:string,_VALUE:string>>"
_ITEM = f"""struct<guid:array<string>,id:array<string>,title:array<string>,link:array<string>,description:array<string>,
`itunes:summary`:array<string>,`itunes:subtitle`:array<string>,pubDate:array<string>,published:array<string>,updated:array<string>,
`itunes:duration`:array<string>,duration:array<string>,enclosure:array<struct<_url:string,_href:string,_type:string>>,
`media:content`:array<struct<_url:string,_href:string,_type:string>>,`atom:link`:{_LINK},`dc:date`:array<string>,`_rdf:about`:string>"""
_ENTRY = f"struct<id:array<string>,title:array<string>,summary:array<string>,content:array<string>,published:array<string>,updated:array<string>,link:{_LINK},`itunes:duration`:array<string>>"
SCHEMA = f"""channel struct<title:array<string>,link:array<string>,description:array<string>,`itunes:summary`:array<string>,`itunes:subtitle`:array<string>,
author:array<string>,`itunes:author`:array<string>,`dc:publisher`:array<string>,`dc:creator`:array<string>,category:array<string>,`itunes:category`:array<struct<_text:string>>,
image:array<struct<url:string>>,`itunes:image`:array<struct<_href:string>>,item:array<{_ITEM}>>,
item array<{_ITEM}>, image array<struct<url:string>>, title array<string>, subtitle array<string>, id array<string>, logo array<string>, author array<struct<name:string>>, link {_LINK}, category array<struct<_term:string>>, entry array<{_ENTRY}>"""

#: Endings that make a URL audio, in enclosures and in media content.
ENCLOSURE_ENDS = ["mp3", "m4a", "aac", "ogg", "wav", "opus"]
MEDIA_ENDS = ["mp3", "m4a", "aac", "ogg", "wav"]


#: Namespaces whose elements are read, and the prefixes that the schema has for them.
PREFIXES = {"http://www.itunes.com/dtds/podcast-1.0.dtd": "itunes", "http://search.yahoo.com/mrss/": "media", "http://purl.org/dc/elements/1.1/": "dc", "http://www.w3.org/2005/Atom": "atom"}
#: Namespaces of roots, whose elements the schema has without a prefix where the root bears one, or always.
ATOM, RSS_1 = "http://www.w3.org/2005/Atom", "http://purl.org/rss/1.0/"


def _prefix(xml: Column, space: str) -> Column:
    """The prefix that a payload binds a namespace to; empty if none."""
    return F.when(F.contains(xml, F.lit(space)), F.regexp_extract(xml, rf"""xmlns:([A-Za-z_][A-Za-z0-9_.-]*)\s*=\s*["']{space}["']""", 1)).otherwise("")


def usual_prefixes(xml: Column) -> Column:
    """xml with PREFIXES where a payload binds their namespaces to prefixes of its own, and without the prefix of an
    Atom root or of RSS 1.0 elements."""
    renamed = lambda x, old, new: F.regexp_replace(x, F.concat(F.lit("(</?)"), old, F.lit(":")), F.lit("$1" + new))

    def of_roots(x):
        atom, rss = _prefix(x, ATOM), _prefix(x, RSS_1)
        root = F.regexp_extract(x, r"<([A-Za-z_][A-Za-z0-9_.-]*):feed[\s>]", 1)
        return F.when((atom != "") & (root == atom), renamed(x, atom, "")).when(rss != "", renamed(x, rss, "")).otherwise(x)

    def of(space, usual):
        return lambda x: F.when(~_prefix(x, space).isin("", usual), renamed(x, _prefix(x, space), f"{usual}:")).otherwise(x)

    # Each step works on the last one's text; bound, since a step names it several times.
    for step in (of_roots, *(of(space, usual) for space, usual in PREFIXES.items())):
        xml = bound(xml, step)
    return xml


def _first(c: Column) -> Column:
    return F.get(c, F.lit(0))


def parse(payloads: DataFrame, content: str = "content") -> DataFrame:
    """payloads with parsed, the parsed struct; null where the payload is no well-formed XML. Bytes are decoded, text is not."""
    text = F.col(content) if payloads.schema[content].dataType.simpleString() == "string" else decode_payload(F.col(content))
    rows = payloads.select("*", held(F.ltrim(text, F.lit(" \t\r\n\ufeff")).alias("xml")).alias("_x"))
    rows = rows.select(*payloads.columns, held(usual_prefixes(F.col("_x.xml")).alias("xml")).alias("_x"))
    return rows.select(*payloads.columns, F.from_xml(F.col("_x.xml"), SCHEMA, {"attributePrefix": "_", "valueTag": "_VALUE"}).alias("parsed"))


def is_broken() -> Column:
    return F.col("parsed").isNull() | (F.col("parsed.channel").isNull() & F.col("parsed.entry").isNull() & F.col("parsed.title").isNull())


def metadata(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row per payload: keep, title, author, description, link, image_url, category, total_feed_episodes."""
    ch = lambda n: _first(F.col(f"parsed.channel.`{n}`"))
    title = F.coalesce(ch("title"), _first(F.col("parsed.title")), F.lit("Untitled Podcast"))
    author = first_truthy(ch("author"), ch("itunes:author"), ch("dc:publisher"), ch("dc:creator"), _first(F.col("parsed.author.name")))
    link = first_truthy(ch("link"), F.get(F.filter("parsed.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"])
    items = F.coalesce(F.size("parsed.channel.item"), F.size("parsed.item"), F.size("parsed.entry"), F.lit(0))
    return parsed.select(
        *keep,
        trim_ws(title).alias("title"),
        author.alias("author"),
        first_truthy(ch("description"), ch("itunes:subtitle"), ch("itunes:summary"), _first(F.col("parsed.subtitle"))).alias("description"),
        link.alias("link"),
        first_truthy(ch("image")["url"], ch("itunes:image")["_href"], _first(F.col("parsed.image"))["url"], _first(F.col("parsed.logo"))).alias("image_url"),
        first_truthy(ch("category"), ch("itunes:category")["_text"], _first(F.col("parsed.category"))["_term"]).alias("category"),
        items.alias("total_feed_episodes"),
    )


def _audio(kind: Column, url: Column, ends: list[str]) -> Column:
    low = F.lower(url)
    test = kind.startswith("audio/")
    for e in ends:
        test = F.coalesce(test, F.lit(False)) | low.endswith(e)
    return test


def enclosure_choice(item: Column) -> Column:
    """struct(url, type): first audio enclosure, else the first enclosure, else first audio media content,
    else the first link with rel=enclosure, else nulls."""
    url = lambda x: first_truthy(x["_href"], x["_url"])
    enclosures, media = item["enclosure"], item["media:content"]
    audio = F.get(F.filter(enclosures, lambda x: url(x).isNotNull() & _audio(x["_type"], url(x), ENCLOSURE_ENDS)), F.lit(0))
    plain = _first(enclosures)
    med = F.get(F.filter(media, lambda x: url(x).isNotNull() & _audio(x["_type"], url(x), MEDIA_ENDS)), F.lit(0))
    link = F.get(F.filter(item["atom:link"], lambda x: (x["_rel"] == "enclosure") & url(x).isNotNull()), F.lit(0))
    pick = lambda u, t: F.struct(u.alias("url"), t.alias("type"))
    default = F.lit("audio/mpeg")
    return (
        F.when(url(audio).isNotNull(), pick(url(audio), first_truthy(audio["_type"], default)))
        .when(url(plain).isNotNull(), pick(url(plain), plain["_type"]))
        .when(url(med).isNotNull(), pick(url(med), first_truthy(med["_type"], default)))
        .when(url(link).isNotNull(), pick(url(link), first_truthy(link["_type"], default)))
        .otherwise(pick(F.lit(None).cast("string"), F.lit(None).cast("string")))
    )


#: The episode columns that both formats give.
EPISODE = ["guid", "title", "audio_url", "duration", "published_at", "summary", "link", "enclosure_type"]


def items(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row per item of any root: keep, pos, item with the RSS item's fields."""
    none = F.lit(None).cast("array<string>")
    entry = lambda e: F.struct(
        none.alias("guid"), e["id"].alias("id"), e["title"].alias("title"),
        F.transform(F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), lambda x: x["_href"]).alias("link"),
        F.concat(F.coalesce(e["summary"], F.array().cast("array<string>")), F.coalesce(e["content"], F.array().cast("array<string>"))).alias("description"),
        none.alias("itunes:summary"), none.alias("itunes:subtitle"), none.alias("pubDate"), e["published"].alias("published"), e["updated"].alias("updated"),
        e["itunes:duration"].alias("itunes:duration"), none.alias("duration"),
        F.lit(None).cast("array<struct<_url:string,_href:string,_type:string>>").alias("enclosure"),
        F.lit(None).cast("array<struct<_url:string,_href:string,_type:string>>").alias("media:content"),
        e["link"].alias("atom:link"), none.alias("dc:date"), F.lit(None).cast("string").alias("_rdf:about"),
    )
    every = F.coalesce(F.col("parsed.channel.item"), F.col("parsed.item"), F.transform("parsed.entry", entry))
    return parsed.select(*keep, F.posexplode(every).alias("pos", "item"))


def identified(rows: DataFrame, *keep: str) -> DataFrame:
    """rows of items with audio and guid: id, guid, audio URL or link, the first that is not empty; rows with none go.

    Only what the test against known items needs; dates and durations come after it.
    """
    first = lambda n: _first(F.col(f"item.`{n}`"))
    rows = rows.select("*", held(enclosure_choice(F.col("item")).alias("audio")).alias("_h")).select(*rows.columns, "_h.audio")
    guid = first_truthy(first("id"), first("guid"), F.col("item.`_rdf:about`"), F.col("audio.url"), first("link"))
    return rows.withColumn("guid", guid).filter(F.col("guid").isNotNull())


def episodes(rows: DataFrame, *keep: str) -> DataFrame:
    """The episode columns of identified items."""
    first = lambda n: _first(F.col(f"item.`{n}`"))
    texts = held(
        date_text(first_truthy(first("pubDate"), first("published"), first("dc:date"))).alias("published"),
        date_text(first("updated")).alias("updated"),
        first_truthy(first("itunes:duration"), first("duration")).alias("duration"),
    )
    rows = rows.select("*", texts.alias("_t"))
    when = F.coalesce(date_value(F.col("_t.published")), date_value(F.col("_t.updated")))
    return rows.select(
        *keep,
        "guid",
        trim_ws(F.coalesce(first("title"), F.lit("Untitled Episode"))).alias("title"),
        F.coalesce("audio.url", F.lit("")).alias("audio_url"),
        duration_seconds(F.col("_t.duration")).alias("duration"),
        when.alias("published_at"),
        first_truthy(first("description"), first("itunes:summary"), first("itunes:subtitle")).alias("summary"),
        first("link").alias("link"),
        F.col("audio.type").alias("enclosure_type"),
    )

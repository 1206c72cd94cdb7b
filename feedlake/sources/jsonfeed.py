"""JSON Feed payloads as VARIANT: field types vary from feed to feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import date_text, date_value, decode_payload, duration_number, duration_seconds, first_truthy, held, trim_ws


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    """The type name of a variant, upper case, or null."""
    return F.upper(F.schema_of_variant(v))


def _text(v: Column | str, path: str) -> Column:
    """The value where it is text, else null."""
    x = _get(v, path, "variant")
    return F.when(_kind(x) == "STRING", _get(v, path))


def parse(payloads: DataFrame, content: str = "content") -> DataFrame:
    """payloads with parsed, a variant; null where the payload is no JSON. Bytes are decoded, text is not."""
    text = F.col(content) if payloads.schema[content].dataType.simpleString() == "string" else decode_payload(F.col(content))
    return payloads.withColumn("parsed", F.try_parse_json(text))


def _items() -> Column:
    return _get("parsed", "$.items", "array<variant>")


def metadata(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row per payload, as for XML."""
    author = _get("parsed", "$.author", "variant")
    by_list = F.coalesce(_get("parsed", "$.authors[0].name"), _text("parsed", "$.authors[0]"))
    name = (
        F.when(_kind(author).startswith("OBJECT"), _get("parsed", "$.author.name"))
        .when(F.size(_get("parsed", "$.authors", "array<variant>")) > 0, by_list)
        .when(_kind(author) == "STRING", _get("parsed", "$.author"))
    )
    return parsed.select(
        *keep,
        trim_ws(F.coalesce(_get("parsed", "$.title"), F.lit("Untitled Podcast"))).alias("title"),
        name.alias("author"),
        _get("parsed", "$.description").alias("description"),
        first_truthy(_get("parsed", "$.home_page_url"), _get("parsed", "$.feed_url")).alias("link"),
        first_truthy(_get("parsed", "$.icon"), _get("parsed", "$.image"), _get("parsed", "$.favicon")).alias("image_url"),
        _get("parsed", "$.category").alias("category"),
        F.coalesce(F.size(_items()), F.lit(0)).alias("total_feed_episodes"),
    )


def items(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row per item: keep, pos, item."""
    return parsed.select(*keep, F.posexplode(_items()).alias("pos", "item"))


def attachment_choice(item: Column) -> Column:
    """struct(url, type, duration): the first attachment with a URL that is audio, or any where the item has
    no audio_url; else the item's own values."""
    own = first_truthy(_get(item, "$.audio_url"))
    picked = F.get(
        F.filter(
            _get(item, "$.attachments", "array<variant>"),
            lambda a: first_truthy(_get(a, "$.url")).isNotNull() & (F.coalesce(_get(a, "$.mime_type").startswith("audio/"), F.lit(False)) | own.isNull()),
        ),
        F.lit(0),
    )
    there = first_truthy(_get(picked, "$.url")).isNotNull()
    key = _get(picked, "$.duration_in_seconds", "variant")
    return F.struct(
        F.when(there, _get(picked, "$.url")).otherwise(own).alias("url"),
        F.when(there, first_truthy(_get(picked, "$.mime_type"), F.lit("audio/mpeg"))).otherwise(F.coalesce(_get(item, "$.enclosure_type"), F.lit("audio/mpeg"))).alias("type"),
        F.when(there & key.isNotNull(), key).otherwise(_get(item, "$.duration", "variant")).alias("duration"),
    )


def duration_of(v: Column) -> Column:
    """Seconds of a variant that holds a number, a text or true."""
    text = F.when(_kind(v) == "STRING", _get(v, "$"))
    number = F.when(_kind(v).rlike("^(BIGINT|INT|LONG|SHORT|TINYINT|SMALLINT|DOUBLE|FLOAT|DECIMAL)"), _get(v, "$", "double"))
    truth = F.when(_kind(v) == "BOOLEAN", F.when(_get(v, "$", "boolean"), 1).otherwise(0))
    return F.coalesce(duration_seconds(text), duration_number(number), truth)


def identified(rows: DataFrame, *keep: str) -> DataFrame:
    """rows with audio and guid (id, guid, audio URL or url; numbers as text); rows with none go."""
    rows = rows.select("*", held(attachment_choice(F.col("item")).alias("audio")).alias("_h")).select(*rows.columns, "_h.audio")
    guid = first_truthy(_get("item", "$.id"), _get("item", "$.guid"), F.col("audio.url"), _get("item", "$.url"))
    return rows.withColumn("guid", guid).filter(F.col("guid").isNotNull())


def episodes(rows: DataFrame, *keep: str) -> DataFrame:
    """The episode columns of identified items. The first date text that is not empty counts, parsable or not."""
    date = first_truthy(*(_text("item", f"$.{n}") for n in ("date_published", "published_at", "published")))
    rows = rows.select("*", held(date_text(date).alias("published")).alias("_t"))
    return rows.select(
        *keep,
        "guid",
        trim_ws(F.coalesce(_get("item", "$.title"), F.lit("Untitled Episode"))).alias("title"),
        F.coalesce("audio.url", F.lit("")).alias("audio_url"),
        duration_of(F.col("audio.duration")).alias("duration"),
        date_value(F.col("_t.published")).alias("published_at"),
        first_truthy(_get("item", "$.summary"), _get("item", "$.content_text"), _get("item", "$.content_html")).alias("summary"),
        _get("item", "$.url").alias("link"),
        F.col("audio.type").alias("enclosure_type"),
    )

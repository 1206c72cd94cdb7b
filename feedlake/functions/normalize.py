"""Text, duration and date normalisation as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offsets of the zone names of mail dates, which do not follow the season.
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}

_INT = r"[+-]?[0-9]+(?:_[0-9]+)*"
_FLOAT = r"[+-]?(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?"
#: Hours or minutes, minutes, seconds: each in a group of its own, empty where it is missing.
_CLOCK = rf"^(?U:\s)*(?:({_INT})(?U:\s)*:(?U:\s)*)?(?:({_INT})(?U:\s)*:(?U:\s)*)?({_FLOAT})(?U:\s)*$"


def trim_ws(c: Column) -> Column:
    """Strips all Unicode white space, not blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_truthy(*cols: Column) -> Column:
    """The first text that is neither null nor empty, else null."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


#: The characters that windows-1252 has for the bytes 80 to 9F, where Latin-1 has control characters.
WINDOWS_1252 = {0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ"}
#: Names of the encodings that are read as windows-1252, which holds Latin-1 and ASCII.
LATIN = ["iso-8859-1", "iso8859-1", "latin1", "latin-1", "windows-1252", "cp1252", "us-ascii", "ascii"]


def _bytes(content: Column) -> Column:
    """One character for each byte. Never fails."""
    return F.decode(content.cast("binary"), "ISO-8859-1")


def declared_encoding(content: Column) -> Column:
    """The encoding that the XML declaration of the bytes names, in small letters; empty where it names none."""
    return F.lower(F.regexp_extract(_bytes(F.substring(content.cast("binary"), 1, 300)), r"""^(?:\xEF\xBB\xBF)?\s*<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._:-]+)""", 1))


def _utf16(content: Column, order: str) -> Column:
    """The text of UTF-16 bytes; null if they are odd in number or hold half of a pair, which the decoder refuses."""
    high, low = "[\\xD8-\\xDB]", "[\\xDC-\\xDF]"
    half = f"(?<!{high}.){low}.|{high}.(?!{low})" if order == "BE" else f"(?<!.{high}).{low}|.{high}(?!.{low})"
    bad = _bytes(content).rlike(f"^(?s)(?:..)*?(?:{half})")
    return F.when((F.octet_length(content) % 2 == 0) & ~bad, F.decode(content.cast("binary"), f"UTF-16{order}"))


def decode_payload(content: Column) -> Column:
    """Payload bytes as text: by their byte order mark, by zero bytes around a first angle bracket or brace (UTF-16),
    else by the XML declaration, else as UTF-8. Null where the bytes are no text of that encoding, or of one that is
    unknown here (which may still be UTF-8)."""
    content = content.cast("binary")
    begins = lambda *heads: F.hex(F.substring(content, 1, 4)).rlike(f"^(?:{'|'.join(heads)})")
    latin = F.translate(_bytes(content), "".join(map(chr, WINDOWS_1252)), "".join(WINDOWS_1252.values()))
    utf8 = content.cast("string")
    text = (
        F.when(begins("EFBBBF"), F.when(F.is_valid_utf8(utf8), utf8))
        .when(begins("FEFF", "003C", "007B"), _utf16(content, "BE"))
        .when(begins("FFFE", "3C00", "7B00"), _utf16(content, "LE"))
        .when(declared_encoding(content).isin(LATIN), latin)
        .when(F.is_valid_utf8(utf8), utf8)
    )
    return F.regexp_replace(text, "^\ufeff", "")


def duration_seconds(c: Column) -> Column:
    """Seconds of a duration text: a number (truncated), M:S or H:M:S; null for anything else or beyond INT.

    No part is range-checked, so 90:75 is 5475. Infinite and not-a-number texts give null.
    """
    part = lambda i: F.replace(F.regexp_extract(c, _CLOCK, i), F.lit("_"), F.lit("")).try_cast("double")
    ahead = F.coalesce(part(1) * F.when(F.regexp_extract(c, _CLOCK, 2) == "", 60).otherwise(3600), F.lit(0.0)) + F.coalesce(part(2) * 60, F.lit(0.0))
    last = part(3)
    return (ahead + F.signum(last) * F.floor(F.abs(last))).try_cast("int")


def duration_number(c: Column) -> Column:
    """Seconds of a numeric duration, rounded half to even; null beyond INT."""
    return F.bround(c.cast("double"), 0).try_cast("int")


def held(*cols: Column) -> Column:
    """A generator of one struct of cols: a barrier, after which they are plain columns. Without it the optimizer
    copies a long expression into each of its uses."""
    return F.explode(F.array(F.struct(*cols)))


def _usual_date(t: Column) -> Column:
    """A stripped mail or ISO 8601 date with an offset, a four-digit year and seconds; null for anything else."""
    t = F.regexp_replace(t, r"^\w+,\s*", "")
    zones = F.create_map(*(F.lit(x) for pair in ZONES.items() for x in pair))
    zone = F.regexp_extract(t, r"([A-Za-z]*)$", 1)
    bare = F.regexp_replace(t, r"\s*[A-Za-z]*$", "")
    offset = F.when(zone == "", F.when(bare.rlike(r"[+-]\d{4}$"), "").otherwise(" +0000")).otherwise(F.concat(F.lit(" "), F.try_element_at(zones, F.upper(zone))))
    mail = F.concat(F.regexp_replace(F.regexp_replace(bare, r"^(\d{1,2} \w{3}) (\d{2}) ", "$1 20$2 "), r"( \d{1,2}:\d{2})( [+-]\d{4})?$", "$1:00$2"), offset)
    iso = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.when(t.rlike(r"\d:\d.*([zZ]|[+-]\d{2}:?\d{2})$"), iso).when(t.rlike(r"\d:\d"), F.concat(t, F.lit("Z"))).otherwise(F.concat(t, F.lit("T00:00:00Z")))
    return F.when(t.rlike(r"^\d{1,2} \w{3} \d{2}(\d{2})? \d{1,2}:\d{2}(:\d{2})?( ?[A-Za-z]+| [+-]\d{4})?$"), mail).when(t.rlike(r"^\d{4}-\d{2}-\d{2}($|[T ]\d{2}:\d{2}:\d{2}([.]\d{1,9})?([zZ]|[+-]\d{2}:?\d{2})?$)"), iso)


#: Months and weekdays by their first letters, and words that dates may hold besides.
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
MONTH_NAMES = "JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER SEPT".split()
DAY_NAMES = "MONDAY TUESDAY WEDNESDAY THURSDAY FRIDAY SATURDAY SUNDAY MON TUE TUES WED WEDS THU THUR THURS FRI SAT SUN".split()
FILLERS = ["AT", "OF", "THE", "ON", "AND"]

#: A time of day: hour, minute, second, fraction, half of the day. A zone after it: a name, or an offset that a name may precede.
_TIME = r"\b(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9})\d*)?)?\s*([AP]\.?M\b\.?)?"
_ZONE = r"(?:\s*(?<![A-Z])([A-Z]{1,5})\b(?!\s+\d{1,2}\b))?(?:\s*([+-]\d{2}):?(\d{2})?\b)?"


def bound(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _any_date(t: Column) -> Column:
    """A date in another order or with other marks, as ISO 8601 text with its offset; null if day, month or year is missing.

    The text becomes a time of day, a zone and the words that are left, each of which is a month's name, a number,
    a weekday or a filler, or makes the text no date. A number of four digits is the year; next to a month's name the
    other number is the day. Of numbers alone the year stands first or last, and then the month is first unless it is
    beyond 12. Years of two digits are of this century. An unknown zone counts as UTC.
    """
    number = lambda w: w.rlike("^[0-9]+$")
    zones = F.create_map(*(F.lit(x) for pair in ZONES.items() for x in pair))

    def with_offset(clock, date):
        part = lambda i: F.regexp_extract(clock, _TIME + _ZONE, i)
        hour, half = part(1).try_cast("int"), F.substring(part(5), 1, 1)
        hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0))
        time = F.when(clock == "", "00:00:00").otherwise(F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), part(2), F.lit(":"), F.when(part(3) == "", "00").otherwise(part(3)), F.when(part(4) == "", "").otherwise(F.concat(F.lit("."), part(4)))))
        named = F.coalesce(F.try_element_at(zones, part(6)), F.lit("+0000"))
        offset = F.when(part(7) != "", F.concat(part(7), F.when(part(8) == "", "00").otherwise(part(8)))).otherwise(named)
        return F.concat(date, F.lit("T"), time, F.regexp_replace(offset, "(..)$", ":$1"))

    def of_words(words):
        name = F.filter(words, lambda w: w.isin(MONTH_NAMES + MONTHS))
        numbers = F.filter(words, number)
        strange = F.exists(words, lambda w: ~(number(w) | w.isin(MONTH_NAMES + MONTHS + DAY_NAMES + FILLERS)))
        one, two, three = (F.get(numbers, F.lit(i)) for i in range(3))
        long = lambda n: F.length(n) == 4
        month = (F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(F.get(name, F.lit(0)), 1, 3))).cast("string")
        named = (F.size(name) == 1) & (F.size(numbers) == 2)
        bare = (F.size(name) == 0) & (F.size(numbers) == 3)
        swap = one.try_cast("int") > 12
        parts = (
            F.when(named & long(one), F.array(one, month, two)).when(named, F.array(two, month, one))
            .when(bare & long(one), F.array(one, two, three)).when(bare & swap, F.array(three, two, one)).when(bare, F.array(three, one, two))
        )
        year, m, day = (F.get(parts, F.lit(i)) for i in range(3))
        year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).when(long(year), year)
        return F.when(~strange & (F.length(m) <= 2) & (F.length(day) <= 2), F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(day, 2, "0")))

    def parsed(u):
        clock = F.regexp_extract(u, _TIME + _ZONE, 0)
        left = F.when(clock == "", u).otherwise(F.replace(u, clock, F.lit(" ")))
        left = F.regexp_replace(left, r"\b(\d{1,2})(ST|ND|RD|TH)\b", "$1")
        words = F.filter(F.split(left, r"[\s,./-]+"), lambda w: w != "")
        return F.when(left.rlike(r"\d") & ~left.contains(":"), bound(words, lambda ws: with_offset(clock, of_words(ws))))

    # Numbers without marks get them; a note in brackets goes.
    u = F.regexp_replace(F.upper(t), r"\([^)]*\)", " ")
    u = F.regexp_replace(u, r"^(\d{4})(\d{2})(\d{2})(?=T|\s|$)", "$1-$2-$3")
    u = F.regexp_replace(F.regexp_replace(u, r"(?<=\d)T(\d{2})(\d{2})(\d{2})(?!\d)", " $1:$2:$3"), r"(?<=\d)T(\d{2})(\d{2})(?!\d)", " $1:$2")
    return bound(F.regexp_replace(u, r"(?<=\d)T(?=\d)", " "), parsed)


def date_text(c: Column) -> Column:
    """A date as a text that date_value reads: mail and ISO 8601 dates directly, any other order by its words.

    The weekday is dropped unread: feeds get it wrong. A date without an offset is UTC; null if it is partial or no date.
    """
    t = trim_ws(c)
    return F.coalesce(_usual_date(t), _any_date(t))


def date_value(text: Column) -> Column:
    """The instant of a date_text; null if there is no such day or time."""
    return F.coalesce(F.when(text.contains(" +") | text.contains(" -"), F.try_to_timestamp(text, F.lit("d MMM yyyy H:mm:ss Z"))), F.try_to_timestamp(F.when(text.startswith("1") | text.startswith("2"), text)))


def published_utc(c: Column) -> Column:
    """The instant of a date in any order that date_text knows; without an offset it is UTC; null if partial or no date."""
    return bound(date_text(c), date_value)


def key_of(*cols: Column) -> Column:
    """A deterministic key of its parts: the same on every retry."""
    return F.sha2(F.concat_ws("\x01", *cols), 256)

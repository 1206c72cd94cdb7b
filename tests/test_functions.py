from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedlake.functions import normalize as N

DURATIONS = [
    (None, None), ("", None), (" ", None), ("1800", 1800), ("45:30", 2730), ("01:14:22", 4462), ("1:00:00", 3600), ("invalid_duration", None),
    ("1e3", 1000), ("-5", -5), ("1_000", 1000), ("90:75", 5475), ("1:30.9", 90), ("01 : 30", 90), ("12d", None), ("0x10", None), ("nan", None),
    ("inf", None), ("1.5:00", None), ("::", None), ("1:2:3:4", None), ("99999999999", None), ("-2.9", -2), (".5", 0), ("5.", 5), (" 7\n", 7),
]


def test_duration_texts(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DURATIONS)], "i int, t string")
    got = {r.i: r.s for r in rows.select("i", N.duration_seconds(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(len(DURATIONS))] == [s for _, s in DURATIONS]


def test_duration_numbers(spark):
    rows = spark.createDataFrame([(1800.0,), (2.5,), (3.5,), (None,), (1e12,)], "v double")
    assert [r.s for r in rows.select(N.duration_number(F.col("v")).alias("s")).collect()] == [1800, 2, 4, None, None]


@pytest.mark.parametrize(
    "text, utc",
    [
        ("Mon, 10 Jan 2026 10:00:00 GMT", datetime(2026, 1, 10, 10)),
        ("10 Jan 2026 10:00 EST", datetime(2026, 1, 10, 15)),
        ("Tue, 3 Feb 2026 01:02:03 PDT", datetime(2026, 2, 3, 8, 2, 3)),
        ("3 Feb 26 01:02:03 +0100", datetime(2026, 2, 3, 0, 2, 3)),
        ("3 Feb 2026 01:02:03", datetime(2026, 2, 3, 1, 2, 3)),
        ("2026-01-10T10:00:00Z", datetime(2026, 1, 10, 10)),
        ("2026-01-10T10:00:00-0700", datetime(2026, 1, 10, 17)),
        ("2026-01-10 10:00:00.25+02:00", datetime(2026, 1, 10, 8, 0, 0, 250000)),
        ("2026-01-10T10:00:00", datetime(2026, 1, 10, 10)),
        ("2026-01-10", datetime(2026, 1, 10)),
        ("2026", None), ("Jan 2026", None), ("soon", None), ("", None), (None, None), ("32 Jan 2026 10:00:00 GMT", None),
    ],
)
def test_dates(spark, text, utc):
    row = spark.createDataFrame([(text,)], "t string").select(N.published_utc(F.col("t")).cast("timestamp_ntz").alias("d")).first()
    assert row.d == utc


def test_text(spark):
    row = spark.createDataFrame([("\t  a b \n", "", None, "z")], "a string, b string, c string, d string")
    got = row.select(N.trim_ws(F.col("a")), N.first_truthy(F.col("b"), F.col("c"), F.col("d")), N.first_truthy(F.col("b"))).first()
    assert tuple(got) == ("a b", "z", None)


TEN = datetime(2026, 1, 10, 10)
DATES = [
    ("Mon, 10 Jan 2026 10:00:00 GMT",TEN),
    ("10 Jan 2026 10:00:00 +01:00",datetime(2026,1,10,9)),
    ("10 January 2026 10:00:00 GMT",TEN),
    ("10 Jan 2026",datetime(2026,1,10)),
    ("January 10, 2026 10:00",TEN),
    ("2026/01/10 10:00",TEN),
    ("20260110T100000Z",TEN),
    ("10-Jan-2026 10:00:00",TEN),
    ("Sat Jan 10 10:00:00 2026",TEN),
    ("2026-01-10T10:00:00 GMT",TEN),
    ("Sat Jan 10 10:00:00 EST 2026",datetime(2026,1,10,15)),
    ("Saturday, January 10th, 2026 at 10:00 AM",TEN),
    ("Jan 10 2026 12:05 am",datetime(2026,1,10,0,5)),
    ("Jan. 10, 2026 12:05 p.m.",datetime(2026,1,10,12,5)),
    ("01/10/2026",datetime(2026,1,10)),
    ("13/01/2026",datetime(2026,1,13)),
    ("13.1.2026 10:00",datetime(2026,1,13,10)),
    ("20260110",datetime(2026,1,10)),
    ("20260110T1000",TEN),
    ("20260110T100000+0200",datetime(2026,1,10,8)),
    ("2026-01-10 10:00 UTC",TEN),
    ("2026-01-10T10:00+05:30",datetime(2026,1,10,4,30)),
    ("2026-01-10T10:00:00.123456789Z",datetime(2026,1,10,10,0,0,123456)),
    ("2026-1-5",datetime(2026,1,5)),
    ("5 Sept 2026 1:02:03",datetime(2026,9,5,1,2,3)),
    ("10 Jan 26 10:00 PST",datetime(2026,1,10,18)),
    ("Sat, 10 Jan 2026 10:00:00 -0500 (EST)",datetime(2026,1,10,15)),
    ("Sat, 10 Jan 2026 10:00:00 CET",TEN),
    ("10 Jan 2026 10:00:00 GMT+0200",datetime(2026,1,10,8)),
    ("2026 Jan 10",datetime(2026,1,10)),
    ("10th of January 2026",datetime(2026,1,10)),
    ("2026-01-10T24:00:00Z",None),
    ("2026",None),
    ("Jan 2026",None),
    ("10 Jan",None),
    ("10:00",None),
    ("soon",None),
    ("32 Jan 2026 10:00:00 GMT",None),
    ("10 Foo 2026",None),
    ("2026-13-01",None),
    ("30 Feb 2026",None),
    ("episode 12 of 3, 2026",None),
    ("13:00 PM 10 Jan 2026",None),
    ("1 2 3 4",None),
    ("",None),(None,None),
    ("2026-01-10T10",None),
    ("2026-01-10T10:00:00-0700",datetime(2026,1,10,17)),
    ("10 JAN 2026 10:00:00 z",TEN),
    ("Wed, 02 Oct 2002 13:00:00 GMT",datetime(2002,10,2,13)),
    ("12/31/99",datetime(2099,12,31)),
    ("2003-12-13T18:30:02.25+01:00",datetime(2003,12,13,17,30,2,250000)),
]


def test_dates_in_any_order(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DATES)], "i int, t string")
    got = {r.i: r.d for r in rows.select("i", N.published_utc(F.col("t")).cast("timestamp_ntz").alias("d")).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(DATES)] == DATES


PAYLOADS = [
    ("ascii",b"<?xml version='1.0'?><a>x</a>","<?xml version='1.0'?><a>x</a>"),
    ("bom8","\ufeff<a>é</a>".encode(),"<a>é</a>"),
    ("16be",'<a>é😀</a>'.encode('utf-16-be'),'<a>é😀</a>'),
    ("16le",'<a>é😀</a>'.encode('utf-16-le'),'<a>é😀</a>'),
    ("16bom",'{"a":"😀"}'.encode('utf-16'),'{"a":"😀"}'),
    ("odd",'<a>é</a>'.encode('utf-16-le')+b'x',None),
    ("half",b'<\0'+b'\x00\xd8'+b'a\0',None),
    ("half2",b'<\0'+b'\x00\xdc'+b'a\0',None),
    ("half3",b'\0<'+b'\xdc\x00'+b'\0a',None),
    ("1252",b"<?xml version='1.0' encoding='windows-1252'?><a>\x93\x80\x92\xe9</a>","<?xml version='1.0' encoding='windows-1252'?><a>“€’é</a>"),
    ("sjis",b"<?xml version='1.0' encoding='Shift_JIS'?><a>\x93\xfa\x96\x7b</a>",None),
    ("unk8","<?xml version='1.0' encoding='foo'?><a>é</a>".encode(),"<?xml version='1.0' encoding='foo'?><a>é</a>"),
    ("bad",b"<a>\xe9</a>",None),
    ("null",None,None),
    ("empty",b"",""),
    ("long16",('<a>'+'😀é'*200000).encode('utf-16-le'),'<a>'+'😀é'*200000),
]


def test_encodings(spark):
    rows = spark.createDataFrame([(n, b) for n, b, _ in PAYLOADS], "n string, b binary")
    got = {r.n: r.t for r in rows.select("n", N.decode_payload(F.col("b")).alias("t")).collect()}
    assert got == {n: t for n, _, t in PAYLOADS}
    assert rows.filter("n = 'sjis'").select(N.declared_encoding(F.col("b"))).first()[0] == "shift_jis"

"""Secret scans with multipart credential linking.

Base finds are those of three fixed patterns. Around them lie weaker parts: account names, values under
key-like names, unlabelled random-looking strings, endpoints. A weak part alone says nothing, so it is
reported only when its complement lies in the same scope: parts are intervals, and an interval join
(sorted starts, binary search) finds for each weak part whether a complementary interval begins or ends
within REACH code points inside the same paragraph.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, without

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs of 32 and more
KINDS = ["assign", "access", "hex", "account", "keyed", "blob", "endpoint"]

#: Weak parts: names of accounts, values under names like "key", mixed strings of 20 and more, endpoints.
ACCOUNT = re.compile(r"""\b(?:access_?key(?:_?id)?|client_?id|user(?:name)?|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.I | re.A)
KEYED = re.compile(r"""\b(?:key|pwd|pass|auth|credentials?|private_?key|signature)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", re.I | re.A)
BLOB = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}", re.A)
#: Addresses, and host names (whole runs of their signs, so that a run is read once) of the domains in TOP.
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|(?<![A-Za-z0-9.-])[a-z0-9-]++(?:\.([a-z0-9-]++))+(?::[0-9]+)?(?![A-Za-z0-9_])""", re.A)
TOP = (None, "com", "net", "org", "io", "local")

#: Farthest, in code points, that the parts of one credential lie from each other.
REACH = 200
#: kind -> role it plays in a credential.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "account": "id", "keyed": "secret", "blob": "secret", "endpoint": "endpoint"}
#: What each role needs nearby; an endpoint needs both.
NEEDS = {"id": ("secret",), "secret": ("id",), "endpoint": ("id", "secret")}
_BREAK = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base finds, by start and then kind; each test before a pattern is one it implies."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class _Intervals:
    """Disjoint or nested intervals of one role, asked whether one lies within reach of another interval."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [a for a, _ in self.spans]
        self.ends, far = [], -1
        for _, b in self.spans:  # farthest end so far: it rises, so binary search works
            far = max(far, b)
            self.ends.append(far)

    def near(self, a: int, b: int) -> bool:
        # some interval with start <= b and end >= a
        n = bisect_right(self.starts, b)
        return bisect_left(self.ends, a, 0, n) < n


def linked_spans(text: str, base: list[tuple[int, int, str]], reach: int = REACH) -> list[tuple[int, int, str]]:
    """Weak parts outside the base finds whose complements lie within reach in their paragraph."""
    if not base and ":" not in text and "=" not in text:
        return []  # no base find and no named value: neither an id nor a labelled secret can occur
    ids = [(m.start(), m.end(), "account") for m in ACCOUNT.finditer(text)]
    if not ids and not any(ROLE[k] == "id" for _, _, k in base):
        return []  # every link needs an id
    weak = ids + [(m.start(), m.end(), kind) for kind, p in (("keyed", KEYED), ("blob", BLOB)) for m in p.finditer(text)]
    weak += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text) if m[1] in TOP]
    taken = _Intervals([(a, b - 1) for a, b, _ in base])
    weak = [(a, b, k) for a, b, k in weak if not taken.near(a, b - 1)]
    parts = {role: _Intervals([(a, b) for a, b, k in base + weak if ROLE[k] == role]) for role in NEEDS}
    breaks = [m.span() for m in _BREAK.finditer(text)]
    begins = [b for b, _ in breaks]

    def scope(a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(begins, a), bisect_left(begins, b)
        return max(a - reach, breaks[i - 1][1] if i else 0), min(b + reach, begins[j] if j < len(breaks) else len(text))

    return [(a, b, k) for a, b, k in weak if all(parts[r].near(*scope(a, b)) for r in NEEDS[ROLE[k]])]



SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """docs with found_spans (kind, start, end in code points, base or linked), in place of such a column (in whatever case).

    Null or empty text: an empty list. Each row stands for itself, so repeated rows and null ids are fine.
    """
    kept = without(docs, ["found_spans"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def find(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                out = []
                for text in rows.column("text").to_pylist():
                    base = base_spans(text or "")
                    spans = [(*s, True) for s in base] + [(*s, False) for s in linked_spans(text or "", base, reach)]
                    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                    out.append([{"kind": k, "start": a, "end": b, "base": own} for a, b, k, own in spans])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, kind)], names=[*rows.schema.names, "found_spans"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields)
    return kept.mapInArrow(find, f"{fields}found_spans {SPANS}")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found_spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found_spans")).alias("spans"))

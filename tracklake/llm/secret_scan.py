"""Secret scans with multipart credential linking.

A credential has parts: an identifier (access key id, client or user name, mailbox), a secret and an endpoint. Strong
parts are reported as they are. Weak ones (a client name, a mailbox, an opaque token, an endpoint) are common in clean
text and are reported only if the parts that complete them start within the same scope: an identifier and a secret for
each other, both for an endpoint. Parts that are linked share no character, so nothing completes itself. Extraction is a
small function on a text; linking joins each part with the interval around it by Spark's range-framed windows, so a text
with very many parts makes no pairs.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import cut, small_batches

#: Span kinds in the order in which spans of equal start are listed; the first three are the base ones.
KINDS = ("assign", "access", "hex", "client", "opaque", "endpoint", "mailbox")
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "client": "id", "opaque": "secret", "endpoint": "endpoint", "mailbox": "id"}
#: Of parts that share characters the first in this order is linked.
FIRST = ("access", "assign", "hex", "client", "mailbox", "endpoint", "opaque")
SCOPE = 200  # code points between the starts of parts of one credential

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # as [0-9a-f]+ of 24 characters or more
CLIENT = re.compile(r"""(?:user(?:_?name)?|login|client_?id|account|access_?key_?id)["']?\x20*[:=]\x20*["']?(?!https?:)[A-Za-z0-9@._-]{3,}""", re.A | re.I)
MAILBOX = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""https?://[^\s"'<>|]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9.])""")

_HEX_BYTES = bytes(0x78 if c in b"0123456789abcdef" else 0x20 for c in range(256))


def opaque(token: str) -> bool:
    """Letters and digits, and 3 bits a character or more."""
    counts = Counter(token)
    bits = -sum(n / len(token) * math.log2(n / len(token)) for n in counts.values())
    return bits >= 3 and any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def parts(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, linked) of the parts in a text: all base spans, and the weak ones that touch none found before.

    Those that are linked share no character with one another: of base spans, too, only the first in the order of FIRST is.
    """
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()  # of bytes: A-Z only
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in FIRST}
    if any(k in low for k in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
        found["assign"] = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found["access"] = [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"x" * 24 in raw.translate(_HEX_BYTES):
        found["hex"] = [m.span() for m in HEX.finditer(text)]
    if any(k in low for k in (b"user", b"login", b"client", b"account", b"access")):
        found["client"] = [m.span() for m in CLIENT.finditer(text)]
    if b"@" in raw:
        found["mailbox"] = [m.span() for m in MAILBOX.finditer(text)]
    if found["access"] or found["client"] or found["mailbox"]:  # without an identifier no other weak part can be linked
        found["opaque"] = [m.span() for m in OPAQUE.finditer(text) if opaque(m[0])]
        found["endpoint"] = [m.span() for m in ENDPOINT.finditer(text)]
    taken: list[tuple[int, int]] = []  # disjoint, in order
    out = []
    for kind in FIRST:
        free = apart(found[kind], taken)
        base = kind in KINDS[:3]
        out += [(kind, s, e, ok) for (s, e), ok in zip(found[kind], free, strict=True) if ok or base]
        taken = united(taken + [x for x, ok in zip(found[kind], free, strict=True) if ok or base])
    return out


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The characters of the spans as disjoint ones, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[bool]:
    """Whether each span shares no character with any taken one; the taken ones are disjoint and in order."""
    def touches(start: int, end: int) -> bool:
        before = bisect_left(taken, (end,)) - 1  # the last that starts before the end: those before it end earlier still
        return before >= 0 and taken[before][1] > start

    return [not touches(*x) for x in spans]


def secret_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of df: doc_id, base (array of kind, start, end) and spans (base and linked weak ones).

    Both are sorted by start, then kind as in KINDS; offsets are code points, ends exclusive. Null and empty texts have
    none. Rows that repeat an id are scanned and linked each on its own. Other columns are not read.
    """
    small_batches(df.sparkSession)
    source = df.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("_tl_row"), F.col(text).alias("text"))
    span = pa.struct([("start", pa.int64()), ("k", pa.int32()), ("end", pa.int64()), ("linked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted((s, KINDS.index(k), e, ok) for k, s, e, ok in parts(t.as_py())) for t in b.column("text")]
            rows = pa.array([[{"start": s, "k": k, "end": e, "linked": ok} for s, k, e, ok in x] for x in found], pa.list_(span))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_tl_row"), rows], ["doc_id", "_tl_row", "parts"])

    kind = source.schema["doc_id"].dataType.simpleString()
    rows = cut(source.mapInArrow(run, f"doc_id {kind}, _tl_row long, parts array<struct<start:bigint,k:int,end:bigint,linked:boolean>>"))
    each = rows.where(F.exists("parts", lambda p: p["k"] > 2)).select("_tl_row", F.explode("parts").alias("p")).where("p.linked")
    near = Window.partitionBy("_tl_row").orderBy("p.start").rangeBetween(-scope, scope)
    roles = F.array(*[F.lit(ROLES[k]) for k in KINDS])
    role = F.element_at(roles, F.col("p.k") + 1)
    has = lambda r: F.max(role == r).over(near)
    linked = each.withColumns({"role": role, "id": has("id"), "secret": has("secret")})
    needs = F.when(F.col("role") == "id", F.col("secret")).when(F.col("role") == "secret", F.col("id")).otherwise(F.col("id") & F.col("secret"))
    weak = linked.where((F.col("p.k") > 2) & needs).groupBy("_tl_row").agg(F.collect_list("p").alias("weak"))
    base = F.filter("parts", lambda p: p["k"] <= 2)
    names = lambda a: F.transform(a, lambda p: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), p["k"] + 1).alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    spans = F.when(F.col("weak").isNull(), base).otherwise(F.sort_array(F.concat(base, F.col("weak"))))
    return rows.join(weak, "_tl_row", "left").select("doc_id", names(base).alias("base"), names(spans).alias("spans"))

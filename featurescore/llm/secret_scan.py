"""Secret scan with multipart credential linking.

Strong findings stand alone: assigned secrets, access identifiers and long hexadecimal strings. Weak candidates
(an account name, a random-looking token, an endpoint) are common in clean text; they are reported only where a
complementary part stands within the same scope: an identifier or an endpoint beside a secret, a token beside an
identifier or an endpoint. The link is an interval join within each text: parts are sorted by start, and for each
candidate a binary search over starts and running ends tells whether any complementary part meets its scope, and which:
of the parts that start before the scope ends, the one that reaches furthest (the first of these). A text is the only
place where parts can meet, so rows are never shuffled, and a text full of parts costs n log n.

Defined results: a null or empty text has no findings; repeated rows are rows of their own; of findings with the same
start, kinds come as listed, then ends; positions count code points, ends exclusive; a text of any length is scanned whole
in one task, in time linear in its length but for sorting; an empty table gives no rows; other columns of the table stay as
they are, but for `secrets`, which is replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, as_bytes, unused, word_bounds

#: Code points between two parts of one credential, at most.
SCOPE = 200

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak candidates, by kind.
ACCOUNT = re.compile(r"""\b(?:user(?:name)?|login|account|client|tenant|app|access|key)[_-]?(?:id|name|key)?["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: What an endpoint is found by: the sign after a scheme, or a port. What stands before is read backwards, once.
SCHEME, PORT = re.compile(r"""://[^\s"'<>]+"""), re.compile(r":\d{2,5}\b", re.A)
_SCHEME_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_HOST_SIGNS = _SCHEME_SIGNS - {"+"}
KINDS = ("assign", "access", "hex", "account", "opaque", "endpoint")
ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "id", "account": "id", "endpoint": "endpoint"}
PARTNERS = {"account": ("secret",), "endpoint": ("secret",), "opaque": ("id", "endpoint")}

_HEX_BYTES, _TOKEN_BYTES = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_HEX_BYTES[[*b"0123456789abcdef"]] = True
_TOKEN_BYTES[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True


def strong(text: str) -> list[tuple[int, int, str]]:
    """Strong findings of each kind, leftmost and not overlapping within the kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def random_looking(token: str) -> bool:
    if not (re.search("[0-9]", token) and re.search("[A-Z]", token) and re.search("[a-z]", token)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= 3.5


def _back(text: str, end: int, least: int, signs: frozenset) -> int:
    """Where the run of signs that ends at `end` begins, not before `least`."""
    start = end
    while start > least and text[start - 1] in signs:
        start -= 1
    return start


def _host(run: str) -> int:
    """Where in a run of host signs before a port the host begins, a name or four numbers; -1 if there is none."""
    labels = run.split(".")
    if len(labels) >= 4 and all(x.isdigit() and len(x) <= 3 for x in labels[-4:]):
        return len(run) - len(".".join(labels[-4:]))
    if len(labels) < 2 or len(labels[-1]) < 2 or not labels[-1].isalpha():
        return -1
    k = len(labels) - 1
    while k and labels[k - 1].strip("-"):
        k -= 1
    name = ".".join(labels[k:]).lstrip("-")
    return len(run) - len(name) if "." in name else -1


def endpoints(text: str) -> list[tuple[int, int]]:
    """Addresses with a scheme, and hosts with a port, outside of these; leftmost, not overlapping. Linear in the text.

    Runs of signs before two schemes, or before two ports, never overlap, since no colon is among the signs.
    """
    found, at = [], 0
    while m := SCHEME.search(text, at):
        start = _back(text, m.start(), at, _SCHEME_SIGNS)
        while start < m.start() and not text[start].isalpha():
            start += 1
        if start < m.start():
            found.append((start, m.end()))
        at = m.end()
    ends, hosts, last = found, [], 0
    k = 0
    for m in PORT.finditer(text):
        while k < len(ends) and ends[k][1] <= m.start():
            last = ends[k][1]
            k += 1
        if k < len(ends) and ends[k][0] < m.end():
            continue
        start = _back(text, m.start(), last, _HOST_SIGNS)
        shift = _host(text[start : m.start()])
        if shift >= 0:
            hosts.append((start + shift, m.end()))
        last = m.end()
    return sorted(found + hosts)


Part = tuple[int, int, str]


def weak(text: str, found: list[Part]) -> list[Part]:
    """Weak candidates, but for those on a strong finding, which add nothing."""
    out = [(m.start(), m.end(), "account") for m in ACCOUNT.finditer(text)] + [(s, e, "endpoint") for s, e in endpoints(text)]
    out += [(m.start(), m.end(), "opaque") for m in OPAQUE.finditer(text) if random_looking(m[0])]
    taken = sorted(found)
    starts, ends = [x[0] for x in taken], list(accumulate((x[1] for x in taken), max))
    return [w for w in out if not (k := bisect_right(starts, w[1] - 1)) or ends[k - 1] <= w[0]]


def linked(text: str) -> list[tuple[int, int, str, Part | None]]:
    """Strong findings and linked weak ones, by start, then by kind as listed; weak ones with the part they are linked to."""
    sure = strong(text)
    found = [(*x, None) for x in sure]
    if candidates := weak(text, sure):
        parts: dict[str, list[Part]] = {}
        for part in sorted(sure + candidates):
            parts.setdefault(ROLE[part[2]], []).append(part)
        reach = {role: ([x[0] for x in p], list(accumulate(p, lambda a, b: b if b[1] > a[1] else a))) for role, p in parts.items()}
        for s, e, kind in candidates:
            for role in PARTNERS[kind]:
                at, furthest = reach.get(role, ([], []))
                k = bisect_right(at, e + SCOPE)
                if k and furthest[k - 1][1] >= s - SCOPE:
                    found.append((s, e, kind, furthest[k - 1]))
                    break
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan(text: str) -> list[Part]:
    """The findings of linked() alone."""
    return [x[:3] for x in linked(text)]


def _may_hold(column: pa.Array) -> np.ndarray:
    """Rows with a byte run or sign that some pattern needs; the others have no findings."""
    data, at = as_bytes(column)
    hit = np.zeros(len(at) - 1, dtype=bool)
    for table, least in ((_HEX_BYTES, 24), (_TOKEN_BYTES, 20)):
        starts, ends, _ = word_bounds(data, at, table)
        hit[np.searchsorted(at, starts[ends - starts >= least], side="right") - 1] = True
    signs = np.flatnonzero((data == ord(":")) | (data == ord("=")))
    hit[np.searchsorted(at, signs, side="right") - 1] = True
    return hit


_PART = [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]
_SPANS = pa.list_(pa.struct([*_PART, ("partner", pa.struct(_PART))]))


def _cut(text: str, found: list[tuple]) -> str:
    """text with every finding, overlapping ones as one, replaced by [SECRET]."""
    parts, at = [], 0
    for s, e, *_ in found:
        if s >= at:
            parts += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


_BOTH = pa.struct([("secrets", _SPANS), ("clean", pa.string())])


def _scan(redacted: bool):
    def run(texts: pa.Array) -> pa.Array:
        may, out = np.concatenate([_may_hold(texts.slice(i, 64)) for i in range(0, len(texts), 64)]) if len(texts) else [], []
        for i, hit in enumerate(may):
            text = texts[i].as_py() if hit else ""
            found = linked(text)
            spans = [{"start": s, "end": e, "kind": k, "partner": p and dict(zip(("start", "end", "kind"), p, strict=True))} for s, e, k, p in found]
            out.append({"secrets": spans, "clean": _cut(text, found) if found else None} if redacted else spans)
        return pa.array(out, _BOTH if redacted else _SPANS)

    return run


_TYPE = "array<struct<start:long,end:long,kind:string,partner:struct<start:long,end:long,kind:string>>>"


def scan_secrets(docs: DataFrame, text: str = "text", clean: str | None = None) -> DataFrame:
    """docs with the column secrets: array of (start, end, kind, partner).

    partner is the part that a weak finding is linked to (start, end, kind), null for strong findings.

    clean names a further column, which replaces one of that name: the text with its findings, overlapping ones as one,
    replaced by [SECRET]; the text itself where nothing is found.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    whole = F.col(text).cast("string")
    if clean is None:
        return docs.withColumn("secrets", F.arrow_udf(_scan(False), _TYPE)(whole))
    own = unused(docs, "scan_both")
    made = docs.withColumn(own, F.arrow_udf(_scan(True), f"struct<secrets:{_TYPE},clean:string>")(whole))
    return made.withColumns({"secrets": F.col(own).getField("secrets"), clean: F.coalesce(F.col(own).getField("clean"), whole)}).drop(own)


def _named(part: Column) -> Column:
    return F.concat_ws(":", part["kind"], part["start"], part["end"])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, _named), ",")


def links(spans: Column) -> Column:
    """Weak findings and what they are linked to, as kind:start:end>kind:start:end, comma-joined."""
    return F.array_join(F.transform(F.filter(spans, lambda s: s["partner"].isNotNull()), lambda s: F.concat_ws(">", _named(s), _named(s["partner"]))), ",")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), links(F.col("secrets")).alias("links"))


def base_digest(text: str | None) -> str:
    """The digest of the strong findings of a text; for tests."""
    found = sorted(strong(text or ""), key=lambda x: (x[0], KINDS.index(x[2])))
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in found).encode()).hexdigest()

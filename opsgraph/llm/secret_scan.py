"""Secret scans with multipart credential linking.

Strong patterns are reported where they stand.  Weak ones (a bare random-looking string, an account name, an
endpoint) mean little alone: the parts of a document are interval-joined within a scope, and a weak candidate is
reported only where a complementary part lies in its scope: a secret for an identifier or an endpoint, either of those
for a secret.  The work is within a row: a text is scanned by a few regular expressions, whose time is linear in the
text (runs of a class are tried from their start only), and the join is a sweep over its parts in order of position.
No shuffle; very long texts cost memory in proportion to one text.

Offsets are code points, end exclusive.  Null and empty texts give no findings; equal texts give equal findings, and
repeated rows each their own.  A kept column with the name of one that is made here is an error.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import column_map


class Finding(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Patterns that are secret by their form: kind, regular expression, score.
FORMS = [
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s\\]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)"), 0.99),
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"), 0.9),
    ("vendor", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{20,})"), 0.95),
    ("login_url", re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{3,128}@[A-Za-z0-9.-]+"), 0.9),
]
#: Weak parts: kind, role, regular expression.
WEAK = [
    ("endpoint", "endpoint", re.compile(r"\b(?:https?|wss?|jdbc:[a-z]+|redis|amqp|mongodb)://[A-Za-z0-9.-]+(?::\d{2,5})?|(?<![A-Za-z0-9_.-])[a-z0-9-]++(?:\.[a-z0-9-]++)++:\d{2,5}\b")),
    ("account", "identifier", re.compile(r"""(?i:\b(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9._@-]{3,64})""")),
    ("random", "secret", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,128}={0,2}(?![A-Za-z0-9+/_=-])")),
]
#: Which roles complement a role: names and addresses alone are no credential.
PARTNERS = {"secret": {"identifier", "endpoint"}, "identifier": {"secret"}, "endpoint": {"secret"}}
#: Kinds that stay in a text when secrets are taken out of it.
PUBLIC = {"endpoint"}
#: Parts that lie at most so many characters apart are in one scope.
SCOPE = 200
#: Bits a character that a bare string must have to be a candidate.
LEAST_BITS = 3.5


def bits(value: str) -> float:
    """Entropy of a string's characters, in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def linked(parts: list[tuple[int, int, str]], scope: int = SCOPE, partners: dict[str, set[str]] | None = None) -> list[bool]:
    """Interval join: of each (start, end, role), whether a part of another role (or of its role's ``partners``) lies
    within ``scope`` characters.

    The ends are kept by role in order, so each part asks each other role once: n log n, whatever the overlaps.
    """
    by_role: dict[str, tuple[list[int], list[int]]] = {}
    for start, end, role in sorted(parts):
        starts, reach = by_role.setdefault(role, ([], []))
        starts.append(start)
        reach.append(max(end, reach[-1] if reach else 0))  # the furthest end so far
    out = []
    for start, end, role in parts:
        found = False
        for other, (starts, reach) in by_role.items():
            if other in partners[role] if partners else other != role:
                k = bisect_right(starts, end + scope)  # those that start before the scope ends
                found |= k > 0 and reach[k - 1] >= start - scope
        out.append(found)
    return out


def find_secrets(text: str | None, scope: int = SCOPE) -> tuple[list[Finding], list[Finding]]:
    """The base findings and those of the method, each by start and kind."""
    if not text:
        return [], []
    low = text.lower()
    base, parts = [], []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                base.append(Finding("assign", m.start(), m.end(), 0.6 + 0.3 * (bits(m[2]) >= 3)))
    if "AKIA" in text:
        base += [Finding("access", m.start(), m.end(), 0.95) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [Finding("hex", m.start(), m.end(), 0.5 + 0.3 * (bits(m[0]) >= 3)) for m in HEX.finditer(text)]
    order = {"assign": 0, "access": 1, "hex": 2}
    base.sort(key=lambda f: (f.start, order[f.kind]))
    more = []
    if "-----BEGIN" in text or "eyJ" in text or "_" in text or "-" in text or "AIza" in text or "://" in text:
        for kind, form, score in FORMS:
            more += [Finding(kind, m.start(), m.end(), score) for m in form.finditer(text)]
    roles = {"assign": "secret", "access": "identifier", "hex": "secret", "login_url": "endpoint"}
    parts = [(f, roles.get(f.kind, "secret")) for f in (*base, *more)]
    weak = []
    for kind, role, form in WEAK[:2]:
        if (kind == "endpoint" and ":" in text) or (kind == "account" and (":" in text or "=" in text)):
            weak += [(Finding(kind, *m.span(m.lastindex or 0), 0.4), role) for m in form.finditer(text)]
    if weak or any(role != "secret" for _, role in parts):
        known = sorted((f.start, f.end) for f, _ in parts)
        reach = list(accumulate((e for _, e in known), max))  # the furthest end so far
        kind, role, form = WEAK[2]
        for m in form.finditer(text):
            k = bisect_left(known, (m.end(), 0))
            if bits(m[0]) >= LEAST_BITS and re.search("[0-9]", m[0]) and not (k and reach[k - 1] > m.start()):
                weak.append((Finding(kind, m.start(), m.end(), 0.5), role))
    if weak:
        everything = [*parts, *weak]
        joined = linked([(f.start, f.end, role) for f, role in everything], scope, PARTNERS)
        more += [f._replace(score=f.score + 0.3) for (f, _), yes in zip(weak, joined[len(parts) :], strict=True) if yes]
    more.sort(key=lambda f: (f.start, f.kind))
    return base, more


FINDING = "struct<kind:string,start:int,end:int,score:double,base:boolean>"


def redacted(text: str | None, findings: list[Finding], sign: str = "[SECRET]") -> str | None:
    """The text with each maximal run of findings replaced; endpoints stay, as they are no secret themselves."""
    if not findings:
        return text
    out, at, runs = [], 0, []
    for f in sorted((f for f in findings if f.kind not in PUBLIC), key=lambda f: (f.start, f.end)):
        if runs and f.start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], f.end)
        else:
            runs.append([f.start, f.end])
    for start, end in runs:
        out += [text[at:start], sign]
        at = end
    return "".join([*out, text[at:]])


def scan_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), scope: int = SCOPE, redact_as: str | None = None) -> DataFrame:
    """``keep`` columns and ``findings``, an array of (kind, start, end, score, base); one row for each row.

    With ``redact_as``, also ``redacted``: the text with findings replaced by that string (null stays null).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    made = {"findings": T.StructType.fromDDL(f"x array<{FINDING}>")[0].dataType} | ({"redacted": T.StringType()} if redact_as is not None else {})
    if set(made) & set(keep):
        raise ValueError(f"columns {sorted(made)} are made here")
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField(k, t) for k, t in made.items()])
    arrow = to_arrow_schema(schema)

    def convert(texts: pa.Array) -> dict[str, pa.Array]:
        rows = texts.to_pylist()
        found = [find_secrets(t, scope) for t in rows]
        out = {"findings": pa.array([[f._asdict() | {"base": True} for f in a] + [f._asdict() | {"base": False} for f in b] for a, b in found], arrow.field("findings").type)}
        if redact_as is not None:
            out["redacted"] = pa.array([redacted(t, a + b, redact_as) for t, (a, b) in zip(rows, found, strict=True)], pa.string())
        return out

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(column_map(convert, "__text", arrow, list(keep)), schema)

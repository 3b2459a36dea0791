"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only, within the row: no shuffle, no join, no Python.  A text is tested for the character that a
kind needs before its expression runs.  The expressions give the leftmost matches, each apart from the one before,
and are written so that long runs of one class cost linear time and no stack: a start inside such a run is tried only
right after a match.

Offsets are code points, end exclusive.  A null text is an empty one; equal texts give equal spans, repeated rows each
their own.  Very long texts and thousands of spans in one cost time linear in both.  A column of the input with the name
of one that is made here is an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_scan import places
from .shared import let, reject_clashes, text_of

#: Kinds of the base, in this order.
BASE = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "mac": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "domestic_phone": r"(?<![0-9+(.-])\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[.-][0-9]{4}(?![0-9-])",
    "birth_date": r"(?i)\b(?:born(?: on)?|birth(?:day|date)|date of birth|dob)[:\s]{1,3}(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4})",
}
#: What a text must match before a kind's expression runs.
NEEDS = {
    "email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}[ ]?[A-Z0-9]{4}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "mac": r"[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}:", "ipv6": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "domestic_phone": r"[0-9]{3}[.-][0-9]{4}", "birth_date": r"(?i)born|birth|dob",
}
#: Score of a confirmed span, and words near it that raise or lower it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.6, "mac": 0.6, "ipv6": 0.7, "domestic_phone": 0.5, "birth_date": 0.8}
RAISES = {
    "email": r"mail|contact|write to", "ip": r"\bip\b|address|host|login|client", "card": r"card|visa|master|amex|credit|debit|payment", "phone": r"phone|call|tel|mobile|fax|contact",
    "iban": r"iban|bank|account|transfer", "ssn": r"ssn|social security|tax", "mac": r"\bmac\b|device|address", "ipv6": r"\bip\b|address|host", "domestic_phone": r"phone|call|tel|mobile|fax", "birth_date": r"born|birth|dob",
}
LOWERS = r"version|example|test|sample|order|serial|invoice"
RAISE, LOWER, NEAR = 0.1, 0.2, 40


def luhn(digits: Column) -> Column:
    """Luhn's sum is a multiple of ten."""
    reverse = F.split(F.reverse(digits), "")

    def add(acc, d):
        value = F.when(acc["odd"], d.cast("int") * 2).otherwise(d.cast("int"))
        return F.struct((acc["sum"] + F.when(value > 9, value - 9).otherwise(value)).alias("sum"), (~acc["odd"]).alias("odd"))

    shown = F.filter(reverse, lambda d: d != "")
    return F.aggregate(shown, F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), add)["sum"] % 10 == 0


def mod97(account: Column) -> Column:
    """The account number's remainder by 97 is one, its first four characters moved to the end."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))
    step = lambda acc, c: F.when(c == "", acc).when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind in ("ip",):
        return hit.rlike(r"^(?:0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(hit, F.lit(" "), F.lit(""))).between(15, 34) & mod97(hit)
    return F.lit(True)


_SPAN = "struct<kind:string,start:int,end:int,score:double,base:boolean>"


#: Code points in a piece of a text; what lies near a span is cut out of two of them, not out of the whole text.
PIECE = 1024


def _around(pieces: Column, start: Column, end: Column) -> Column:
    """Up to ``NEAR`` characters on each side, of a text cut into pieces."""

    def cut(begin, length):
        i = F.floor(begin / PIECE).cast("int")
        two = F.concat(F.coalesce(F.get(pieces, i), F.lit("")), F.coalesce(F.get(pieces, i + 1), F.lit("")))
        return F.substring(two, begin - i * PIECE + 1, length)

    return F.lower(F.concat(cut(F.greatest(F.lit(0), start - NEAR), F.least(start, F.lit(NEAR))), F.lit(" "), cut(end, F.lit(NEAR))))


def _spans(body: Column, kind: str) -> Column:
    none = F.expr(f"cast(array() as array<{_SPAN}>)")

    def scored(good):
        def all_of(pieces):
            def span(m):
                def made(near):
                    score = F.lit(SCORES[kind]) + F.when(near.rlike(RAISES[kind]), F.lit(RAISE)).otherwise(F.lit(0.0)) - F.when(near.rlike(LOWERS), F.lit(LOWER)).otherwise(F.lit(0.0))
                    return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3).alias("score"), F.lit(kind in BASE).alias("base"))

                return let(_around(pieces, m["start"], m["end"]), made)

            return F.transform(good, span)

        return F.when(F.size(good) == 0, none).otherwise(let(F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), all_of))

    good = F.filter(places(body, F.lit(PATTERNS[kind])), lambda m: _confirmed(kind, m["hit"]))
    return F.when(body.rlike(NEEDS[kind]), let(good, scored)).otherwise(none)


def _covered(listed: Column, span: Column) -> Column:
    """Whether a span overlaps one of a kind's, which are apart and in order: the last that starts before its end is
    found by binary search, and no other of them ends later."""
    powers = F.expr(f"array({','.join(str(1 << i) for i in range(26, -1, -1))})")
    before = F.aggregate(powers, F.lit(0), lambda n, p: F.when((n <= F.size(listed) - p) & (F.get(listed, n + p - 1)["start"] < span["end"]), n + p).otherwise(n))
    return F.when(F.size(listed) == 0, F.lit(False)).otherwise(F.coalesce(F.get(listed, before - 1)["end"] > span["start"], F.lit(False)))


def find_pii(df: DataFrame, text: str = "text", kinds: list[str] | None = None) -> DataFrame:
    """All columns of ``df`` and ``spans``: an array of (kind, start, end, score, base), kinds in the order of the table
    and each kind by start.  Spans of the base are all there; a span of another kind that overlaps one of them isn't."""
    kinds = kinds or list(PATTERNS)
    base, more = [k for k in kinds if k in BASE], [k for k in kinds if k not in BASE]
    reject_clashes(df.columns, ["spans", *[f"__{k}" for k in kinds]])
    body = text_of(text)
    made = df.withColumns({f"__{k}": _spans(body, k) for k in kinds})
    apart = [F.filter(f"__{k}", lambda s: ~reduce(lambda a, b: a | b, [_covered(F.col(f"__{b}"), s) for b in base], F.lit(False))) for k in more]
    found = F.concat(F.expr(f"cast(array() as array<{_SPAN}>)"), *[F.col(f"__{k}") for k in base], *apart)
    return made.withColumn("spans", found).drop(*[f"__{k}" for k in kinds])


def mask(text: Column, spans: Column, sign: str = "#") -> Column:
    """The text with the characters of the spans replaced, one sign each."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        begin = F.greatest(acc["at"], s["start"])
        end = F.greatest(acc["at"], s["end"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, begin - acc["at"]), F.repeat(F.lit(sign), end - begin)).alias("out"))

    done = F.aggregate(ordered, start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

"""Document fingerprints from closed syncmers.

A k-mer of words is an anchor when the smallest of its inner runs of s words (by hash; single words here) is the first
or the last one.
That depends on the k-mer alone, so a passage has the same anchors wherever it stands, and an edit moves no anchor
outside its own k words.  The fingerprint is all anchors, each with its place, in order of place; two fingerprints are
compared by the share of distinct anchors in common, and the places of common anchors give the passages that match.

DataFrame functions only, within the row.  Words are runs between white space of the text as it is.  A text without
closed syncmers (of fewer than k words, or of few more) has one anchor, of all its words; an empty or null text has the empty fingerprint.  Equal texts have
equal fingerprints, repeated rows each their own; two empty ones have likeness 1, an empty and another one 0.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, reject_clashes, text_of

#: Words of a k-mer and of an inner run.
K, S = 5, 1
SPACE = " \t\n\x0b\x0c\r"
PLACE = "struct<hash:bigint,at:int>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: an array bound by a lambda is a value, a repeated expression isn't."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hash(h: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(h, i + j) for j in range(n)])


def _hashes(text: Column) -> Column:
    """Hashes of the words; of nothing but white space, one of the empty word (see :func:`_nothing`)."""
    return F.transform(F.split(F.btrim(text, F.lit(SPACE)), r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))


def _nothing(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE)) == ""


def _closed(h: Column, k: int, s: int) -> Column:
    """Places of the closed syncmers among the k-mers of word hashes."""
    inner = h if s == 1 else F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(h) - s)), lambda i: _hash(h, i, s))
    span = k - s  # inner runs 0 to span

    def places(runs):
        def closed(i):
            middle = [F.get(runs, i + j) for j in range(1, span)]
            edge = F.least(F.get(runs, i), F.get(runs, i + span))
            return edge <= (F.least(*middle) if len(middle) > 1 else middle[0]) if middle else F.lit(True)

        return F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(h) - k)), closed)

    return places(h) if s == 1 else _let(inner, places)


def _whole(h: Column) -> Column:
    return F.array(F.struct(F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)).alias("hash"), F.lit(0).alias("at")))


def _or_whole(h: Column, k: int, s: int, body) -> Column:
    """``body`` of the closed syncmers' places; where there are none, the anchor of all words."""
    return F.when(F.size(h) < k, _whole(h)).otherwise(_let(_closed(h, k, s), lambda at: F.when(F.size(at) == 0, _whole(h)).otherwise(body(at))))


def _anchor(h: Column, k: int):
    return lambda i: F.struct(_hash(h, i, k).alias("hash"), i.alias("at"))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of (hash, at): all closed syncmers of a text, ``at`` being the index of the first word."""
    found = _let(_hashes(text), lambda h: _or_whole(h, k, s, lambda at: F.transform(at, _anchor(h, k))))
    return F.when(_nothing(text), F.expr(f"cast(array() as array<{PLACE}>)")).otherwise(found)


def fingerprint(text: Column, k: int = K, s: int = S, kept: int | None = None) -> Column:
    """Array of (hash, at): all anchors; with ``kept``, so many distinct ones with the smallest hashes (the first place
    of each), by place, for callers that need a bounded sketch.

    The largest hash to keep is found among those below a guess from their number, some half more than are kept; where
    the guess is too low, among all.
    """
    if kept is None:
        return anchors(text, k, s)

    def bound(distinct):
        near = (F.lit(float(-(2**63))) + F.lit(float(2**64)) * (1.5 * kept + 24) / F.size(distinct)).cast("long")
        last = lambda x: F.get(F.sort_array(x), F.lit(kept - 1))
        guess = _let(F.filter(distinct, lambda x: x <= near), lambda few: F.when(F.size(few) >= kept, last(few)).otherwise(last(distinct)))
        return F.when(F.size(distinct) <= kept, F.lit(2**63 - 1)).when(F.size(distinct) <= 2 * kept, last(distinct)).otherwise(guess)

    def choose(hashes, at):
        def of(p):
            kept_ones = F.filter(F.zip_with(hashes, at, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))), lambda a: a["hash"] <= p["bound"])
            first = lambda x: _let(F.transform(x, lambda a: a["hash"]), lambda h: F.filter(x, lambda a, i: F.array_position(h, a["hash"]) == i + 1))
            return F.when(p["repeats"], _let(kept_ones, first)).otherwise(kept_ones)

        return _let(_let(F.array_distinct(hashes), lambda d: F.struct(bound(d).alias("bound"), (F.size(d) < F.size(hashes)).alias("repeats"))), of)

    def found(h):
        return _or_whole(h, k, s, lambda at: _let(F.transform(at, lambda i: _hash(h, i, k)), lambda hashes: choose(hashes, at)))

    return F.when(_nothing(text), F.expr(f"cast(array() as array<{PLACE}>)")).otherwise(_let(_hashes(text), found))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard's index of two texts' distinct anchors."""
    return _let(
        F.struct(F.transform(a, lambda x: x["hash"]).alias("x"), F.transform(b, lambda x: x["hash"]).alias("y")),
        lambda p: F.when((F.size(p["x"]) == 0) & (F.size(p["y"]) == 0), F.lit(1.0))
        .when((F.size(p["x"]) == 0) | (F.size(p["y"]) == 0), F.lit(0.0))
        .otherwise(F.size(F.array_intersect(p["x"], p["y"])) / F.size(F.array_union(p["x"], p["y"]))),
    )


def _first_place(listed: Column, h: Column) -> Column:
    """The first place of a hash in anchors in order of (hash, at), null where it isn't: a binary search."""
    powers = F.array(*[F.lit(1 << i) for i in range(26, -1, -1)])
    less = F.aggregate(powers, F.lit(0), lambda n, p: F.when((n <= F.size(listed) - p) & (F.get(listed, n + p - 1)["hash"] < h), n + p).otherwise(n))
    return _let(less, lambda i: F.when(F.get(listed, i)["hash"] == h, F.get(listed, i)["at"]))


def matched(a: Column, b: Column) -> Column:
    """Array of (at_a, at_b), in order: every place of the anchors that two fingerprints have in common, each with the
    first place of its anchor in the other, so repeated anchors don't make pairs with the square of their number."""
    def joined(p):
        of_a = F.transform(a, lambda x: F.struct(x["at"].alias("at_a"), _first_place(p["b"], x["hash"]).alias("at_b")))
        later_b = F.filter(b, lambda y: _first_place(p["b"], y["hash"]) != y["at"])  # the first ones are in pairs of a
        of_b = F.transform(later_b, lambda y: F.struct(_first_place(p["a"], y["hash"]).alias("at_a"), y["at"].alias("at_b")))
        return F.array_sort(F.concat(F.filter(of_a, lambda x: x["at_b"].isNotNull()), F.filter(of_b, lambda x: x["at_a"].isNotNull())))

    return _let(F.struct(F.array_sort(a).alias("a"), F.array_sort(b).alias("b")), joined)


def shown(f: Column) -> Column:
    """hash@place, comma-joined."""
    return F.array_join(F.transform(f, lambda a: F.concat(F.lpad(F.lower(F.hex(a["hash"])), 16, "0"), F.lit("@"), a["at"].cast("string"))), ",")


def with_next(df: DataFrame, key: str, columns: list[str], made: dict[str, Column] | None = None, blocks: int | None = None) -> DataFrame:
    """All columns of ``df``, those ``made`` of them, and ``next_<c>`` of each of ``columns`` and of those made: its
    value in the next row by key, the first row coming after the last.  What is made is made once a row, after rows
    have moved.

    Rows are dealt by ranges of the key (bounds from quantiles, as many as ``blocks``), each block with the first row
    of the next one, so no task sees all rows and rows move once.  Rows of one key are in order of their other columns'
    hash; a null key comes first.  A key, or null, that holds several quantiles has as many blocks, by ranges of that
    hash.
    """
    spark = df.sparkSession
    reject_clashes(df.columns, ["__block", "__tie", "__own", "__turn", *(made or {}), *(f"next_{c}" for c in [*columns, *(made or {})])])
    blocks = blocks or 4 * partitions(spark)
    bounds, nulls, total = df.agg(F.percentile_approx(key, [i / blocks for i in range(1, blocks)], 10 * blocks), F.count_if(F.col(key).isNull()), F.count("*")).first()
    rows = df.withColumn("__tie", F.xxhash64(*df.columns))
    rows = rows.withColumn("__block", _block(F.col(key), F.col("__tie"), sorted(bounds or []), blocks * nulls // max(1, total)))
    firsts = rows.groupBy("__block").agg(F.min(F.struct(F.col(key).alias("k"), F.col("__tie").alias("t"))).alias("o")).orderBy("__block").collect()  # one row a block
    made = made or {}
    columns = [*columns, *made]
    if not firsts:
        return df.withColumns(made).select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    kind = df.schema[key].dataType.simpleString()
    heads = spark.createDataFrame([(r["__block"], firsts[i - 1]["__block"], r.o.k, r.o.t, i == 0) for i, r in enumerate(firsts)], f"b int, to int, k {kind}, t bigint, turn boolean")
    head = (F.col("__block") == F.col("b")) & F.col(key).eqNullSafe(F.col("k")) & (F.col("__tie") == F.col("t"))
    copies = rows.join(F.broadcast(heads), head).withColumns({"__block": F.col("to"), "__own": F.lit(False), "__turn": F.col("turn")}).drop("b", "to", "k", "t", "turn")
    # A block's own rows come before the copy that follows them, which has a larger key (or the turn).
    order = Window.partitionBy("__block").orderBy("__turn", F.col(key).asc_nulls_first(), F.desc("__own"), "__tie")
    dealt = rows.withColumns({"__own": F.lit(True), "__turn": F.lit(False)}).unionByName(copies)
    dealt = dealt.repartition(partitions(spark), "__block").withColumns(made)
    dealt = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return dealt.where("__own").drop("__block", "__tie", "__own", "__turn")


def _block(c: Column, tie: Column, bounds: list, for_nulls: int) -> Column:
    """The block of a row: how many bounds are at most its key, searched among every w-th bound, then among the w that
    follow.  Where bounds are equal, their key's rows go to the blocks between them by ``tie``; nulls have the first
    ``for_nulls`` blocks and one more."""
    part = lambda n: F.least(F.lit(n - 1), F.floor((tie / F.lit(float(2**64)) + 0.5) * n).cast("int"))
    null_block = part(for_nulls + 1)
    if not bounds:
        return F.when(c.isNull(), null_block).otherwise(for_nulls)
    w = int(len(bounds) ** 0.5) + 1
    listed, coarse = (F.array(*[F.lit(b) for b in x]) for x in (bounds, bounds[::w]))
    start = (F.size(F.filter(coarse, lambda b: b <= c)) - 1) * w
    fine = start + F.size(F.filter(F.slice(listed, start + 1, F.lit(w)), lambda b: b <= c))
    plain = F.when(F.coalesce(c >= bounds[0], F.lit(False)), fine).otherwise(0)
    for b, n in Counter(bounds).items():
        if n > 1:  # few: such a key has several quantiles' rows
            plain = F.when(c == b, bisect_left(bounds, b) + 1 + part(n)).otherwise(plain)
    return F.when(c.isNull(), null_block).otherwise(plain + for_nulls)

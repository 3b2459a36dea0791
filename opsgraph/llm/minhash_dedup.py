"""MinHash near-duplicate detection with min-max hashing.

Each permutation is evaluated once for a shingle and both its smallest and its largest value are kept, so 64
evaluations give 128 signature values.  Bands of four values (of smallest or of largest ones, from four permutations)
make 32 buckets a document: a pair at similarity 0.85 shares none of them with a probability of 6e-11, at 0.8 of 5e-8
(for independent bands).

What is linked is decided on full shingle sets (64-bit hashes of five words each).  Texts of equal sets are one class
and go through its smallest id, so thousands of copies cost one representative.  Within a bucket nobody meets everybody at
first: members are compared with one pivot, and confirmed links are joined into components, which settles most buckets.
Buckets that still hold several components are compared as a whole, in blocks of bounded size, by a product of incidence
matrices of the full sets in numpy that yields links only (one for two components), so that no link is lost and no
pairs are written out.

Scale: shuffled are bands (32 hashes a representative), the texts of bucketed representatives once, and shingle sets
of compared pairs.  Sums by class and by bucket are partial before a shuffle and are written, so that the joins with
them are plain joins of two shuffled sides, which AQE splits where a key is hot.  Intermediate tables go to the shared
folder, most are deleted when nothing reads them any more; nothing is collected.

Defined results: a text without words (null and empty ones too) has no shingles, links with nothing and is kept.  A null
id joins the class of its text without representing it; where a class has no other ids its component is null and the
rows are kept.  Repeated rows have equal results.  Texts of any length are compared whole.  A kept column with the name
of one that is made here is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import column_map, discard, materialise, reject_clashes

#: Words of a shingle, permutations, values of a band.
WORDS, PERMUTATIONS, ROWS = 5, 64, 4
#: A pair is linked when DENOMINATOR * intersection >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 85, 100
#: Bands that a member must share with its pivot to be compared with it at first; at similarity 0.85 some 17 of 32 are
#: shared.  Who shares fewer is left to the comparison of whole buckets.
LEAST_BANDS = 3
#: Members of a bucket, and their shingles, in one block of the comparison of what pivots leave, about; shingles
#: (columns) in one product.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1 << 21, 4096
KEPT_WORDS = 200_000

_random = np.random.Generator(np.random.PCG64(20240607))
_ODD = _random.integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _random.integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2)
_PLACE = _random.integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _random.integers(0, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS and len(word) < 64:
            self[word] = value
        return value


_words = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles, A-Z lower-cased, words apart by ASCII white space; of fewer
    words, the whole sequence as one."""
    listed = (text or "").encode().lower().split()
    if not listed:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, listed), np.uint64, len(listed))
    n = min(WORDS, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _PLACE[k]
    return np.unique(_mixed(total))


def bands(found: np.ndarray) -> np.ndarray:
    """Hashes of the bands of the min-max signature."""
    low = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(found), 256):
        values = (found[i : i + 256, None] ^ _XOR) * _ODD
        np.minimum(low, values.min(0), out=low)
        np.maximum(high, values.max(0), out=high)
    both = np.concatenate((low, high)).reshape(-1, ROWS)
    return _mixed((_mixed(both) * _BAND).sum(1, dtype=np.uint64) + np.arange(len(both), dtype=np.uint64))


def sketches(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, ``keep``, ``n`` (shingles), ``a`` and ``b`` (128-bit hash of the set), ``bands`` (none without shingles)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("id", df.schema[key].dataType)] + [df.schema[k] for k in keep] + [T.StructField(k, T.LongType()) for k in ("n", "a", "b")] + [T.StructField("bands", T.ArrayType(T.LongType()))])

    def convert(texts: pa.Array) -> dict[str, pa.Array]:
        n, a, b, listed = [], [], [], []
        for t in texts.to_pylist():
            found = shingles(t)
            digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
            n.append(len(found))
            a.append(int(digest[0]))
            b.append(int(digest[1]))
            listed.append(bands(found).view(np.int64) if len(found) else np.zeros(0, np.int64))
        return {"n": pa.array(n, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "bands": pa.array(listed, pa.list_(pa.int64()))}

    return df.select(F.col(key).alias("id"), *keep, F.col(text).alias("__text")).mapInArrow(column_map(convert, "__text", to_arrow_schema(schema), ["id", *keep]), schema)


def shingle_sets(df: DataFrame, text: str = "text") -> DataFrame:
    """``id`` and ``shingles`` (array of hashes) of rows with ``id`` and the text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([df.schema["id"], T.StructField("shingles", T.ArrayType(T.LongType()))])

    def convert(texts: pa.Array) -> dict[str, pa.Array]:
        return {"shingles": pa.array([shingles(t).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))}

    return df.select("id", F.col(text).alias("__text")).mapInArrow(column_map(convert, "__text", to_arrow_schema(schema), ["id"]), schema)


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of the ids in links ``x``, ``y``.

    Large-star and small-star in turn until all edges lead to roots: a number of steps in the logarithm of the size.
    """
    edges = materialise(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u > v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        before, edges = edges, materialise(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
        ends = edges.select("u").distinct()
        if ends.count() == edges.count() and edges.join(ends.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _alike(m: Column, n: Column, numerator: int, denominator: int) -> Column:
    """Sizes that allow a link."""
    return F.least(m, n) * denominator >= F.greatest(m, n) * numerator


def _confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs ``x``, ``y`` that are linked: enough bands in common, then the full sets."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("bands").alias(f"bands_{c}"))
    near = pairs.join(side("x"), "x").join(side("y"), "y").where(F.size(F.array_intersect("bands_x", "bands_y")) >= LEAST_BANDS).select("x", "y")
    full = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))
    both = near.join(full("x"), "x").join(full("y"), "y")
    common = F.size(F.array_intersect("set_x", "set_y"))
    return both.where(common * denominator >= (F.size("set_x") + F.size("set_y") - common) * numerator).select("x", "y")


def linked_in_block(ids: np.ndarray, component: np.ndarray, side: np.ndarray, sets: list[np.ndarray], numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Pairs of different components that are linked, by position, one of each two components; ``sets`` are the full
    shingle sets (distinct hashes each).  With two sides, only pairs across."""
    k, sizes = len(sets), np.array([len(t) for t in sets], np.int64)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(k), sizes)
    shared = count[column] > 1  # what one text has alone is common to no pair
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1]))) if len(column) else column
    common = np.zeros((k, k), np.float64)
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + COLUMNS, COLUMNS))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            part = np.zeros((k, COLUMNS), np.float32)
            part[row[a:b], column[a:b] % COLUMNS] = 1
            common += part @ part.T
    # intersection * denominator >= (total - intersection) * numerator
    linked = (numerator + denominator) * common.astype(np.int64) >= numerator * (sizes[:, None] + sizes[None, :])
    linked &= (component[:, None] != component[None, :]) & (ids[:, None] < ids[None, :])
    if (side != side[0]).any():
        linked &= side[:, None] != side[None, :]
    i, j = np.nonzero(linked)
    one = {(min(component[x], component[y]), max(component[x], component[y])): (x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True)}
    return list(one.values())


def _unsettled(members: DataFrame, labels: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links ``x``, ``y`` between components, out of the buckets with several of them."""
    placed = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("c"), F.sum("n").alias("shingles")).where("low < high")
    mixed = materialise(mixed.select("bucket", F.ceil(F.greatest(F.col("c") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "mixed")
    rows = placed.join(mixed, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.select("id", "bucket", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("id", "bucket", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = rows.join(sets, "id")
    kind = sets.schema["id"].dataType.simpleString()

    def compare(group: pa.Table) -> pa.Table:
        shingled, ids = group.column("shingles").combine_chunks(), group.column("id").combine_chunks()
        flat, at = shingled.flatten().to_numpy(), shingled.offsets.to_numpy() - shingled.offsets[0].as_py()
        listed = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        order = np.argsort(np.array(ids.to_pylist()), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        _, component = np.unique(np.array(group.column("component").to_pylist()), return_inverse=True)
        found = linked_in_block(rank, component, group.column("own").to_numpy(), listed, numerator, denominator) if len(ids) > 1 else []
        return pa.table({"x": ids.take(pa.array([x for x, _ in found], pa.int64())), "y": ids.take(pa.array([y for _, y in found], pa.int64()))})

    return rows.groupBy("bucket", "i", "j").applyInArrow(compare, f"x {kind}, y {kind}").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", numerator: int = NUMERATOR, denominator: int = DENOMINATOR, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``keep``, ``n_shingles``, ``component_id`` and ``kept``; one row for each row."""
    reject_clashes(list(keep), ["n_shingles", "component_id", "kept"])
    sketched = materialise(sketches(df, key, text, keep), "sketches")
    reps = sketched.where("n > 0 and id is not null").groupBy("a", "b", "n").agg(F.min("id").alias("id"), F.any_value("bands").alias("bands"))
    reps = materialise(reps, "representatives")
    rows = reps.select("id", "n", F.explode("bands").alias("bucket"))
    shared = materialise(rows.groupBy("bucket").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("p")).where("c > 1").select("bucket", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n")), "shared")
    members = materialise(rows.join(shared, "bucket"), "buckets")
    bucketed = members.select("id").distinct()
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    sets = materialise(shingle_sets(texts.join(bucketed.hint("shuffle_hash"), "id")), "sets")
    met = members.where("id <> pivot").where(_alike(F.col("n"), F.col("pivot_n"), numerator, denominator)).select(F.col("pivot").alias("x"), F.col("id").alias("y")).distinct()
    links = materialise(_confirmed(met, reps, sets, numerator, denominator), "links")
    labels = materialise(components(links), "components")
    left = materialise(_unsettled(members.select("id", "n", "bucket"), labels, sets, numerator, denominator), "unsettled")
    if not left.isEmpty():
        labels = materialise(components(links.unionByName(left)), "components")
    discard(shared, members, sets, links, left)
    out = sketched.join(reps.select("a", "b", F.col("n").alias("rep_n"), F.col("id").alias("rep")), ["a", "b"], "left").withColumn("rep", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("rep")))
    out = out.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("rep", F.coalesce("component", "rep"))
    return out.select(F.col("id").alias(key), *keep, F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"), F.coalesce(F.col("id") == F.col("rep"), F.col("rep").isNull()).alias("kept"))

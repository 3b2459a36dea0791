"""Shuffling into shards in two passes, as an external shuffle.

First pass: every record goes to a bucket by a seeded hash of its columns, so many buckets that each fits into memory
(bounded in bytes and in records).  Second pass: each bucket is shuffled by Fisher-Yates, whose draws are seeded hashes
of bucket and step, from an order that a hash of the records fixes.  The buckets one after the other are then a random
order of all records; the record at position p goes to shard ``p mod shards`` as number ``p div shards``, so row counts
differ by one at most and numbers have no gaps.  Where buckets begin follows from their row counts alone.

DataFrame functions only.  The order depends on the seed and the records, not on how they are partitioned.  Exact
copies would all share a hash, and a bucket: contents with more copies than a part of a bucket should hold are counted
before anything moves, each content moves once with its count, and its copies are dealt by content and number.  All
other texts move once.

Defined results: null keys and texts are values like others, empty texts count a fixed overhead, an empty table gives
no rows, repeated rows each have their own place.  A column of the input with the name of one that is made here is an
error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import let, materialise, partitions, reject_clashes, text_of

#: Bytes of text and records in a bucket, about; a bucket's permutation costs the square of its records in copied places.
BUCKET_BYTES, BUCKET_ROWS = 8 << 20, 2048
#: Share of a bucket that copies of one content may take before they are dealt by number.
COPIES_SHARE = 4
#: Bytes that one reducer should get, about.
REDUCER_BYTES = 256 << 20
#: Buckets whose offsets one task sums up, copies in one step of dealing them out, and contents that are broadcast at most.
BLOCK, COPIES, BROADCAST_CONTENTS = 1024, 4096, 100_000


def _offsets(counts: DataFrame) -> DataFrame:
    """``bucket`` and ``offset``, the rows in buckets before it: sums by block of buckets, then within the block."""
    counts = counts.withColumn("block", F.floor(F.col("bucket") / BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a thousandth of the buckets
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(blocks, "block").select("bucket", (F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("offset"))


def _bucket(buckets: int, seed: int, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(buckets))


def permutation(n: Column, bucket: Column, seed: int) -> Column:
    """Numbers 0 to n - 1 by Fisher-Yates from the inside out: step i puts i at a drawn place j up to i, and what was
    there at the end."""

    def step(made, i):
        def put(j):
            return F.when(j == i, F.concat(made, F.array(i))).otherwise(F.concat(F.slice(made, F.lit(1), j), F.array(i), F.slice(made, j + 2, i - j - 1), F.array(F.get(made, j))))

        return let(F.pmod(F.xxhash64(F.lit(seed), bucket, i), (i + 1).cast("long")).cast("int"), put)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.expr("cast(array() as array<int>)"), step)


def _hashable(kind) -> bool:
    return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()


def shard_records(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0 without gaps in each shard)."""
    reject_clashes(df.columns, ["shard", "slot"])
    names = df.columns
    size = (F.octet_length(text_of(text)) + 64).cast("long")
    content = F.xxhash64(F.lit(seed), *[F.col(key), F.col(text)], *[F.col(f.name) for f in df.schema if f.name not in (key, text) and _hashable(f.dataType)])
    hashed = df.select(content.alias("content"), size.alias("size"))
    counted = materialise(hashed.groupBy("content").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "contents")
    rows, total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_bytes), -(-rows // BUCKET_ROWS))
    many = (F.col("n") > BUCKET_ROWS // COPIES_SHARE) | ((F.col("n") > COPIES_SHARE) & (F.col("bytes") > bucket_bytes // COPIES_SHARE))
    hot = counted.where(many)
    n_hot = hot.count()  # at most as many as there are parts of buckets
    counts = counted.where(~many).select(_bucket(buckets, seed, F.col("content")).alias("bucket"), "n")
    records = df.select(content.alias("content"), F.struct(*names).alias("row"))
    if n_hot:
        marked = hot.select("content", F.lit(True).alias("hot"))
        records = records.join(F.broadcast(marked) if n_hot <= BROADCAST_CONTENTS else marked, "content", "left")
        copies = materialise(records.where("hot").groupBy("content", "row").agg(F.count("*").alias("n")), "copies")
        copies = _dealt(copies, buckets, seed)
        counts = counts.unionByName(copies.groupBy("bucket").agg(F.count("*").alias("n")))
        records = records.where("hot is null").select(_bucket(buckets, seed, F.col("content")).alias("bucket"), F.xxhash64(F.lit(seed + 1), "content").alias("order"), "row").unionByName(copies.select("bucket", "order", "row"))
    else:
        records = records.select(_bucket(buckets, seed, F.col("content")).alias("bucket"), F.xxhash64(F.lit(seed + 1), "content").alias("order"), "row")
    offsets = materialise(_offsets(counts.groupBy("bucket").agg(F.sum("n").alias("n"))), "offsets")
    reducers = max(partitions(df.sparkSession), -(-total // REDUCER_BYTES))
    packed = records.repartition(int(min(reducers, max(buckets, partitions(df.sparkSession)))), "bucket").groupBy("bucket").agg(F.collect_list(F.struct("order", "row")).alias("records"))
    # The order in which records arrive isn't fixed: a hash of the record sorts them first.
    packed = packed.withColumn("records", F.array_sort("records", lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0)))
    packed = packed.withColumn("places", permutation(F.size("records"), F.col("bucket"), seed + 2))
    packed = packed.withColumn("records", F.arrays_zip("records", "places"))
    placed = packed.join(F.broadcast(offsets) if buckets <= 4096 else offsets, "bucket").select("offset", F.explode("records").alias("r"))
    position = F.col("offset") + F.col("r.places")
    return placed.select("r.records.row.*", F.pmod(position, F.lit(shards)).cast("int").alias("shard"), F.floor(position / shards).cast("long").alias("slot"))


def _dealt(copies: DataFrame, buckets: int, seed: int) -> DataFrame:
    """A row for each copy of ``copies`` (content, row, n): its number decides its bucket, with the content.

    Numbers are made in two steps, so no array is longer than some thousands and the second step is spread."""
    parts = copies.select("content", "row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("part"))
    parts = parts.repartition(partitions(copies.sparkSession), "content", "part") if copies.agg(F.max("n")).first()[0] > COPIES else parts
    numbered = parts.select("content", "row", F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1)).alias("number"))
    return numbered.select(_bucket(buckets, seed, F.col("content"), F.col("number")).alias("bucket"), F.xxhash64(F.lit(seed + 1), "content", "number").alias("order"), "row")


def write_shards(df: DataFrame, path: str, **parameters) -> None:
    """The records of :func:`shard_records` as Parquet, a folder a shard, each sorted by slot (files by ranges of
    slots, so records move once more)."""
    out = shard_records(df, **parameters)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

"""Exact-substring dedup: bytes covered by a string of 200 bytes that starts anywhere else too are removed.

Suffix arrays over all bytes would cost more than the work needs, since most windows of 200 bytes are unique.  So the
text is cut by content first.  Each window has an anchor, the 32-byte string in it with the smallest hash; equal
windows have equal anchors at equal places.  Windows in a row with one anchor make a context (their bytes together).
An anchor that occurs once rules out all its windows.  A context that occurs twice is repeated as a whole.  What is
left are anchors with several different contexts: one copy of each goes to a shard by its anchor, and the shard's
suffix array (Larsson-Sadakane refinement in numpy) with Kasai's common prefixes says which windows repeat.

An anchor with more contexts than a shard should hold is spread over shards by context.  Each of them reports the
windows that repeat in it, and a hash of every distinct window; those that several shards report repeat as well.
(Searching each shard's array for the windows of every other one would grow with the square of the shards.)

Scale: anchors and contexts move as hashes, partly summed before the shuffle; texts move once for the contexts to
compare and once for the result.  What is summed by anchor is written before it is joined, so that such a join is one of
two shuffled sides and AQE splits the anchors that much of the corpus has.  Shards are bounded in contexts, whatever the
input.  Intervals are merged by stretches of a text before a text's are brought together.  Matches never cross documents.

Defined results: null and empty texts have no bytes and nothing removed; texts below 200 bytes stay whole.  Rows of
one id and text are told apart (each repeats the other), rows of one id and different texts too: a row is known by a
64-bit hash of both and a checksum of the text.  Very long texts are cut into contexts in segments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, materialise, partitions, reject_clashes, text_of

#: Bytes of a repeated string and of an anchor.
LENGTH, ANCHOR = 200, 32
#: Different contexts of one anchor in one shard at most, before it is spread; contexts in a shard, about.
SPREAD, SHARD = 4096, 2048

_random = np.random.Generator(np.random.PCG64(77))
_BYTE = _random.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes: differences of prefix sums, each divided by the power of its place."""
    n = len(data)
    if len(_powers[0]) < n + 1:
        for k, base in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, 1 << 16), base))), dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers[0][:n], out=sums[1:])
    return _mixed((sums[size:] - sums[:-size]) * _powers[1][: n - size + 1])


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` keys in a row: of the suffix of one block and the prefix of the next."""
    count = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


#: Low bits of a hash that give way to the place when the leftmost of the least is sought, the same for all texts; texts
#: are cut in segments of half as many places.
PLACE_BITS = 26


def contexts(data: bytes, length: int = LENGTH, anchor: int = ANCHOR, segment: int = 1 << (PLACE_BITS - 1)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, size, anchor hash and context hash of each context of a text, by start."""
    parts = [_segment(data, begin, min(len(data), begin + segment + length - 1), length, anchor) for begin in range(0, max(1, len(data) - length + 1), segment)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _segment(data: bytes, begin: int, end: int, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of the windows that lie between two places."""
    none = np.zeros(0, np.int64)
    if end - begin < length:
        return none, none, none, none
    grams = _rolling(np.frombuffer(data, np.uint8)[begin:end], anchor)
    width = length - anchor + 1
    low = np.uint64((1 << PLACE_BITS) - 1)
    # The place in the low bits makes the leftmost the least of equals; all texts lose the same bits, so equal windows
    # choose alike.
    at = (_sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), width) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    size = np.diff(np.concatenate((first, [len(at)]))) + length - 1
    anchors = grams[at[first]].view(np.int64)
    first += begin
    view = memoryview(data)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(first.tolist(), (first + size).tolist(), strict=True)), np.uint64, len(first))
    return first, size, anchors, hashed.view(np.int64)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes in order: Larsson-Sadakane refinement, doubling the sorted depth and sorting only groups that aren't
    single yet."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data.astype(np.uint64) + np.uint64(1)
    # Seven bytes at 9 bits each make the first key.
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : k + n]
    order = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # the first place of the group
    h = 7
    while True:
        starts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate((starts, [n])))
        open_places = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(open_places):
            break
        suffix = order[open_places]
        # Of equal first h bytes, the rank of what follows decides.
        pair = (rank[suffix].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(suffix + h, n)] + 1).astype(np.uint64)
        by = np.argsort(pair)
        order[open_places], pair = suffix[by], pair[by]
        split = np.concatenate(([True], pair[1:] != pair[:-1]))
        new[open_places] = split
        rank[order[open_places]] = open_places[np.maximum.accumulate(np.where(split, np.arange(len(split)), 0))]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, lanes: np.ndarray, limit: int) -> np.ndarray:
    """Kasai: by place in the text, the bytes (``limit`` at most) that a suffix has in common with the one before it in
    order.  One text position after the other, starting from the length found before less one; ``lanes`` are starts
    of parts that are treated side by side, each in order."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate((data.astype(np.int16), np.full(limit + 9, -1, np.int16)))
    eight = np.zeros(n + 1, np.uint64)  # eight bytes from each place on
    for k in range(8):
        eight[:n] = (eight[:n] << np.uint64(8)) | np.maximum(padded[k : k + n], 0).astype(np.uint64)
    out = np.zeros(n, np.int64)
    ends = np.concatenate((lanes[1:], [n]))
    place, have = lanes.copy(), np.zeros(len(lanes), np.int64)
    while len(place):
        other = before[place]
        have[other < 0] = 0
        for step in (8, 1):
            live = np.flatnonzero((other >= 0) & (have < limit))
            while len(live):
                i, j, h = place[live], other[live], have[live]
                # Suffixes differ at the end of the text at the latest.
                more = np.maximum(i, j) + h + step <= n
                i, j = np.minimum(i + h, n), np.minimum(j + h, n)
                more &= eight[i] == eight[j] if step == 8 else padded[i] == padded[j]
                live = live[more]
                have[live] += step
                live = live[have[live] < limit]
        np.minimum(have, limit, out=have)
        out[place] = have
        have = np.maximum(have - 1, 0)
        place = place + 1
        on = place < ends
        place, ends, have = place[on], ends[on], have[on]
    return out


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each part, the starts of the windows that another window of the parts equals."""
    sizes = np.array([len(p) for p in parts], np.int64)
    lanes = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(parts), np.uint8)
    if not len(data):
        return [np.zeros(0, np.int64) for _ in parts]
    order = suffix_array(data)
    common = common_prefixes(data, order, lanes, length)
    # Suffixes in a row with so much in common begin with one string; only windows that end in their part count.
    group = np.cumsum(common[order] < length)
    within = np.repeat(lanes + sizes, sizes) - np.arange(len(data)) >= length
    again = np.zeros(len(data), bool)
    again[order] = np.bincount(group, within[order])[group] > 1
    again &= within
    return [np.flatnonzero(again[a : a + s]) for a, s in zip(lanes.tolist(), sizes.tolist(), strict=True)]


INTERVAL = "id bigint, part int, start int, size int"


def _row_id(key: str, text: str) -> list[Column]:
    """``id`` and ``part``: a hash of key and text, and a checksum of the text."""
    return [F.xxhash64(F.col(key), F.col(text)).alias("id"), (F.crc32(text_of(text).cast("binary")) - (1 << 31)).cast("int").alias("part")]


def _occurrences(texts: DataFrame) -> DataFrame:
    """``id``, ``part``, ``start``, ``size``, ``anchor``, ``context`` of every context."""

    def run(batches):
        names = ["id", "part", "start", "size", "anchor", "context"]
        for batch in batches:
            made: list[tuple] = []
            rows = 0
            for i, k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                start, size, anchor, context = contexts((text.as_py() or "").encode())
                if len(start):
                    made.append((np.full(len(start), i, np.int64), np.full(len(start), k, np.int32), start.astype(np.int32), size.astype(np.int32), anchor, context))
                    rows += len(start)
                if rows > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], names)
                    made, rows = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], names)

    return texts.mapInArrow(run, "id bigint, part int, start int, size int, anchor bigint, context bigint")


def _bodies(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """``wanted`` contexts (``id``, ``part``, ``parts``: array of anchor, context, n, c, start, size) with their bytes."""
    schema = "id bigint, part int, start int, anchor bigint, context bigint, n bigint, c bigint, body binary"

    def run(batches):
        names = ["id", "part", "start", "anchor", "context", "n", "c", "body"]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for i, k, text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                data = (text.as_py() or "").encode()
                for p in parts.as_py():
                    for column, value in zip(columns, (i, k, p["start"], p["anchor"], p["context"], p["n"], p["c"], data[p["start"] : p["start"] + p["size"]]), strict=True):
                        column.append(value)
                if len(columns[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BODY, strict=True)], names)
                    columns = [[] for _ in names]
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BODY, strict=True)], names)

    return texts.join(wanted.hint("shuffle_hash"), ["id", "part"]).select("id", "part", "text", "parts").mapInArrow(run, schema)


_BODY = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """First byte and size of what windows at these starts cover, runs of starts together."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    first, last = starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))]
    return list(zip(first.tolist(), (last - first + length).tolist(), strict=True))


def _in_shard(group: pa.Table) -> pa.Table:
    """Repeated windows of the contexts of a shard."""
    parts, n, ids, at = (group.column(k).to_pylist() for k in ("body", "n", "id", "start"))
    rows = [(i, p, s + a, size) for i, p, s, k, found in zip(ids, group.column("part").to_pylist(), at, n, repeated_starts(parts), strict=True) if k == 1 for a, size in _runs(found, LENGTH)]
    return _table(rows, [("id", pa.int64()), ("part", pa.int32()), ("start", pa.int32()), ("size", pa.int32())])


def _table(rows: list[tuple], schema: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(schema, columns, strict=True)})


_SPREAD = [("anchor", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("id", pa.int64()), ("part", pa.int32()), ("start", pa.int32()), ("size", pa.int32())]


def _in_spread_shard(group: pa.Table) -> pa.Table:
    """The same for a part of an anchor's contexts: repeated windows (without hashes), and hashes of all distinct
    windows, with a place where the window repeats only if another shard has it (without one otherwise)."""
    parts, n, ids, own, at = (group.column(k).to_pylist() for k in ("body", "n", "id", "part", "start"))
    anchor = group.column("anchor")[0].as_py()
    rows, told = [], set()
    for i, o, s, k, body, found in zip(ids, own, at, n, parts, repeated_starts(parts), strict=True):
        here = set(found.tolist())
        rows += [(anchor, None, None, i, o, s + a, size) for a, size in _runs(found, LENGTH)] if k == 1 else []
        for p in range(len(body) - LENGTH + 1):
            digest = xxhash.xxh3_128_digest(body[p : p + LENGTH])
            if k == 1 and p not in here:
                rows.append((anchor, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), i, o, s + p, LENGTH))
            elif digest not in told:
                told.add(digest)
                rows.append((anchor, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), None, None, None, None))
    return _table(rows, _SPREAD)


def repeated_intervals(texts: DataFrame) -> DataFrame:
    """``id``, ``part``, ``start``, ``size`` of the bytes to remove (intervals may overlap) from ``texts`` (``id``,
    ``part``, ``text``)."""
    occurrences = _occurrences(texts)
    repeated = materialise(occurrences.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "repeated")
    again = materialise(occurrences.join(repeated, "anchor"), "anchors")
    distinct = again.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "part", "start", "size")).alias("one"))
    distinct = materialise(distinct.select("anchor", "context", "n", "one.*"), "contexts")
    whole = materialise(again.join(distinct.where("n > 1").select("anchor", "context"), ["anchor", "context"]).select("id", "part", "start", "size"), "whole")
    several = materialise(distinct.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1"), "several")
    wanted = distinct.join(several, "anchor").groupBy("id", "part").agg(F.collect_list(F.struct("anchor", "context", "n", "c", "start", "size")).alias("parts"))
    bodies = materialise(_bodies(wanted, texts), "bodies")
    discard(repeated, again, distinct, several)
    few, many = bodies.where(F.col("c") <= SPREAD), bodies.where(F.col("c") > SPREAD)
    shards = max(1, partitions(texts.sparkSession), few.count() // SHARD)
    found = few.groupBy(F.pmod("anchor", F.lit(shards)).alias("shard")).applyInArrow(_in_shard, INTERVAL)
    spread = many.groupBy("anchor", F.pmod("context", F.ceil(F.col("c") / SPREAD)).alias("shard")).applyInArrow(_in_spread_shard, "anchor bigint, a bigint, b bigint, id bigint, part int, start int, size int")
    spread = materialise(spread, "windows")
    hashed = spread.where("a is not null")
    in_several = hashed.groupBy("anchor", "a", "b").agg(F.count("*").alias("k")).where("k > 1").select("anchor", "a", "b")
    across = hashed.where("id is not null").join(in_several, ["anchor", "a", "b"]).select("id", "part", "start", "size")
    return whole.unionByName(found).unionByName(spread.where("a is null").select("id", "part", "start", "size")).unionByName(across)


#: Bytes of a text whose intervals are merged at first.
STRETCH = 1 << 16


def _merged(listed: list[tuple[int, int]]) -> list[list[int]]:
    """Intervals (start, end) apart and in order."""
    out: list[list[int]] = []
    for start, end in sorted(listed):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def merged_intervals(intervals: DataFrame) -> DataFrame:
    """``id``, ``part``, ``intervals`` (array of start, end): those that start in one stretch of a text are merged, then
    brought together, so a run that repeats at every byte is an interval a stretch."""
    stretches = intervals.groupBy("id", "part", F.floor(F.col("start") / STRETCH).alias("stretch")).agg(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))).alias("listed"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            made = [[{"start": a, "end": b} for a, b in _merged([(x["start"], x["end"]) for x in listed.as_py()])] for listed in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, kind)], ["id", "part", "listed"])

    made = stretches.select("id", "part", "listed").mapInArrow(run, "id bigint, part int, listed array<struct<start:int,end:int>>")
    return made.groupBy("id", "part").agg(F.flatten(F.collect_list("listed")).alias("intervals"))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes``, ``removed`` (array of start, end in bytes, apart and in order), ``kept`` (the bytes left);
    one row for each row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    reject_clashes([key], ["n_bytes", "removed", "kept"])
    texts = df.select(*_row_id(key, text), F.col(text).alias("text"))
    listed = materialise(merged_intervals(repeated_intervals(texts)), "intervals")
    rows = df.select(F.col(key).alias("key"), *_row_id(key, text), F.col(text).alias("text")).join(listed, ["id", "part"], "left").select("key", "text", "intervals")
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *T.StructType.fromDDL("n_bytes bigint, removed array<struct<start:int,end:int>>, kept binary")])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            total = 0
            for i, t, cuts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = (t.as_py() or "").encode()
                removed = _merged([(c["start"], c["end"]) for c in cuts.as_py() or []])
                edges = [0, *(x for r in removed for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for column, value in zip(columns, (i, len(data), [{"start": a, "end": b} for a, b in removed], kept), strict=True):
                    column.append(value)
                total += len(data)
                if total > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
                    columns, total = [[], [], [], []], 0
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)

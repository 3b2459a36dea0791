"""Ranking and reachability: personalized PageRank, shortest paths, connected components, communities.

Each is a loop over DataFrames on the driver; a step is joins and grouped sums, and every step (or few) is written
to the shared checkpoint folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import scratch_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that driver and executors share."""
    scratch_folder(df.sparkSession)
    return df.checkpoint()


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: list[str], damping: float = 0.85, steps: int = 20, tolerance: float | None = None, top: int | None = None) -> DataFrame:
    """``key``, ``score``: personalized PageRank over out-edges (parallel ones add up), dangling mass going back to the
    seeds, from a uniform start, ``steps`` times or until the change is below ``tolerance`` a node.

    Seeds that aren't nodes are left out; without any seed the result is empty.  ``seeds`` is a question's, a handful.
    """
    start = nodes.where(F.col("key").isin(seeds)).select("key").distinct()
    given = start.count()
    total = nodes.select("key").distinct().count()
    if not given:
        return nodes.select("key", F.lit(0.0).alias("score")).limit(0)
    degree = edges.groupBy("source").agg(F.count("*").alias("out"))
    weights = checkpointed(edges.groupBy("source", "target").agg(F.count("*").alias("w")).join(degree, "source").select("source", "target", (F.col("w") / F.col("out")).alias("share")))
    state = nodes.select("key").distinct().join(start.withColumn("home", F.lit(1.0 / given)), "key", "left").select("key", F.coalesce("home", F.lit(0.0)).alias("home"))
    state = state.join(degree.select(F.col("source").alias("key"), F.lit(True).alias("has_out")), "key", "left").select("key", "home", F.coalesce("has_out", F.lit(False)).alias("has_out"))
    state = checkpointed(state.withColumn("score", F.lit(1.0 / total)))
    for step in range(steps):
        dangling = state.where("not has_out").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("dangling"))  # one row
        sent = weights.join(state.select(F.col("key").alias("source"), "score"), "source").groupBy(F.col("target").alias("key")).agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        new = state.join(sent, "key", "left").crossJoin(F.broadcast(dangling)).select("key", "home", "has_out", (damping * (F.coalesce("got", F.lit(0.0)) + F.col("dangling") * F.col("home")) + (1 - damping) * F.col("home")).alias("score"), F.col("score").alias("old"))
        new = checkpointed(new)
        state = new.drop("old")
        if tolerance is not None and new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] < total * tolerance:
            break
    out = state.select("key", "score")
    return out.orderBy(F.desc("score"), "key").limit(top) if top else out


def distances(edges: DataFrame, sources: list[str], most: int = 6) -> DataFrame:
    """``key``, ``distance``, ``parent`` by undirected breadth-first search from the sources, up to ``most`` edges.

    Of parents at the same distance the smallest key counts."""
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).where("a <> b").distinct()
    spark = edges.sparkSession
    seen = spark.createDataFrame([(s, 0, None) for s in dict.fromkeys(sources)], "key string, distance int, parent string")
    front = seen
    for step in range(1, most + 1):
        front = both.join(front.select(F.col("key").alias("a")), "a").groupBy(F.col("b").alias("key")).agg(F.min("a").alias("parent")).join(seen.select("key"), "key", "left_anti")
        front = checkpointed(front.select("key", F.lit(step).alias("distance"), "parent"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, source: str, target: str, most: int = 6) -> list[tuple[str, str, str]]:
    """(from, edge type, to) along a shortest path of 1 to ``most`` edges, empty if there is none.  Between a pair, an
    edge in the path's direction is named before one against it."""
    found = distances(edges, [source], most)
    path, at = [], target
    while at != source:
        row = found.where(F.col("key") == at).select("parent").first()
        if row is None or row.parent is None:
            return []
        pair = edges.where(((F.col("source") == row.parent) & (F.col("target") == at)) | ((F.col("source") == at) & (F.col("target") == row.parent)))
        kind = pair.orderBy((F.col("source") != row.parent).cast("int"), "type").first()["type"]
        path.append((row.parent, kind, at))
        at = row.parent
    return path[::-1]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``key``, ``component``: the smallest key reachable over undirected edges.

    Labels pass to neighbours and then to what they point to, so the steps grow with the logarithm of the diameter.
    """
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()
    labels = checkpointed(nodes.select("key", F.col("key").alias("component")).distinct())
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "component"), "b").groupBy(F.col("a").alias("key")).agg(F.min("component").alias("near"))
        new = labels.join(near, "key", "left").select("key", "component", F.least("component", F.coalesce("near", "component")).alias("now"))
        jump = new.select(F.col("key").alias("now"), F.col("now").alias("further"))
        new = checkpointed(new.join(jump, "now", "left").select("key", "component", F.least("now", F.coalesce("further", "now")).alias("now")))
        changed = not new.where("now <> component").isEmpty()
        labels = new.select("key", F.col("now").alias("component"))
        if not changed:
            return labels


def communities(nodes: DataFrame, edges: DataFrame, steps: int = 10, levels: int = 1) -> DataFrame:
    """``key``, ``community`` by moving nodes where modularity grows most, as Louvain's method does: a node goes to the
    community with the largest 2m * (edges to it) - degree * (its degrees), if that is more than where it is (of equals
    the smallest label).  Each further level takes the communities as nodes, their edges added up, and moves those; it
    ends after ``levels``, or at a level that moves nothing.  Loops are left out."""
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("w"))
    degree = both.groupBy("a").agg(F.sum("w").alias("k")).select(F.col("a").alias("key"), "k")
    labels = checkpointed(nodes.select("key", F.col("key").alias("community")).distinct().join(degree, "key", "left").select("key", "community", F.coalesce("k", F.lit(0)).alias("k")))
    doubled = labels.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    out = None
    for _ in range(levels):
        moved = _moved(both, labels, doubled, steps)
        higher = moved.select(F.col("key").alias("community"), F.col("community").alias("now"))
        out = moved.select("key", "community") if out is None else checkpointed(out.join(higher, "community").select("key", F.col("now").alias("community")))
        if levels == 1 or moved.where("key <> community").isEmpty():
            break
        end = lambda c: moved.select(F.col("key").alias(c), F.col("community").alias(f"{c}_now"))  # noqa: E731, B023
        both = both.join(end("a"), "a").join(end("b"), "b").where("a_now <> b_now").groupBy(F.col("a_now").alias("a"), F.col("b_now").alias("b")).agg(F.sum("w").alias("w"))
        both = checkpointed(both)
        labels = checkpointed(moved.groupBy("community").agg(F.sum("k").alias("k")).select(F.col("community").alias("key"), "community", "k"))
    return out


def _moved(both: DataFrame, labels: DataFrame, doubled: int, steps: int) -> DataFrame:
    """``labels`` (key, community, k: its degree) after the moves of one level, over the edges ``both`` (a, b, w: both
    directions, no loops) of a graph whose degrees sum up to ``doubled``.

    In each step another half of the nodes may move (by a digit of the key's MD5), so that neighbours don't swap places
    for ever.  It ends when no node would move, or after ``steps``."""
    for step in range(steps):
        turn = lambda c, step=step: F.conv(F.substring(F.md5(c), step % 32 + 1, 1), 16, 10).cast("int") % 2 == 0
        new = checkpointed(_wishes(both, labels, doubled, turn))
        settled = new.where("moves").isEmpty() and _wishes(both, labels, doubled, lambda c, turn=turn: ~turn(c)).where("moves").isEmpty()
        labels = new.drop("moves")
        if settled:
            break
    return labels


def _wishes(both: DataFrame, labels: DataFrame, doubled: int, turn) -> DataFrame:
    """``labels`` after the nodes whose turn it is went where they gain most, and ``moves``, whether a node did.

    A community's sum goes with its nodes' labels, and only neighbours whose turn it is are told; what they are told
    moves once, by node, for both sums that follow."""
    totals = labels.groupBy("community").agg(F.sum("k").alias("total"))
    summed = labels.join(totals, "community").select("key", "community", "k", "total")
    told = both.where(turn(F.col("a"))).join(summed.select(F.col("key").alias("b"), "community", "total"), "b")
    none = F.lit(None)
    heard = told.select(F.col("a").alias("key"), "community", "w", "total", none.cast("bigint").alias("k"), none.cast("boolean").alias("stays"))
    own = summed.select("key", "community", F.lit(0).cast("bigint").alias("w"), "total", "k", F.lit(True).alias("stays"))
    votes = heard.unionByName(own).repartition("key").groupBy("key", "community").agg(F.sum("w").alias("w"), F.first("total").alias("total"), F.max("k").alias("k"), F.max("stays").alias("stays"))
    node = Window.partitionBy("key")
    gains = votes.select("key", "community", "w", "total", F.coalesce("stays", F.lit(False)).alias("stays"), F.max("k").over(node).alias("k"))
    gain = doubled * F.col("w") - F.col("k") * (F.col("total") - F.when(F.col("stays"), F.col("k")).otherwise(0))
    best = gains.groupBy("key", "k").agg(F.min(F.struct((-gain).alias("minus"), (~F.col("stays")).alias("away"), "community")).alias("best"))
    return best.select("key", F.col("best.community").alias("community"), "k", F.col("best.away").alias("moves"))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Newman's modularity of an undirected graph's communities (``key``, ``community``); loops are left out."""
    inside = edges.where("source <> target").select("source", "target")
    at = lambda c: labels.select(F.col("key").alias(c), F.col("community").alias(f"{c}_community"))
    ends = inside.join(at("source"), "source").join(at("target"), "target")
    same = ends.agg(F.count("*").alias("m"), F.count_if(F.col("source_community") == F.col("target_community")).alias("same")).first()
    if not same.m:
        return 0.0
    degree = ends.select(F.explode(F.array("source_community", "target_community")).alias("c")).groupBy("c").agg(F.count("*").alias("d"))
    return same.same / same.m - degree.agg(F.sum((F.col("d") / (2.0 * same.m)) ** 2)).first()[0]


def describe(members: DataFrame) -> DataFrame:
    """Of rows ``community``, ``type``, ``label``: id by size (largest first), size, summary (types sorted, six labels
    of each, distinct and sorted)."""
    by_type = members.groupBy("community", "type").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set("label")), 1, 6).alias("labels"))
    text = by_type.groupBy("community").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("type", "labels"))).alias("parts"))
    summary = F.array_join(F.transform("parts", lambda p: F.concat(p["type"], F.lit(": "), F.array_join(p["labels"], ", "))), "; ")
    return text.select(F.row_number().over(Window.orderBy(F.desc("size"), "community")).alias("id"), "community", "size", summary.alias("summary"))

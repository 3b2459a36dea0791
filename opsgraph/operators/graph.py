"""The property graph as two DataFrames: nodes and edges, with MERGE, summaries, neighbourhoods and snapshots.

``nodes``: key, type, props (map), provenance (array), doc_ids (array), ord.  ``edges``: source, type, target,
provenance, ord.  ``ord`` is the order of insertion; it settles every tie that insertion order would.  Rows of several
versions also have ``version``, which comes before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROVENANCE = "struct<doc_id:string,extractor:string,confidence:double,page:int,row:int,bbox:array<double>,evidence_span:string>"
_STAMP = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.StringType()), ("extractor", T.StringType()), ("confidence", T.DoubleType()), ("page", T.IntegerType()), ("row", T.IntegerType()), ("bbox", T.ArrayType(T.DoubleType())), ("evidence_span", T.StringType()))]
)
_S = T.StringType()
NODES = T.StructType([T.StructField(n, t) for n, t in (("key", _S), ("type", _S), ("props", T.MapType(_S, _S)), ("provenance", T.ArrayType(_STAMP)), ("doc_ids", T.ArrayType(_S)), ("ord", T.LongType()))])
EDGES = T.StructType([T.StructField(n, t) for n, t in (("source", _S), ("type", _S), ("target", _S), ("provenance", T.ArrayType(_STAMP)), ("ord", T.LongType()))])
_VERSION = T.StructField("version", T.LongType())


def provenance(doc_id: Column, extractor: str, confidence: float | Column | None = None, page: Column | None = None, row: Column | None = None, span: Column | None = None, bbox: Column | None = None) -> Column:
    """One stamp: confidence to three places, evidence cut to 120 characters."""
    c = F.lit(confidence).cast("double") if not isinstance(confidence, Column) else confidence.cast("double")
    return F.struct(
        doc_id.cast("string").alias("doc_id"), F.lit(extractor).alias("extractor"), F.round(c, 3).alias("confidence"), (page if page is not None else F.lit(None)).cast("int").alias("page"),
        (row if row is not None else F.lit(None)).cast("int").alias("row"), (bbox if bbox is not None else F.lit(None)).cast("array<double>").alias("bbox"), F.substring(span if span is not None else F.lit(None).cast("string"), 1, 120).alias("evidence_span"),
    )


def _turn(rows: DataFrame) -> list[str]:
    """What rows are ordered by."""
    return ["version", "ord"] if "version" in rows.columns else ["ord"]


def merge_nodes(*parts: DataFrame) -> DataFrame:
    """MERGE: of each property the first value that isn't empty, by ``ord``; type of the first row; provenance all in
    order (a bag); document ids sorted and distinct.

    Values are grouped by (key, property) with partial minima; nothing is collected but a node's own provenance.
    """
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    turn = _turn(rows)
    values = rows.select("key", *turn, F.explode_outer("props").alias("p", "v")).where("p is not null").groupBy("key", "p").agg(F.min(F.when(F.coalesce("v", F.lit("")) != "", F.struct(*turn, "v"))).alias("best"))
    props = values.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p", F.col("best.v").alias("v"))))).alias("props"))
    whole = rows.groupBy("key").agg(
        F.min(F.struct(*turn, "type")).alias("first"),
        F.sort_array(F.collect_list(F.struct(*turn, "provenance"))).alias("stamps"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.concat(F.coalesce("doc_ids", F.expr("array()")), F.coalesce(F.transform("provenance", lambda x: x["doc_id"]), F.expr("array()"))))))).alias("doc_ids"),
    )
    return whole.join(props, "key", "left").select(
        "key", F.col("first.type").alias("type"), F.coalesce("props", F.expr("cast(map() as map<string,string>)")).alias("props"), F.flatten(F.transform("stamps", lambda s: F.coalesce(s["provenance"], F.expr(f"cast(array() as array<{PROVENANCE}>)")))).alias("provenance"),
        F.filter("doc_ids", lambda d: d.isNotNull()).alias("doc_ids"), F.col("first.ord").alias("ord"),
    )


def merge_edges(*parts: DataFrame) -> DataFrame:
    """MERGE by (source, type, target); provenance is a bag in order."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    turn = _turn(rows)
    first = F.min("ord") if turn == ["ord"] else F.min(F.struct(*turn))["ord"]
    out = rows.groupBy("source", "type", "target").agg(first.alias("ord"), F.sort_array(F.collect_list(F.struct(*turn, "provenance"))).alias("stamps"))
    return out.select("source", "type", "target", F.flatten(F.transform("stamps", lambda s: s["provenance"])).alias("provenance"), "ord")


def apply_delta(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph with a delta merged, endpoints that lack a node as bare ones, and one row of the counts of new rows
    (those bare ones aren't counted)."""
    bare, counts = _added(nodes, edges, new_nodes, new_edges)
    return merge_nodes(nodes, new_nodes, bare), merge_edges(edges, new_edges), counts


def _added(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a delta adds to a graph: bare nodes for endpoints that lack one, and one row of counts."""
    from ..functions.text import type_of_key

    known = nodes.select("key").unionByName(new_nodes.select("key")).distinct()
    ends = new_edges.select(F.col("source").alias("key"), "ord").unionByName(new_edges.select(F.col("target").alias("key"), "ord"))
    bare = ends.groupBy("key").agg(F.min("ord").alias("ord")).join(known, "key", "left_anti")
    bare = bare.select("key", type_of_key("key").alias("type"), F.expr("cast(map() as map<string,string>)").alias("props"), F.expr(f"cast(array() as array<{PROVENANCE}>)").alias("provenance"), F.expr("cast(array() as array<string>)").alias("doc_ids"), "ord")
    added_nodes = new_nodes.select("key").distinct().join(nodes.select("key"), "key", "left_anti").agg(F.count("*").alias("nodes_added"))
    same = ["source", "type", "target"]
    added_edges = new_edges.select(*same).distinct().join(edges.select(*same), same, "left_anti").agg(F.count("*").alias("edges_added"))
    return bare, added_nodes.crossJoin(added_edges)  # one row each


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part`` (node, edge), ``type`` (null for the total), ``n``."""
    both = nodes.select(F.lit("node").alias("part"), "type").unionByName(edges.select(F.lit("edge").alias("part"), "type"))
    by = both.groupBy("part", "type").agg(F.count("*").alias("n"))
    return by.unionByName(by.groupBy("part").agg(F.sum("n").alias("n")).withColumn("type", F.lit(None).cast("string")))


def linkage(nodes: DataFrame, edges: DataFrame, least: int = 3, kind: str = "Equipment") -> DataFrame:
    """Of each asset the distinct document types that its own or its edges' provenance come from, and whether they are
    at least ``least``: key, doc_types, well_linked."""
    assets = nodes.where(F.col("type") == kind)
    own = assets.select("key", F.explode("doc_ids").alias("doc_id"))
    by_edge = lambda end: edges.select(F.col(end).alias("key"), F.explode("provenance.doc_id").alias("doc_id"))
    types = nodes.where("type = 'Document'").select(F.element_at("props", "doc_id").alias("doc_id"), F.try_element_at("props", F.lit("doc_type")).alias("doc_type")).where("doc_type <> 'unknown'")
    # Types are few, so what is grouped and moved is an asset's types and not its documents.
    found = own.unionByName(by_edge("source")).unionByName(by_edge("target")).join(types, "doc_id").select("key", "doc_type").distinct()
    counted = found.groupBy("key").agg(F.count("*").alias("doc_types"))
    return assets.select("key").join(counted, "key", "left").select("key", F.coalesce("doc_types", F.lit(0)).alias("doc_types"), (F.coalesce("doc_types", F.lit(0)) >= least).alias("well_linked"))


def linkage_share(linked: DataFrame) -> DataFrame:
    """One row: assets, well_linked, pct (to one place; zeros for no assets)."""
    out = linked.agg(F.count("*").alias("assets"), F.coalesce(F.sum(F.col("well_linked").cast("long")), F.lit(0)).alias("well_linked"))
    return out.withColumn("pct", F.when(F.col("assets") > 0, F.round(100 * F.col("well_linked") / F.col("assets"), 1)).otherwise(0.0))


def incident(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: key, other, type, direction, provenance, ord; a loop comes twice."""
    rest = ["type", "provenance", "ord"] if "provenance" in edges.columns else ["type"]
    out = edges.select(F.col("source").alias("key"), F.col("target").alias("other"), F.lit("out").alias("direction"), *rest)
    return out.unionByName(edges.select(F.col("target").alias("key"), F.col("source").alias("other"), F.lit("in").alias("direction"), *rest))


def ego(nodes: DataFrame, edges: DataFrame, center: str, hops: int = 1, limit: int = 60) -> tuple[DataFrame, DataFrame]:
    """Keys with their distance within ``hops`` of the center (the nearest ``limit``, by distance and key), and the
    edges among them."""
    both = incident(edges.select("source", "type", "target")).select("key", "other").distinct()
    seen = nodes.where(F.col("key") == center).select("key", F.lit(0).alias("distance"))
    front = seen
    for hop in range(1, max(1, hops) + 1):
        front = both.join(front.select("key"), "key", "left_semi").select(F.col("other").alias("key")).distinct().join(seen.select("key"), "key", "left_anti").withColumn("distance", F.lit(hop))
        seen = seen.unionByName(front)
    kept = seen.orderBy("distance", "key").limit(limit)
    inside = edges.join(kept.select(F.col("key").alias("source")), "source", "left_semi").join(kept.select(F.col("key").alias("target")), "target", "left_semi")
    return kept, inside


def save(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A snapshot: Parquet by type, so that reads of one type touch its folder only."""
    nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def grow(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, folder: str, version: int) -> DataFrame:
    """Version ``version`` in a folder of versions, out of the graph of the one before and a delta; one row of counts.

    What is written is the delta as it comes, all of its rows, and bare nodes: no row gathers what a hub has, and nothing
    of earlier versions is written again.  :func:`load` merges the rows of all versions up to one."""
    at, spark = f"{folder}/parts/v{version}", new_nodes.sparkSession
    for name, rows in (("nodes", new_nodes), ("edges", new_edges)):
        rows.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{at}/{name}")
    new_nodes, new_edges = (spark.read.schema(s).parquet(f"{at}/{name}") for name, s in (("nodes", NODES), ("edges", EDGES)))
    bare, counts = _added(nodes, edges, new_nodes, new_edges)
    bare.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{at}/bare")
    return counts


def _grown(spark, path: str) -> tuple[DataFrame, DataFrame] | None:
    """A version made by :func:`grow`; None for any other snapshot.  The first may follow a whole version."""
    from ..sources.writers import names

    folder, _, name = path.rpartition("/")
    parts = set(names(spark, f"{folder}/parts"))
    if name not in parts:
        return None
    first = last = int(name[1:])
    while f"v{first - 1}" in parts:
        first -= 1
    at = [f"{folder}/parts/v{n}" for n in range(first, last + 1)]
    read = lambda s, *kinds: spark.read.schema(T.StructType([*s.fields, _VERSION])).parquet(*[f"{p}/{kind}" for p in at for kind in kinds])
    nodes, edges = read(NODES, "nodes", "bare"), read(EDGES, "edges")
    if first > 0:
        before = [spark.read.schema(s).parquet(f"{folder}/v{first - 1}/{kind}").select(*s.names, F.lit(first - 1).cast("long").alias("version")) for kind, s in (("nodes", NODES), ("edges", EDGES))]
        nodes, edges = nodes.unionByName(before[0]), edges.unionByName(before[1])
    return merge_nodes(nodes), merge_edges(edges)


def load(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """The snapshot; an empty graph where neither of its tables is there.  Anything else that keeps it from being read is
    an error, so that no graph is lost to a failing store."""
    from ..sources.writers import exists

    grown = _grown(spark, path)
    if grown:
        return grown
    if not any(exists(spark, f"{path}/{name}") for name in ("nodes", "edges")):
        return spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    return tuple(spark.read.schema(s).parquet(f"{path}/{name}").select(*s.names) for name, s in (("nodes", NODES), ("edges", EDGES)))

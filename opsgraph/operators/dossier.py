"""All that the graph knows of an asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _prop(name: str) -> Column:
    return F.try_element_at("props", F.lit(name))


def source_of(stamps: Column) -> Column:
    """The first stamp with a document."""
    return F.get(F.filter(stamps, lambda p: p["doc_id"].isNotNull()), F.lit(0))


def section(nodes: DataFrame, edges: DataFrame, kind: str, fields: list[str], prefix: str = "") -> DataFrame:
    """asset and the given properties of the nodes that edges of a type lead from."""
    ends = edges.where((F.col("type") == kind) & F.startswith("source", F.lit(prefix))).select(F.col("target").alias("asset"), F.col("source").alias("key"))
    return ends.join(nodes, "key").select("asset", "key", *[_prop(f).alias(f) for f in fields], source_of(F.col("provenance")).alias("source"))


def dossier(nodes: DataFrame, edges: DataFrame, latest: int = 5) -> DataFrame:
    """A row for each Equipment node: header fields, the latest work orders and their number, procedures, incidents,
    clauses, notes, neighbours, counts by failure code, inspection.  Lists are in order of their ids.

    Each section is one join by asset and one grouped collection of an asset's own rows.
    """
    assets = nodes.where("type = 'Equipment'").select(F.col("key").alias("asset"), *[_prop(f).alias(f) for f in ("tag", "name", "type", "location")])
    orders = section(nodes, edges, "PERFORMED_ON", ["wo_id", "date", "type", "problem_text"])
    w = Window.partitionBy("asset").orderBy(F.desc_nulls_last("date"), "wo_id")
    ranked = orders.withColumn("n", F.row_number().over(w))
    shown = F.struct("n", "wo_id", "date", "type", F.substring("problem_text", 1, 90).alias("problem"), F.col("source.row").alias("row"))
    by_order = ranked.groupBy("asset").agg(F.count("*").alias("work_order_count"), F.sort_array(F.collect_list(F.when(F.col("n") <= latest, shown))).alias("work_orders"))
    incidents = section(nodes, edges, "OCCURRED_AT", ["incident_id", "severity", "date"], "Incident:")
    parts = [
        by_order,
        _listed(section(nodes, edges, "GOVERNS", ["sop_id", "title"], "Procedure:"), "procedures", ["sop_id", "title"]),
        _listed(incidents, "incidents", ["incident_id", "severity", "date"]),
        _listed(section(nodes, edges, "COVERS", ["standard", "clause_no"], "RegulatoryClause:"), "regulatory", ["standard", "clause_no"]),
        _listed(section(nodes, edges, "ABOUT", ["note_id", "author_role", "transcript"], "TacitNote:").withColumn("transcript", F.substring("transcript", 1, 160)), "tacit_notes", ["note_id", "author_role", "transcript"]),
        _neighbours(edges), _failures(edges, orders.select("asset", "key").unionByName(incidents.select("asset", "key"))), _inspection(nodes, edges),
    ]
    out = assets
    for p in parts:
        out = out.join(p, "asset", "left")
    return out.withColumn("work_order_count", F.coalesce("work_order_count", F.lit(0)))


def _listed(rows: DataFrame, name: str, fields: list[str]) -> DataFrame:
    return rows.groupBy("asset").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def _neighbours(edges: DataFrame) -> DataFrame:
    c = edges.where("type = 'CONNECTED_TO'").select("source", "target")
    both = c.select(F.col("source").alias("asset"), F.col("target").alias("o")).unionByName(c.select(F.col("target").alias("asset"), F.col("source").alias("o")))
    return both.groupBy("asset").agg(F.sort_array(F.collect_set(F.regexp_replace("o", "^[^:]*:", ""))).alias("connected_to"))


def _failures(edges: DataFrame, owners: DataFrame) -> DataFrame:
    codes = edges.where("type = 'EXHIBITS' and target like 'FailureMode:%'").select(F.col("source").alias("key"), F.regexp_replace("target", "^[^:]*:", "").alias("code"))
    n = owners.join(codes, "key").groupBy("asset", "code").agg(F.count("*").alias("count"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("m"), "code", "count")))
    return n.groupBy("asset").agg(F.transform(ordered, lambda x: F.struct(x["code"].alias("code"), x["count"].alias("count"))).alias("failure_modes"))


def _inspection(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The last chunk of an inspection that mentions the asset."""
    chunks = nodes.where("type = 'Chunk'").where(F.startswith(_prop("doc_id"), F.lit("INSP"))).select("key", _prop("doc_id").alias("doc_id"), _prop("text").alias("text"), "ord")
    m = edges.where("type = 'MENTIONS'").select(F.col("source").alias("key"), F.col("target").alias("asset")).join(chunks, "key")
    return m.groupBy("asset").agg(F.max_by(F.struct("doc_id", F.contains(F.upper("text"), F.lit("OVERDUE")).alias("overdue"), F.substring("text", 1, 120).alias("text")), F.struct("ord", "doc_id")).alias("inspection"))

"""From extracted records to graph records: exact keys, then fuzzy tags, then the ends of edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from .graph import provenance


def fuzzy_tags(tags: DataFrame, known: DataFrame) -> DataFrame:
    """``tag``, ``match``: the first known tag (by ``ord``, then name) with the same prefix and at most one edit.

    Tags within one edit are equal once a character (or none) is taken out of each, so they are joined on prefix and
    what is left of them, a row for each character; tags that are far apart don't meet."""
    left = tags.select("tag", X.tag_prefix("tag").alias("prefix")).distinct().select("*", F.explode(_shortened("tag")).alias("left"))
    right = known.select(F.col("tag").alias("match"), "ord", X.tag_prefix("tag").alias("prefix")).select("*", F.explode(_shortened("match")).alias("left"))
    met = left.join(right, ["prefix", "left"]).where(X.within_one_edit(F.col("tag"), F.col("match")))
    return met.groupBy("tag").agg(F.min(F.struct("ord", "match")).alias("b")).select("tag", F.col("b.match").alias("match"))


def _shortened(tag: str):
    """A tag, and the tag without each of its characters."""
    t = F.col(tag)
    without = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    return F.array_distinct(F.concat(F.array(t), without))


def resolve_tags(extracted: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id``, ``pos``, ``tag``, ``final``: exact match, else the first fuzzy one among known tags and the new tags that
    stand before it in the document, else itself.

    The order within a document matters, so a document's tags (its own, a handful) are folded in one group; known
    matches are joined before, so a group holds no more than its document's tags."""
    base = extracted.join(known.select("tag", F.lit(True).alias("exact")).distinct(), "tag", "left").join(fuzzy_tags(extracted.select("tag"), known), "tag", "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        fresh, final = [], []
        for row in pdf.sort_values("pos").itertuples():
            if row.exact is True or row.tag in fresh:
                final.append(row.tag)
                continue
            near = row.match if isinstance(row.match, str) else next((t for t in fresh if _prefix(t) == _prefix(row.tag) and _one_edit(t, row.tag)), None)
            if near is None:
                fresh.append(row.tag)
            final.append(near or row.tag)
        return pdf.sort_values("pos").assign(final=final)[["doc_id", "pos", "tag", "final"]]

    kind = {f.name: f.dataType.simpleString() for f in extracted.schema}
    return base.select("doc_id", "pos", "tag", "exact", "match").groupBy("doc_id").applyInPandas(fold, f"doc_id {kind['doc_id']}, pos int, tag string, final string")


def _prefix(tag: str) -> str:
    return next((tag[:i] for i, c in enumerate(tag) if c.isdigit()), tag)


def _one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def aliases(nodes: DataFrame) -> DataFrame:
    """``doc_id``, ``alias``, ``key``: what edges may call a node (doc_id, type, props, key)."""
    p = lambda n: F.try_element_at("props", F.lit(n))
    names = (
        F.when(F.col("type") == "Equipment", F.array(p("tag"), F.replace(p("tag"), F.lit("-"), F.lit("")))).when(F.col("type") == "FailureMode", F.array(F.upper(p("code")))).when(F.col("type") == "WorkOrder", F.array(p("wo_id")))
        .when(F.col("type") == "Incident", F.array(p("incident_id"))).when(F.col("type") == "Procedure", F.array(p("sop_id")))
        .when(F.col("type") == "RegulatoryClause", F.array(F.concat(p("standard"), F.lit(":"), p("clause_no")), F.concat(p("standard"), F.lit(" "), p("clause_no"))))
    )
    return nodes.select("doc_id", F.explode(names).alias("alias"), "key").where("alias is not null").groupBy("doc_id", "alias").agg(F.max("key").alias("key"))


def domain(spark) -> DataFrame:
    """The pairs of types by edge type with their order; some dozens of rows."""
    return spark.createDataFrame([(e, n, a, b) for e, pairs in V.EDGE_DOMAIN.items() for n, (a, b) in enumerate(pairs)], "type string, n int, source_type string, target_type string")


def resolve(nodes: DataFrame, edges: DataFrame, known: DataFrame, extractor: str = "llm_text") -> tuple[DataFrame, DataFrame]:
    """Graph records of extracted ones.  ``known``: key, ord of the graph's nodes.

    Equipment goes through exact and fuzzy matching; an edge's ends are aliases of the document's nodes, else keys made
    of the reference, an unknown tag again by its fuzzy match; of several type pairs the one counts whose source type
    the alias has, else the first.
    """
    spark = nodes.sparkSession
    tags = known.where(F.startswith("key", F.lit("Equipment:"))).select(F.regexp_replace("key", "^[^:]*:", "").alias("tag"), "ord")
    own = nodes.where("type = 'Equipment'").select("doc_id", "pos", X.normalize_tag(F.try_element_at("props", F.lit("tag"))).alias("tag")).where("tag <> ''")
    final = resolve_tags(own, tags).select("doc_id", "pos", "final")
    keyed = nodes.join(final, ["doc_id", "pos"], "left").withColumn("key", F.when(F.col("final").isNotNull(), F.concat(F.lit("Equipment:"), "final")).otherwise(X.canonical_key("type", F.col("props")))).where("key is not null")
    stamp = lambda: F.array(provenance(F.col("doc_id"), extractor, F.col("confidence"), page=F.lit(1), span=F.col("span")))
    graph_nodes = keyed.select("key", "type", "props", stamp().alias("provenance"), F.array("doc_id").alias("doc_ids"), F.col("pos").cast("long").alias("ord"), "doc_id")
    named = aliases(keyed.select("doc_id", "type", "props", "key"))
    far = F.broadcast(domain(spark))  # some dozens of rows
    e = edges.withColumn("eid", F.xxhash64("doc_id", "pos"))
    e = e.join(named.select("doc_id", F.col("alias").alias("source_ref"), F.col("key").alias("source_key")), ["doc_id", "source_ref"], "left")
    e = e.join(named.select("doc_id", F.col("alias").alias("target_ref"), F.col("key").alias("target_key")), ["doc_id", "target_ref"], "left")
    pair = e.join(far, "type").groupBy("doc_id", "pos").agg(F.min(F.struct(F.when(F.startswith("source_key", F.concat("source_type", F.lit(":"))), 0).otherwise(1).alias("o"), "n", "source_type", "target_type")).alias("d"))
    e = e.join(pair, ["doc_id", "pos"])
    e = e.withColumns({"source": F.coalesce("source_key", X.key_for_ref("d.source_type", "source_ref")), "target": F.coalesce("target_key", X.key_for_ref("d.target_type", "target_ref"))})
    loose = e.select(F.explode(F.array("source", "target")).alias("key")).where(F.startswith("key", F.lit("Equipment:"))).distinct().join(known.select("key"), "key", "left_anti").join(graph_nodes.select("key").distinct(), "key", "left_anti")
    near = fuzzy_tags(loose.select(F.regexp_replace("key", "^[^:]*:", "").alias("tag")), tags).select(F.concat(F.lit("Equipment:"), "tag").alias("key"), F.concat(F.lit("Equipment:"), "match").alias("now"))
    for end in ("source", "target"):
        e = e.join(near.select(F.col("key").alias(end), F.col("now").alias(f"{end}_now")), end, "left").withColumn(end, F.coalesce(f"{end}_now", end))
    return graph_nodes, e.where("source is not null and target is not null").select("source", "type", "target", stamp().alias("provenance"), F.col("pos").cast("long").alias("ord"))

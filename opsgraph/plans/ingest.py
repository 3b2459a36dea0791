"""Batch ingest: prose, work orders, inspections and notes into one graph and one index.

All documents of a kind go through one plan; what order decides (which value of a property stays, which tag was first)
is in ``ord``, the place in the manifest and in the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extract as E
from ..operators import graph as G
from ..operators import resolve as M
from ..operators.rank import checkpointed

#: Orders within one document are below this.
STEP = 1 << 40
#: Types of documents that are read as prose.
PROSE = ["sop", "incident", "regulatory"]


def index_chunks(documents: DataFrame) -> DataFrame:
    """chunk_id, doc_id, page, n, text of documents (doc_id, pages)."""
    made = documents.select("doc_id", F.explode(X.chunk_pages("pages")).alias("c"))
    return made.select(F.concat("doc_id", F.lit("::p"), F.col("c.page").cast("string"), F.lit("::c"), F.col("c.n").cast("string")).alias("chunk_id"), "doc_id", F.col("c.page").alias("page"), F.col("c.n").alias("n"), F.col("c.text").alias("text"))


def prose(documents: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and chunks of documents (pos, doc_id, doc_type, pages) for a graph with ``nodes``.

    Each entity is mentioned by its best chunk and extracted from its document."""
    chunks = index_chunks(documents)
    text = F.array_join(F.filter("pages", lambda p: F.trim(p) != ""), "\n")
    # Extraction and resolution are each used several times: kept, so that texts are read once and plans stay small.
    found, links = map(checkpointed, E.extract(documents.select("doc_id", "doc_type", text.alias("text"))))
    resolved, edges = map(checkpointed, M.resolve(found, links, nodes.select("key", "ord")))
    place = documents.select("doc_id", (F.col("pos").cast("long") * STEP).alias("base"))
    p = lambda k: F.nullif(F.try_element_at("props", F.lit(k)), F.lit(""))
    tokens = resolved.select("doc_id", "key", F.coalesce(p("tag"), p("clause_no"), p("sop_id"), p("incident_id"), p("code"), F.lit("")).alias("token"))
    best = E.best_chunk(tokens, chunks)
    stamped = resolved.groupBy("doc_id", "key").agg(F.min("ord").alias("ord"), F.min_by("provenance", "ord").alias("provenance"))
    mentions = best.join(stamped, ["doc_id", "key"]).select(F.concat(F.lit("Chunk:"), "chunk_id").alias("source"), F.lit("MENTIONS").alias("type"), F.col("key").alias("target"), "provenance", "ord", "doc_id")
    origin = stamped.select(F.col("key").alias("source"), F.lit("EXTRACTED_FROM").alias("type"), F.concat(F.lit("Document:"), "doc_id").alias("target"), "provenance", "ord", "doc_id")
    edges = edges.withColumn("doc_id", F.col("provenance")[0]["doc_id"]).unionByName(mentions).unionByName(origin)
    props = F.map_from_arrays(F.array(F.lit("chunk_id"), F.lit("doc_id"), F.lit("page"), F.lit("text")), F.array("chunk_id", "doc_id", F.col("page").cast("string"), F.substring("text", 1, 500)))
    stamp = F.array(G.provenance(F.col("doc_id"), "chunker"))
    chunk_nodes = chunks.select(F.concat(F.lit("Chunk:"), "chunk_id").alias("key"), F.lit("Chunk").alias("type"), props.alias("props"), stamp.alias("provenance"), F.array("doc_id").alias("doc_ids"), F.col("n").cast("long").alias("ord"), "doc_id")
    placed = lambda df, names: df.join(place, "doc_id").withColumn("ord", F.col("base") + F.col("ord")).select(*names)
    return placed(resolved.unionByName(chunk_nodes), G.NODES.names), placed(edges, G.EDGES.names), chunks


def add_prose(nodes: DataFrame, edges: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The graph with documents merged, the counts of new rows, and their chunks."""
    entries = E.document_nodes(documents.select("doc_id", "doc_type")).select(*G.NODES.names)
    new_nodes, new_edges, chunks = prose(documents, nodes)
    return *G.apply_delta(nodes, edges, entries.unionByName(new_nodes), new_edges), chunks


def build(entries: DataFrame, pages: DataFrame, work_orders: dict[str, DataFrame] | None = None, notes: DataFrame | None = None, drawings: tuple[DataFrame, DataFrame] | None = None, lexicon: dict[str, str] | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The graph of a whole manifest, on top of ``nodes`` and ``edges`` if there are any: nodes, edges, one row of the
    counts of new ones, and chunks (chunk_id, doc_id, page, row, text).

    ``entries`` as the manifest reader gives them; ``pages``: doc_id, pages; ``work_orders``: rows by document id;
    ``notes``: note_id (the document's id), transcript; ``drawings``: symbols and pairs, with the document's id as
    ``drawing``.  What isn't in the manifest is left out.  Tables, notes, inspections and drawings name their assets
    exactly, so they go first and prose is resolved against all of them."""
    spark = entries.sparkSession
    nodes = nodes if nodes is not None else spark.createDataFrame([], G.NODES)
    edges = edges if edges is not None else spark.createDataFrame([], G.EDGES)
    place = entries.select("doc_id", (F.col("pos").cast("long") * STEP).alias("base"))
    parts = [E.inspection_records(entries.where("doc_type = 'inspection'")), *(E.work_orders(rows, doc_id, lexicon or {}) for doc_id, rows in (work_orders or {}).items())]
    if notes is not None:
        said = E.notes(notes if "role" in notes.columns else notes.withColumn("role", F.lit(None).cast("string")))
        parts.append((*(df.withColumn("ord", F.col("ord") % 1000) for df in said[:2]), said[2]))
    if drawings is not None:
        parts.append((*E.drawing_records(*drawings), spark.createDataFrame([], "chunk_id string, doc_id string, page int, row int, text string")))

    def placed(listed: list[DataFrame], names: list[str]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [df.select(*names) for df in listed]).withColumn("doc_id", F.col("provenance")[0]["doc_id"])
        return rows.join(place, "doc_id").withColumn("ord", F.col("base") + F.col("ord")).select(*names)

    documents = E.document_nodes(entries).withColumn("ord", F.lit(0).cast("long"))
    new_nodes, new_edges = placed([documents, *(n for n, _, _ in parts)], G.NODES.names), placed([e for _, e, _ in parts], G.EDGES.names)
    nodes, edges, first = map(checkpointed, G.apply_delta(nodes, edges, new_nodes, new_edges))
    found, links, chunks = prose(entries.where(F.col("doc_type").isin(PROSE)).join(pages, "doc_id").select("pos", "doc_id", "doc_type", "pages"), nodes)
    nodes, edges, second = G.apply_delta(nodes, edges, found, links)
    counts = first.unionByName(second).agg(F.sum("nodes_added").alias("nodes_added"), F.sum("edges_added").alias("edges_added"))
    columns = ["chunk_id", "doc_id", "page", "row", "text"]
    told = reduce(DataFrame.unionByName, [c.select(*columns) for _, _, c in parts]).join(place.select("doc_id"), "doc_id", "left_semi")
    return nodes, edges, counts, told.select(*columns).unionByName(chunks.withColumn("row", F.lit(None).cast("int")).select(*columns))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``pos`` from 0 by file order or the given columns, within a manifest (some thousand entries)."""
    return rows if "pos" in rows.columns else rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)

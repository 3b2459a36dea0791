"""Typed nodes and edges out of documents, one row to many.

Every extractor yields two DataFrames.  Nodes: ``doc_id``, ``type``, ``props``, ``confidence``, ``span``, ``pos``;
edges: ``doc_id``, ``type``, ``source_ref``, ``target_ref``, ``confidence``, ``span``, ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from .graph import PROVENANCE, provenance

NODE = "struct<type:string,props:map<string,string>,confidence:double,span:string>"
EDGE = "struct<type:string,source_ref:string,target_ref:string,confidence:double,span:string>"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _node(kind: str, props: dict[str, Column], confidence: float, span: Column | None = None) -> Column:
    pairs = [x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(F.lit(kind).alias("type"), F.create_map(*pairs).alias("props"), F.lit(confidence).alias("confidence"), (span if span is not None else F.lit("")).alias("span"))


def _edge(kind: str, source: Column, target: Column, confidence: float, span: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), source.alias("source_ref"), target.alias("target_ref"), F.lit(confidence).alias("confidence"), (span if span is not None else F.lit("")).alias("span"))


def _fallback(text: Column) -> tuple[Column, Column]:
    """Tags and codes without edges."""
    return F.concat(F.transform(X.extract_tags(text), lambda t: _node("Equipment", {"tag": t}, 0.6)), F.transform(X.failure_codes(text), lambda c: _node("FailureMode", {"code": c}, 0.55))), _none(EDGE)


def _procedure(text: Column) -> tuple[Column, Column]:
    title = r"(?i)(SOP-\d+)\s+(.*?)\s*\(Rev\s*([\w.]+)\)"
    part = lambda k: F.regexp_extract(text, title, k)
    sop = F.upper(part(1))
    region = X.section_after(text, "Applicable Equipment", ["Referenced Standards", "Procedure", r"\d\.\s"])
    tags = X.extract_tags(F.when(region != "", region).otherwise(text))
    standard = r"(?i)\b([A-Z][A-Z0-9]+(?:-[A-Z0-9]+)+)\s+clause\s+(\d+(?:\.\d+)*)"
    cited = F.arrays_zip(X.all_matches(text, standard, 1).alias("s"), X.all_matches(text, standard, 2).alias("c"))
    own = F.array(_node("Procedure", {"sop_id": sop, "title": F.trim(part(2)), "revision": part(3)}, 0.9, F.concat(sop, F.lit(" "), F.trim(part(2)))))
    nodes = F.concat(own, F.transform(tags, lambda t: _node("Equipment", {"tag": t}, 0.85)))
    edges = F.concat(
        F.transform(tags, lambda t: _edge("GOVERNS", sop, t, 0.85)),
        F.transform(cited, lambda x: _edge("REQUIRES", sop, F.concat(F.upper(x["s"]), F.lit(":"), x["c"]), 0.9, F.concat(x["s"], F.lit(" clause "), x["c"]))),
    )
    other = _fallback(text)
    return F.when(part(1) != "", nodes).otherwise(other[0]), F.when(part(1) != "", edges).otherwise(other[1])


def _regulation(text: Column) -> tuple[Column, Column]:
    first = F.get(F.split(F.trim(text), r"\n"), F.lit(0))
    named = F.regexp_extract(first, r"^\s*([A-Z][A-Z0-9]+(?:-[A-Z0-9]+)+)\s+(.*)", 1)
    standard = F.when(named != "", named).otherwise(F.lit("UNKNOWN"))
    about = F.regexp_extract(text, r"(?i)(?:Referenced equipment|Applicable Equipment)[:\s]*\n?([^\n]+(?:\n[^\n]+)?)", 1)
    tags = X.extract_tags(about)
    block = r"(?is)Clause\s+([\d.]+)\s*\n(.+?)(?=\n\s*Clause\s+[\d.]+|\n\s*Applicability|\z)"
    found = F.arrays_zip(X.all_matches(text, block, 1).alias("n"), X.all_matches(text, block, 2).alias("b"))
    nodes = F.transform(found, lambda x: _node("RegulatoryClause", {"standard": standard, "clause_no": x["n"], "text_summary": F.substring(F.trim(x["b"]), 1, 160)}, 0.9, F.substring(F.trim(x["b"]), 1, 60)))
    edges = F.flatten(F.transform(found, lambda x: F.transform(tags, lambda t: _edge("COVERS", F.concat(standard, F.lit(":"), x["n"]), t, 0.8))))
    other = _fallback(text)
    return F.when(F.size(found) > 0, nodes).otherwise(other[0]), F.when(F.size(found) > 0, edges).otherwise(other[1])


def _incident(text: Column) -> tuple[Column, Column]:
    ident = F.regexp_extract(text, r"(INC-\d{4}-\d+)", 1)
    day = F.nullif(F.regexp_extract(text, r"(?i)Date\s*\n?\s*(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    severity = F.nullif(F.lower(F.regexp_extract(text, r"(?i)Severity\s*\n?\s*(near-miss|minor|major|fatal)", 1)), F.lit(""))
    tags, codes = X.extract_tags(text), X.failure_codes(text)
    nodes = F.concat(
        F.array(_node("Incident", {"incident_id": ident, "date": day, "severity": severity}, 0.9, ident)),
        F.transform(tags, lambda t: _node("Equipment", {"tag": t}, 0.85)), F.transform(codes, lambda c: _node("FailureMode", {"code": c}, 0.7)),
    )
    edges = F.concat(F.transform(tags, lambda t: _edge("OCCURRED_AT", ident, t, 0.85)), F.transform(codes, lambda c: _edge("EXHIBITS", ident, c, 0.7)))
    other = _fallback(text)
    return F.when(ident != "", nodes).otherwise(other[0]), F.when(ident != "", edges).otherwise(other[1])


def extract(documents: DataFrame, doc_type: str = "doc_type", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """By document type: sop, regulatory, incident; tags and codes of anything else.  ``documents`` have doc_id."""
    body = F.coalesce(F.col(text), F.lit(""))
    kind = F.col(doc_type)
    by = {"sop": _procedure(body), "regulatory": _regulation(body), "incident": _incident(body)}
    last = _fallback(body)
    pick = lambda k: F.when(kind == "sop", by["sop"][k]).when(kind == "regulatory", by["regulatory"][k]).when(kind == "incident", by["incident"][k]).otherwise(last[k])
    made = documents.select("doc_id", pick(0).alias("nodes"), pick(1).alias("edges"))
    return made.select("doc_id", F.posexplode("nodes").alias("pos", "x")).select("doc_id", "x.*", "pos"), made.select("doc_id", F.posexplode("edges").alias("pos", "x")).select("doc_id", "x.*", "pos")


def work_orders(rows: DataFrame, doc_id: str, lexicon: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and index chunks of work-order rows (WO_ID, Date, Equipment_Tag, Type, Problem_Text, Action_Text,
    Technician, row); rows without a tag give nothing.  One wide projection, no shuffle."""
    columns = {c: (F.col(c) if c in rows.columns else F.lit(None)).cast("string") for c in ("WO_ID", "Date", "Equipment_Tag", "Type", "Problem_Text", "Action_Text", "Technician")}
    rows = rows.select("row", *[v.alias(k) for k, v in columns.items()]).where(F.coalesce("Equipment_Tag", F.lit("")) != "")
    raw = F.concat(F.coalesce("Problem_Text", F.lit("")), F.lit(". "), F.coalesce("Action_Text", F.lit("")))
    rows = rows.withColumn("raw", raw).withColumn("norm", X.expand_shorthand("raw", lexicon)[0]).withColumn("tag", X.normalize_tag("Equipment_Tag")).withColumn("codes", X.failure_codes("norm"))
    doc = F.lit(doc_id)
    stamp = F.array(provenance(doc, "tlp", 0.95, row=F.col("row"), span=F.substring("raw", 1, 80)))
    plain = F.array(provenance(doc, "chunker"))
    equipment, order, document = F.concat(F.lit("Equipment:"), "tag"), F.concat(F.lit("WorkOrder:"), "WO_ID"), F.concat(F.lit("Document:"), doc)
    person = F.concat(F.lit("Person:"), F.lower(F.trim("Technician")))
    chunk_id = F.concat(doc, F.lit("::r"), F.col("row").cast("string"))
    chunk = F.concat(F.lit("Chunk:"), chunk_id)
    body = F.concat(F.lit("WO "), "WO_ID", F.lit(" on "), "tag", F.lit(": "), "norm")
    has = F.coalesce("Technician", F.lit("")) != ""

    def node(key, kind, props, stamps):
        return F.struct(key.alias("key"), F.lit(kind).alias("type"), F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]).alias("props"), stamps.alias("provenance"))

    def edge(kind, a, b):
        return F.struct(a.alias("source"), F.lit(kind).alias("type"), b.alias("target"), stamp.alias("provenance"))

    mode = lambda c: F.concat(F.lit("FailureMode:"), c)
    nodes = F.concat(
        F.array(node(equipment, "Equipment", {"tag": F.col("tag")}, stamp), node(order, "WorkOrder", {"wo_id": F.col("WO_ID"), "type": F.lower("Type"), "date": F.substring("Date", 1, 10), "problem_text": F.col("norm"), "technician": F.col("Technician")}, stamp)),
        F.filter(F.array(F.when(has, node(person, "Person", {"name": F.trim("Technician"), "role": F.lit("Technician")}, stamp))), lambda x: x.isNotNull()),
        F.transform("codes", lambda c: node(mode(c), "FailureMode", {"code": c, "name": X.failure_name(c)}, stamp)),
        F.array(node(chunk, "Chunk", {"chunk_id": chunk_id, "doc_id": doc, "page": F.lit(1), "text": F.substring(body, 1, 500)}, plain)),
    )
    edges = F.concat(
        F.array(edge("PERFORMED_ON", order, equipment)), F.transform("codes", lambda c: edge("EXHIBITS", order, mode(c))), F.transform("codes", lambda c: edge("MENTIONS", chunk, mode(c))), F.array(edge("MENTIONS", chunk, equipment)),
        F.filter(F.array(F.when(has, edge("MENTIONS", chunk, person))), lambda x: x.isNotNull()), F.array(edge("EXTRACTED_FROM", order, document)),
    )
    return _exploded(rows, nodes, "row", doc), _exploded(rows, edges, "row", None), rows.select(chunk_id.alias("chunk_id"), doc.alias("doc_id"), F.lit(1).alias("page"), F.col("row").cast("int").alias("row"), body.alias("text"))


def _exploded(rows: DataFrame, made: Column, order: str, doc: Column | None) -> DataFrame:
    out = rows.select(F.col(order).cast("long").alias("o"), F.posexplode(made).alias("pos", "x"))
    ord_ = (F.col("o") * 1000 + F.col("pos")).alias("ord")
    return out.select("x.*", *([F.array(doc).alias("doc_ids")] if doc is not None else []), ord_)


def best_chunk(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, key, chunk_id: the first chunk of the document whose text contains the node's token, else its first.

    ``nodes``: doc_id, key, token; ``chunks``: doc_id, chunk_id, n, text."""
    both = nodes.join(chunks, "doc_id")
    hit = (F.coalesce("token", F.lit("")) != "") & F.contains(F.lower("text"), F.lower("token"))
    return both.groupBy("doc_id", "key").agg(F.min(F.struct(F.when(hit, 0).otherwise(1).alias("miss"), "n", "chunk_id")).alias("b")).select("doc_id", "key", F.col("b.chunk_id").alias("chunk_id"))


def inspections(entries: DataFrame) -> DataFrame:
    """Chunks of inspection entries (doc_id, equipment, overdue): what the manifest says as a sentence."""
    tag = X.normalize_tag("equipment")
    status = F.when(F.coalesce("overdue", F.lit(False)), "OVERDUE").otherwise("within inspection period")
    text = F.concat(F.lit("Equipment inspection record "), "doc_id", F.lit(" for "), tag, F.lit(". Inspection status: "), status, F.lit("."))
    return entries.where(F.coalesce("equipment", F.lit("")) != "").select(F.concat("doc_id", F.lit("::insp")).alias("chunk_id"), "doc_id", F.lit(1).alias("page"), tag.alias("tag"), text.alias("text"))


def inspection_records(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and chunks of inspection entries: the equipment, and the sentence that mentions it."""
    said = inspections(entries)
    key, chunk = F.concat(F.lit("Equipment:"), "tag"), F.concat(F.lit("Chunk:"), "chunk_id")
    stamp, plain = F.array(provenance(F.col("doc_id"), "manifest", 0.9)), F.array(provenance(F.col("doc_id"), "chunker"))
    shown = F.create_map(F.lit("chunk_id"), "chunk_id", F.lit("doc_id"), "doc_id", F.lit("page"), F.col("page").cast("string"), F.lit("text"), F.substring("text", 1, 500))
    record = lambda k, kind, props, by: F.struct(k.alias("key"), F.lit(kind).alias("type"), props.alias("props"), by.alias("provenance"))
    both = F.array(record(key, "Equipment", F.create_map(F.lit("tag"), F.col("tag")), stamp), record(chunk, "Chunk", shown, plain))
    nodes = said.select(F.posexplode(both).alias("pos", "x"), F.array("doc_id").alias("doc_ids")).select("x.*", "doc_ids", F.col("pos").cast("long").alias("ord"))
    edges = said.select(chunk.alias("source"), F.lit("MENTIONS").alias("type"), key.alias("target"), stamp.alias("provenance"), F.lit(0).cast("long").alias("ord"))
    return nodes, edges, said.select("chunk_id", "doc_id", "page", F.lit(None).cast("int").alias("row"), "text")


def heard(rows: DataFrame) -> DataFrame:
    """Notes with the tags and codes that they name and their order: what :func:`notes` would find anew for each table."""
    body = F.coalesce("transcript", F.lit(""))
    return rows.withColumns({"tags": X.extract_tags(body), "codes": X.failure_codes(body), "o": F.monotonically_increasing_id()})


def notes(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and chunks of spoken notes (note_id, transcript, role or null; :func:`heard` or not yet): about every
    tag and code named."""
    body = F.coalesce("transcript", F.lit(""))
    role = F.coalesce("role", F.when(F.contains(F.lower(body), F.lit("operator")), "Senior Operator").otherwise("Field Staff"))
    stamp = F.array(provenance(F.col("note_id"), "asr", 0.9))
    note, chunk_id = F.concat(F.lit("TacitNote:"), "note_id"), F.concat("note_id", F.lit("::t"))
    chunk = F.concat(F.lit("Chunk:"), chunk_id)
    rows = rows if {"tags", "codes", "o"} <= set(rows.columns) else heard(rows)
    node = lambda key, kind, props: F.struct(key.alias("key"), F.lit(kind).alias("type"), F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]).alias("props"), stamp.alias("provenance"))
    edge = lambda kind, a, b: F.struct(a.alias("source"), F.lit(kind).alias("type"), b.alias("target"), stamp.alias("provenance"))
    nodes = F.concat(
        F.array(node(note, "TacitNote", {"note_id": F.col("note_id"), "author_role": role, "transcript": F.substring(body, 1, 500)}), node(chunk, "Chunk", {"chunk_id": chunk_id, "doc_id": F.col("note_id"), "page": F.lit(1), "text": F.substring(body, 1, 500)})),
        F.transform("codes", lambda c: node(F.concat(F.lit("FailureMode:"), c), "FailureMode", {"code": c, "name": X.failure_name(c)})),
    )
    at = lambda t: F.concat(F.lit("Equipment:"), t)
    edges = F.concat(F.flatten(F.transform("tags", lambda t: F.array(edge("ABOUT", note, at(t)), edge("MENTIONS", chunk, at(t))))), F.transform("codes", lambda c: edge("ABOUT", note, F.concat(F.lit("FailureMode:"), c))))
    return _exploded(rows, nodes, "o", None).withColumn("doc_ids", F.transform("provenance", lambda p: p["doc_id"])), _exploded(rows, edges, "o", None), rows.select(chunk_id.alias("chunk_id"), F.col("note_id").alias("doc_id"), F.lit(1).alias("page"), F.lit(None).cast("int").alias("row"), body.alias("text"))


def document_nodes(entries: DataFrame) -> DataFrame:
    """Document nodes of manifest entries."""
    fields = [c for c in ("doc_id", "filename", "doc_type", "source_kind", "page_count") if c in entries.columns]
    props = F.map_from_arrays(F.array(*[F.lit(c) for c in fields], F.lit("ingest_time")), F.array(*[F.col(c).cast("string") for c in fields], F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")))
    return entries.select(F.concat(F.lit("Document:"), "doc_id").alias("key"), F.lit("Document").alias("type"), props.alias("props"), F.array(provenance(F.col("doc_id"), "seed")).alias("provenance"), F.array("doc_id").alias("doc_ids"), F.monotonically_increasing_id().alias("ord"))


EMPTY_PROVENANCE = f"cast(array() as array<{PROVENANCE}>)"
#: A place on a drawing may be passed so near, and so much of a line must be ink.
PASS_NEAR, INK_SHARE = 30.0, 0.9


def drawing(layer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols (tag, cls, x, y, bbox) and text tags (text, bbox) of layer rows with nested arrays."""
    symbols = layer.select(F.posexplode("symbols").alias("pos", "s")).select("pos", X.normalize_tag("s.tag").alias("tag"), F.col("s.cls").alias("cls"), F.col("s.center")[0].alias("x"), F.col("s.center")[1].alias("y"), F.col("s.bbox").alias("bbox"))
    return symbols, layer.select(F.posexplode("tags").alias("pos", "t")).select("pos", X.normalize_tag("t.text").alias("text"), F.col("t.bbox").alias("bbox"))


def read_drawing(seen: DataFrame, measured: DataFrame, seen_pairs: DataFrame, measured_pairs: DataFrame, cell: str = "drawing") -> tuple[DataFrame, DataFrame]:
    """Symbols and connections by drawing: what a vision model saw, else what geometry measured; where the model saw
    symbols and no connections, those are borrowed from geometry.  A drawing that neither read has no rows."""
    by_model = seen.select(cell).distinct()
    symbols = seen.unionByName(measured.join(by_model, cell, "left_anti"))
    pairs = seen_pairs.join(by_model, cell, "left_semi").unionByName(measured_pairs.join(seen_pairs.join(by_model, cell, "left_semi").select(cell).distinct(), cell, "left_anti"))
    return symbols, pairs


def normalised_reading(raw: DataFrame, cell: str = "drawing") -> tuple[DataFrame, DataFrame]:
    """Symbols (tag, cls, x, y, bbox) and pairs (a_tag, b_tag) out of a vision model's answer: ``symbols`` (array of tag,
    cls, bbox) and ``connections`` (array of arrays of tags).  Symbols without a tag and pairs that aren't of two tags
    are left out; a centre is that of its box."""
    named = F.filter("symbols", lambda s: F.coalesce(F.trim(s["tag"]), F.lit("")) != "")
    box = F.col("s.bbox")
    symbols = raw.select(cell, F.explode(named).alias("s")).select(cell, X.normalize_tag("s.tag").alias("tag"), F.col("s.cls").alias("cls"), (F.get(box, F.lit(0)) + F.get(box, F.lit(2)) / 2).alias("x"), (F.get(box, F.lit(1)) + F.get(box, F.lit(3)) / 2).alias("y"), box.alias("bbox"))
    pairs = F.filter("connections", lambda p: (F.size(p) == 2) & F.forall(p, lambda t: F.coalesce(F.trim(t), F.lit("")) != ""))
    return symbols, raw.select(cell, F.explode(pairs).alias("p")).select(cell, X.normalize_tag(F.col("p")[0]).alias("a_tag"), X.normalize_tag(F.col("p")[1]).alias("b_tag"))


def drawing_records(symbols: DataFrame, pairs: DataFrame, cell: str = "drawing") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of what drawings show: equipment with the type that its symbol stands for and its box on the
    sheet, the drawing it is from, and what is connected.

    ``symbols``: drawing (a document's id), tag, cls, bbox; ``pairs``: drawing, a_tag, b_tag; either may name its
    ``reader`` (geometry otherwise).  Symbols without a tag are left out."""
    kinds = F.create_map(*[F.lit(x) for pair in V.SYMBOL_TYPES.items() for x in pair])
    reader = lambda df: F.col("reader") if "reader" in df.columns else F.lit("geometry")
    order = lambda df: (F.col("pos") if "pos" in df.columns else F.lit(0)).cast("long").alias("ord")
    key = lambda c: F.concat(F.lit("Equipment:"), X.normalize_tag(c))
    shown = symbols.where(F.trim(F.coalesce("tag", F.lit(""))) != "")
    props = F.map_filter(F.create_map(F.lit("tag"), X.normalize_tag("tag"), F.lit("type"), F.try_element_at(kinds, F.coalesce("cls", F.lit("")))), lambda _, v: v.isNotNull())
    stamp = F.array(provenance(F.col(cell), reader(shown), 0.85, bbox=F.transform("bbox", lambda v: F.round(v, 1))))
    made = shown.select(key("tag").alias("key"), F.lit("Equipment").alias("type"), props.alias("props"), stamp.alias("provenance"), F.array(F.col(cell)).alias("doc_ids"), order(shown), cell)
    origin = made.select(F.col("key").alias("source"), F.lit("EXTRACTED_FROM").alias("type"), F.concat(F.lit("Document:"), cell).alias("target"), "provenance", "ord", cell)
    lines = pairs.select(key("a_tag").alias("source"), F.lit("CONNECTED_TO").alias("type"), key("b_tag").alias("target"), F.array(provenance(F.col(cell), reader(pairs), 0.8)).alias("provenance"), order(pairs), cell)
    return made, origin.unionByName(lines)


def unobstructed(symbols: DataFrame, near: float = PASS_NEAR, cell: str = "drawing") -> DataFrame:
    """Pairs a < b of symbols of one drawing without a third centre within ``near`` of the segment's inner part.

    ``symbols``: drawing, tag, x, y.  What is near a symbol hides most of its sheet, so its partners are thinned out by
    third centres from the nearest on and triples aren't enumerated.  A task holds one drawing's centres and answers for
    a tile of about a thousand of them."""
    named = symbols.select(cell, "tag", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(F.col(cell).isNotNull() & F.col("tag").isNotNull())
    tiles = named.groupBy(cell).agg(F.ceil(F.count("*") / TILE_SYMBOLS).cast("int").alias("tiles"))
    spread = named.join(tiles, cell).withColumn("own", F.pmod(F.xxhash64("x", "y"), F.col("tiles")).cast("int"))
    spread = spread.select(cell, "tag", "x", "y", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    spread = spread.select(cell, "tile", "tag", "x", "y", (F.col("own") == F.col("tile")).alias("asks"))
    kinds = dict(symbols.dtypes)
    made = f"`{cell}` {kinds[cell]}, a_tag {kinds['tag']}, a_x double, a_y double, b_tag {kinds['tag']}, b_x double, b_y double"
    # Small rows and much work: a given number of partitions isn't coalesced by size.
    spark = symbols.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return spread.repartition(tasks, cell, "tile").groupBy(cell, "tile").applyInArrow(_visible_pairs(near, cell), made)


#: Symbols of a drawing that one task answers for, and pairs that it gathers before it hands them on.
TILE_SYMBOLS, PAIR_ROWS = 1024, 1 << 20


def _visible_pairs(near: float, cell: str):
    """The function of one tile for :func:`unobstructed`: the rows of a drawing, those that it asks for marked."""
    import numpy as np
    import pyarrow as pa

    def visible(p, x, y, alive, sure):
        """Of the places ``alive`` those that no place of ``sure`` hides from ``p``; the arithmetic is that of the SQL."""
        dx, dy = x[alive] - x[p], y[alive] - y[p]
        vx, vy = x[sure] - x[p], y[sure] - y[p]
        far = vx * vx + vy * vy
        order = np.argsort(far, kind="stable")
        vx, vy, far = vx[order], vy[order], far[order]
        length2 = dx * dx + dy * dy
        at, step = 0, 1
        while at < len(far) and len(alive):
            reach = np.nanmax(length2) if not np.isnan(length2).all() else 0.0
            if far[at] > (0.9025 * reach + near * near) * (1 + 1e-9):  # further ones lie beyond what is left
                break
            cx, cy = vx[at : at + step, None], vy[at : at + step, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = (cx * dx + cy * dy) / length2
                off = np.abs(cx * dy - cy * dx) / np.sqrt(length2)
            left = ~((length2 > 0) & (t > 0.05) & (t < 0.95) & (off < near)).any(axis=0)
            if not left.all():
                alive, dx, dy, length2 = alive[left], dx[left], dy[left], length2[left]
            at += step
            step = max(1, min(2 * step, 256, (1 << 18) // max(1, len(alive))))
        return alive

    def run(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).combine_chunks()
        # The names in their order as numbers; places, and the rows of each.
        names, rank = np.unique(np.array(column("tag").to_pylist(), dtype=object), return_inverse=True)
        xy = np.stack([column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], axis=1) + 0.0
        places, place = np.unique(xy, axis=0, return_inverse=True)
        place = place.reshape(-1)
        x, y = places[:, 0], places[:, 1]
        rows = np.argsort(place, kind="stable")
        first = np.searchsorted(place[rows], np.arange(len(places) + 1))
        # A third symbol must bear a name other than the pair's.  That is sure of one whose name is there once, and
        # where there are three names; rows of the other places are looked at one by one.
        alone = np.bincount(rank, minlength=len(names))[rank] == 1
        distinct = np.bincount(np.unique(np.stack([place, rank], axis=1), axis=0)[:, 0], minlength=len(places))
        known = np.isfinite(x) & np.isfinite(y)
        certain = (np.bincount(place, weights=alone, minlength=len(places)) > 0) | (distinct >= 3)
        sure = np.flatnonzero(known & certain)
        doubtful = np.flatnonzero((known & ~certain)[place])
        lowest, highest = np.full(len(places), len(names)), np.full(len(places), -1)
        np.minimum.at(lowest, place, rank)
        np.maximum.at(highest, place, rank)
        out, held = [], 0
        left, right = [], []

        def flush():
            a, b = (np.concatenate(side) if side else np.empty(0, int) for side in (left, right))
            values = [column(cell).take(pa.array(a)), *(v for i in (a, b) for v in (column("tag").take(pa.array(i)), *(column(c).take(pa.array(i)) for c in ("x", "y"))))]
            out.append(pa.Table.from_arrays(values, names=[cell, "a_tag", "a_x", "a_y", "b_tag", "b_x", "b_y"]))
            left.clear()
            right.clear()

        for p in np.unique(place[column("asks").to_numpy(zero_copy_only=False).astype(bool)]):
            seen = np.flatnonzero(highest > lowest[p])
            if known[p]:
                seen = visible(p, x, y, seen, sure)
            a = rows[first[p] : first[p + 1]]
            sizes = first[seen + 1] - first[seen]
            b = rows[np.repeat(first[seen] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())] if len(seen) else np.empty(0, int)
            i, j = np.nonzero(rank[a][:, None] < rank[b][None, :])
            i, j = a[i], b[j]
            dx, dy = xy[j, 0] - x[p], xy[j, 1] - y[p]
            length2 = dx * dx + dy * dy
            for c in doubtful if len(i) else ():
                cx, cy = xy[c, 0] - x[p], xy[c, 1] - y[p]
                with np.errstate(divide="ignore", invalid="ignore"):
                    t, off = (cx * dx + cy * dy) / length2, np.abs(cx * dy - cy * dx) / np.sqrt(length2)
                clear = ~((length2 > 0) & (t > 0.05) & (t < 0.95) & (off < near) & (rank[i] != rank[c]) & (rank[j] != rank[c]))
                i, j, dx, dy, length2 = i[clear], j[clear], dx[clear], dy[clear], length2[clear]
            left.append(i)
            right.append(j)
            held += len(i)
            if held >= PAIR_ROWS:
                flush()
                held = 0
        flush()
        return pa.concat_tables(out)

    return run


def inked(pairs: DataFrame, ink: DataFrame, samples: int = 160, reach: int = 3, least: float = INK_SHARE, cell: str = "drawing", margin: float = 6.0, boxes: DataFrame | None = None) -> DataFrame:
    """Pairs whose line is ink for the most part: points on the segment, those in either symbol's box left out, with an
    ink pixel (drawing, x, y) within ``reach``."""
    u = F.col("k") / samples
    points = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples))).alias("k")).select(cell, "a_tag", "b_tag", "k", F.round(F.col("a_x") + u * (F.col("b_x") - F.col("a_x"))).cast("int").alias("px"), F.round(F.col("a_y") + u * (F.col("b_y") - F.col("a_y"))).cast("int").alias("py"))
    if boxes is not None:  # drawing, tag, bbox (x, y, width, height)
        for p in ("a", "b"):
            b = boxes.select(cell, F.col("tag").alias(f"{p}_tag"), F.col("bbox").alias("box"))
            inside = F.col("px").between(F.col("box")[0] - margin, F.col("box")[0] + F.col("box")[2] + margin) & F.col("py").between(F.col("box")[1] - margin, F.col("box")[1] + F.col("box")[3] + margin)
            points = points.join(b, [cell, f"{p}_tag"]).where(~inside).drop("box")
    spread = ink.select(cell, F.explode(F.sequence(F.col("x") - reach, F.col("x") + reach)).alias("px"), "y").select(cell, "px", F.explode(F.sequence(F.col("y") - reach, F.col("y") + reach)).alias("py")).distinct().withColumn("ink", F.lit(1.0))
    share = points.join(spread, [cell, "px", "py"], "left").groupBy(cell, "a_tag", "b_tag").agg(F.avg(F.coalesce("ink", F.lit(0.0))).alias("share"))
    return pairs.join(share.where(F.col("share") >= least), [cell, "a_tag", "b_tag"])


def tiles(width: int, height: int, size: int = 1024, overlap: int = 128):
    """x, y, width, height of overlapping tiles that cover an image, as a column of an array."""
    step = size - overlap
    xs = F.sequence(F.lit(0), F.lit(max(0, width - overlap - 1)), F.lit(step))
    ys = F.sequence(F.lit(0), F.lit(max(0, height - overlap - 1)), F.lit(step))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y"), F.least(F.lit(size), F.lit(width) - x).alias("width"), F.least(F.lit(size), F.lit(height) - y).alias("height")))))

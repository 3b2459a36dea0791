from pyspark.sql import functions as F
from test_analytics import INCIDENT, RULES, SOP, mini
from test_graph import edges, nodes

from opsgraph.functions.register import register
from opsgraph.operators import rank
from opsgraph.plans import ask as A
from opsgraph.plans import ingest


def test_ask(spark):
    n, e, chunks = mini(spark)
    groups = rank.describe(spark.createDataFrame([("a", "Equipment", "P-101A"), ("a", "FailureMode", "VIB"), ("b", "Procedure", "SOP-17")], "community string, type string, label string"))
    assert [(r.id, r["size"], r.summary) for r in groups.orderBy("id").collect()] == [(1, 2, "Equipment: P-101A; FailureMode: VIB"), (2, 1, "Procedure: SOP-17")]
    corpus = A.Corpus(n, e, chunks, groups)
    got = A.ask(corpus, "Which procedure governs pump P-101A and why", k=3)
    assert got.mode == "multihop" and got.seeds == ["Equipment:P-101A"] and got.path and got.citations and "Graph path" in got.text
    assert A.ask(corpus, "Weather of tomorrow somewhere").mode == "refusal"
    assert A.ask(corpus, "Most common failures of VIB overall").mode == "global"
    assert A.ask(corpus, "pump P-101A seal", baseline=True).mode == "lookup"
    assert A.ask(corpus, "what is this", seeds=["Equipment:P-101A"], k=3).mode == "multihop"


def test_ingest(spark):
    docs = spark.createDataFrame([(0, "D1", "sop", [SOP]), (1, "D2", "regulatory", [RULES, ""]), (2, "D3", "incident", [INCIDENT])], "pos int, doc_id string, doc_type string, pages array<string>")
    n, e, counts, chunks = ingest.add_prose(nodes(spark, []), edges(spark, []), docs)
    keys = {r.key for r in n.collect()}
    assert {"Document:D1", "Procedure:SOP-17", "Equipment:P-101A", "RegulatoryClause:OISD-STD-105:7.3", "Incident:INC-2022-014", "Chunk:D1::p1::c0"} <= keys
    links = {(r.source, r.type, r.target) for r in e.collect()}
    assert {("Procedure:SOP-17", "GOVERNS", "Equipment:P-101A"), ("Chunk:D3::p1::c0", "MENTIONS", "Incident:INC-2022-014"), ("Incident:INC-2022-014", "EXTRACTED_FROM", "Document:D3"), ("RegulatoryClause:OISD-STD-105:6.2", "COVERS", "Equipment:V-12")} <= links
    c = counts.first()
    assert c.edges_added == len(links) and c.nodes_added == len(keys) and chunks.count() == 3
    again = ingest.add_prose(n, e, docs)
    assert tuple(again[2].first()) == (0, 0)


def test_sql_functions(spark):
    register(spark, llm=lambda texts: [f'{{"n": {len(t)}}}' for t in texts])
    r = spark.sql("select normalize_tag('p 101-a') a, normalize_tag('x y') b, tag_prefix('FV-2') c, within_one_edit('ab', 'abc') d, edge_key('s', 'T', 't') e, index_tokens('A-1 b') f, llm_extract('abc') g").first()
    assert tuple(r) == ("P-101A", "X Y", "FV-", True, "s-[T]->t", ["a-1", "b"], '{"n": 3}')
    rows = spark.sql("select * from extract_entities('P101A, p-101a, SOP-17 and L-99')").collect()
    assert [tuple(x) for x in rows] == [("Equipment", "P-101A"), ("Procedure", "SOP-17")]
    rows = spark.sql("select d.i, e.kind, e.value from values (1, 'P-10 wo-3'), (2, null), (3, 'INC-2020-1 and XY-12') d(i, s), lateral extract_entities(d.s) e")
    assert sorted(map(tuple, rows.collect())) == [(1, "Equipment", "P-10"), (1, "WorkOrder", "WO-3"), (3, "Incident", "INC-2020-1")]
    assert spark.createDataFrame([("P-1 P-22",)], "t string").select(F.size(F.split("t", " "))).first()[0] == 2


def test_build_and_evaluate(spark):
    """A manifest of every kind of document becomes one graph; built again it adds nothing; the report has all parts."""
    from opsgraph.plans import evaluate

    rows = [(0, "D1", "sop", None, None), (1, "W1", "work_order", None, None), (2, "D3", "incident", None, None), (3, "I1", "inspection", "p101a", True), (4, "VN-1", "voice_note", None, None), (5, "D9", "pnid", None, None)]
    entries = spark.createDataFrame(rows, "pos int, doc_id string, doc_type string, equipment string, overdue boolean")
    pages = spark.createDataFrame([("D1", [SOP]), ("D3", [INCIDENT]), ("D8", ["not in the manifest, P-900"])], "doc_id string, pages array<string>")
    orders = spark.createDataFrame([(0, "WO-1", "2024-01-02", "V-12", "Corrective", "seal leakage", "replaced", "Jo Doe")], "row int, WO_ID string, Date string, Equipment_Tag string, Type string, Problem_Text string, Action_Text string, Technician string")
    notes = spark.createDataFrame([("VN-1", "P-101A has vibration"), ("VN-2", "T-500 isn't known")], "note_id string, transcript string")
    drawings = spark.createDataFrame([("D9", "p101a", "pump", [1.0, 2.0, 3.0, 4.0])], "drawing string, tag string, cls string, bbox array<double>"), spark.createDataFrame([("D9", "P-101A", "V-12")], "drawing string, a_tag string, b_tag string")
    n, e, counts, chunks = map(rank.checkpointed, ingest.build(entries, pages, {"W1": orders}, notes, drawings))
    got, links = {r.key: r for r in n.collect()}, {(r.source, r.type, r.target) for r in e.collect()}
    assert {f"Document:{r[1]}" for r in rows} | {"Procedure:SOP-17", "WorkOrder:WO-1", "TacitNote:VN-1", "Chunk:I1::insp", "Incident:INC-2022-014"} <= set(got)
    assert not {"Equipment:P-900", "Equipment:T-500", "TacitNote:VN-2"} & set(got)
    assert got["Equipment:P-101A"].props["type"] == "pump" and {"D1", "D3", "D9", "I1"} <= set(got["Equipment:P-101A"].doc_ids)
    assert {("Equipment:P-101A", "CONNECTED_TO", "Equipment:V-12"), ("WorkOrder:WO-1", "PERFORMED_ON", "Equipment:V-12"), ("Procedure:SOP-17", "GOVERNS", "Equipment:P-101A"), ("Chunk:I1::insp", "MENTIONS", "Equipment:P-101A")} <= links
    assert counts.first().edges_added == len(links) and {r.doc_id for r in chunks.collect()} == {"D1", "W1", "D3", "I1", "VN-1"}
    again = ingest.build(entries, pages, {"W1": orders}, notes, drawings, nodes=n, edges=e)
    assert tuple(again[2].first()) == (0, 0)
    gold = spark.createDataFrame([("Equipment", "Equipment:P-101A"), ("Equipment", "Equipment:X-1")], "type string, key string")
    gold_edges = spark.createDataFrame([("PERFORMED_ON", "WorkOrder:WO-1", "Equipment:V-12")], "type string, source string, target string")
    asked = spark.createDataFrame([("T1", "What vibration has pump P-101A", ["vibration"], ["VN-1", "D3"])], "tier string, question string, expects array<string>, docs array<string>")
    verdicts = spark.createDataFrame([("7.3", "GAP", 0.0, None)], "clause string, verdict string, coverage double, procedure string")
    told = evaluate.report(A.Corpus(n, e, chunks), gold, gold_edges, asked, verdicts, {"vector_only": {"baseline": True}})
    assert "| node | Equipment | 2 | 1 | 50.0 |" in told and "| edge | PERFORMED_ON | 1 | 1 | 100.0 |" in told and "| T1 | vector_only | 100.0 | 100.0 |" in told and "## Linkage" in told

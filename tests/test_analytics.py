import datetime as dt
import math

from pyspark.sql import functions as F
from test_graph import edges, nodes

from opsgraph.operators import compliance, dossier, extract, patterns, qa, resolve
from opsgraph.operators import graph as G


def seal_history(spark):
    """Four seal failures, three of them 10 to 26 days after vibration, and one vibration long before."""
    start = dt.date(2021, 7, 1)
    rows = []
    for k, day in enumerate((150, 560, 985, 1420)):
        at = start + dt.timedelta(day)
        rows.append(("P-101A", f"S{k}", "WorkOrder", at, ["ELP"], "mechanical seal leak"))
        if k:
            rows.append(("P-101A", f"V{k}", "WorkOrder", at - dt.timedelta(8 * k + 2), ["VIB"], "high vibration"))
    rows.append(("P-101A", "V9", "WorkOrder", start, ["VIB"], "vibration"))
    rows.append(("P-101A", "U1", "Incident", None, ["ELP"], ""))
    return spark.createDataFrame(rows, "asset string, event_id string, kind string, day date, codes array<string>, text string")


def test_seal_card(spark):
    events = seal_history(spark)
    card = patterns.pattern_cards(events).first()
    assert (card.asset, card.code, card.component, card.events, card.precursor, card.matched, card.target_total) == ("P-101A", "ELP", "mechanical seal", 4, "VIB", 3, 4)
    assert card.span_years == 3.5 and card.strength == round(4 * (0.1 + 3 * 0.75**2), 2) and card.failure_name == "mechanical seal external leakage (process medium)"
    assert "leading indicator" in card.recommendation and card.evidence == ["S0", "S1", "S2", "S3"]
    causes = patterns.mine_causes(patterns.pattern_cards(events))
    assert [(r.code, r.cause, r.confidence) for r in causes.collect()] == [("ELP", "VIB", 0.75)]
    assert patterns.cause_edges(causes).first().target == "FailureMode:VIB"
    seen = patterns.observed_in(spark.createDataFrame([("mech seal leak on p101a, mechanical seal",)], "text string"))
    ranked = patterns.rank_causes(seen.select("asset", "code", "component"), events, causes).collect()
    assert [(r.cause, r.score, r.basis) for r in ranked] == [("VIB", 2 * 0.75 + 1.5 * 0.75, "preceded 3/4 past events")]
    assert patterns.timeline(events).count() == 8


def test_compliance_finds_the_gap(spark):
    clauses = spark.createDataFrame([("7.3", "Gas testing shall be done before confined space entry"), ("6.2", "Lock and tag isolation of energy"), ("9.9", "")], "clause string, text string")
    procedures = spark.createDataFrame([("SOP-17", "Confined space entry. Obtain entry permit."), ("SOP-2", "Apply lock and isolation to energy sources")], "procedure string, text string")
    requires = spark.createDataFrame([("SOP-17", "7.3")], "procedure string, clause string")
    covers = spark.createDataFrame([("6.2", "P-101A"), ("7.3", "V-12")], "clause string, equipment string")
    governs = spark.createDataFrame([("SOP-2", "P-101A"), ("SOP-2", "V-12")], "procedure string, equipment string")
    out = compliance.scan(clauses, procedures, requires, covers, governs)
    assert [(r.clause, r.verdict, r.procedure) for r in out.collect()] == [("7.3", "GAP", "SOP-17"), ("6.2", "covered", "SOP-2")]
    assert tuple(compliance.counts(out).first()) == (1, 0, 1)
    assert compliance.report(out).first().line.startswith("FINDING: clause 7.3")
    assert [r.clause for r in compliance.scan(clauses, procedures, requires, covers, governs, "p-101").collect()] == ["6.2"]
    assert [r.verdict for r in compliance.scan(clauses, procedures.limit(0), requires.limit(0), covers.limit(0), governs).collect()] == ["GAP", "GAP"]


SOP = "SOP-17  Confined Space Entry  (Rev 3)\nApplicable Equipment\nP-101A, V-12\nReferenced Standards\nOISD-STD-105 clause 7.3. OISD-STD-105 clause 6.2.\nProcedure\n1. Enter E-99"
RULES = "OISD-STD-105  Work Permit System\nClause 7.3\nGas testing before entry.\nClause 6.2\nIsolation of energy.\nApplicability\nall\nReferenced equipment: P-101A, V-12"
INCIDENT = "Incident ID INC-2022-014\nDate\n2022-03-04\nSeverity\nminor\nPump P101A high vibration"


def documents(spark):
    return spark.createDataFrame([("d1", "sop", SOP), ("d2", "regulatory", RULES), ("d3", "incident", INCIDENT), ("d4", "sop", "no title, P-77 noisy"), ("d5", "other", None)], "doc_id string, doc_type string, text string")


def test_extraction(spark):
    n, e = extract.extract(documents(spark))
    by = {}
    for r in n.collect():
        by.setdefault(r.doc_id, []).append((r.type, {k: v for k, v in r.props.items() if v}, r.confidence))
    assert by["d1"] == [("Procedure", {"sop_id": "SOP-17", "title": "Confined Space Entry", "revision": "3"}, 0.9), ("Equipment", {"tag": "P-101A"}, 0.85), ("Equipment", {"tag": "V-12"}, 0.85)]
    assert [x[1]["clause_no"] for x in by["d2"]] == ["7.3", "6.2"] and by["d2"][0][1]["text_summary"] == "Gas testing before entry."
    assert by["d3"] == [("Incident", {"incident_id": "INC-2022-014", "date": "2022-03-04", "severity": "minor"}, 0.9), ("Equipment", {"tag": "P-101A"}, 0.85), ("FailureMode", {"code": "VIB"}, 0.7)]
    assert by["d4"] == [("Equipment", {"tag": "P-77"}, 0.6), ("FailureMode", {"code": "NOI"}, 0.55)] and "d5" not in by
    links = {(r.doc_id, r.type, r.source_ref, r.target_ref) for r in e.collect()}
    assert {("d1", "GOVERNS", "SOP-17", "V-12"), ("d1", "REQUIRES", "SOP-17", "OISD-STD-105:7.3"), ("d2", "COVERS", "OISD-STD-105:6.2", "P-101A"), ("d3", "EXHIBITS", "INC-2022-014", "VIB")} <= links
    assert len(links) == 2 + 2 + 4 + 2


def test_resolution(spark):
    known = spark.createDataFrame([("Equipment:P-101A", 0), ("Equipment:V-13", 1)], "key string, ord long")
    n, e = resolve.resolve(*extract.extract(documents(spark).where("doc_id in ('d1', 'd3')")), known)
    keys = {(r.doc_id, r.key) for r in n.collect()}
    assert {("d1", "Equipment:P-101A"), ("d1", "Equipment:V-13"), ("d1", "Procedure:SOP-17"), ("d3", "Incident:INC-2022-014")} <= keys and ("d1", "Equipment:V-12") not in keys
    links = {(r.source, r.type, r.target) for r in e.collect()}
    assert {("Procedure:SOP-17", "GOVERNS", "Equipment:V-13"), ("Procedure:SOP-17", "REQUIRES", "RegulatoryClause:OISD-STD-105:7.3"), ("Incident:INC-2022-014", "EXHIBITS", "FailureMode:VIB")} <= links


def test_fold_within_a_document(spark):
    rows = spark.createDataFrame([("d", 0, "P-900"), ("d", 1, "P-901"), ("d", 2, "Q-900"), ("e", 0, "P-901")], "doc_id string, pos int, tag string")
    none = spark.createDataFrame([], "tag string, ord long")
    assert {(r.doc_id, r.tag, r.final) for r in resolve.resolve_tags(rows, none).collect()} == {("d", "P-900", "P-900"), ("d", "P-901", "P-900"), ("d", "Q-900", "Q-900"), ("e", "P-901", "P-901")}
    words = ["", "a", "ab", "abc", "abd", "acb", "b", "xabc", "abcx", "axbc"]
    import itertools

    pairs = list(itertools.product(words, words))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", (F.levenshtein("a", "b") <= 1).alias("near")).collect()
    assert {(r.a, r.b): r.near for r in got} == {(a, b): resolve._one_edit(a, b) for a, b in pairs}


def test_work_orders_notes_inspections(spark):
    rows = spark.createDataFrame([(0, "WO-1", "2024-01-02", "p101a", "Corrective", "mech seel lkg", "replaced", "Jo Doe"), (1, "WO-2", None, None, None, None, None, None)], "row int, WO_ID string, Date string, Equipment_Tag string, Type string, Problem_Text string, Action_Text string, Technician string")
    n, e, chunks = extract.work_orders(rows, "DOC-1", {"seel": "seal", "lkg": "leakage"})
    assert {r.key for r in n.collect()} == {"Equipment:P-101A", "WorkOrder:WO-1", "Person:jo doe", "FailureMode:ELP", "Chunk:DOC-1::r0"}
    assert sorted(r.type for r in e.collect()) == ["EXHIBITS", "EXTRACTED_FROM", "MENTIONS", "MENTIONS", "MENTIONS", "PERFORMED_ON"]
    assert chunks.first().text == "WO WO-1 on P-101A: mech seal leakage. replaced"
    n, e, chunks = extract.notes(spark.createDataFrame([("VN-1", "Operator says P-101A has vibration", None)], "note_id string, transcript string, role string"))
    assert {(r.source, r.type, r.target) for r in e.collect()} == {("TacitNote:VN-1", "ABOUT", "Equipment:P-101A"), ("Chunk:VN-1::t", "MENTIONS", "Equipment:P-101A"), ("TacitNote:VN-1", "ABOUT", "FailureMode:VIB")}
    assert n.where("type = 'TacitNote'").first().props["author_role"] == "Senior Operator"
    got = extract.inspections(spark.createDataFrame([("INSP-1", "p101a", True), ("INSP-2", None, None)], "doc_id string, equipment string, overdue boolean")).collect()
    assert [r.text for r in got] == ["Equipment inspection record INSP-1 for P-101A. Inspection status: OVERDUE."]
    best = extract.best_chunk(spark.createDataFrame([("d", "k1", "V-12"), ("d", "k2", "none")], "doc_id string, key string, token string"), spark.createDataFrame([("d", "c0", 0, "a"), ("d", "c1", 1, "has v-12")], "doc_id string, chunk_id string, n int, text string"))
    assert {(r.key, r.chunk_id) for r in best.collect()} == {("k1", "c1"), ("k2", "c0")}


def test_drawing(spark):
    symbols = spark.createDataFrame([("u", "A", 0.0, 0.0), ("u", "B", 100.0, 0.0), ("u", "C", 200.0, 5.0), ("w", "A", 0.0, 0.0)], "drawing string, tag string, x double, y double")
    pairs = extract.unobstructed(symbols)
    assert {(r.a_tag, r.b_tag) for r in pairs.collect()} == {("A", "B"), ("B", "C")}
    ink = spark.createDataFrame([("u", x, 1) for x in range(0, 101)], "drawing string, x int, y int")
    assert {(r.a_tag, r.b_tag) for r in extract.inked(pairs, ink).collect()} == {("A", "B")}
    got = spark.range(1).select(extract.tiles(1950, 1200).alias("t")).first().t
    covered = {(x, y) for t in got for x in range(t.x, t.x + t.width, 50) for y in range(t.y, t.y + t.height, 50)}
    assert max(t.x + t.width for t in got) == 1950 and max(t.y + t.height for t in got) == 1200 and len(covered) > 900


def test_unobstructed_against_all_triples(spark):
    """Crowded sheets, symbols on one spot, names and centres that repeat or lack; a sheet too large for triples."""
    import random

    draw = random.Random(7)
    some = lambda n, names, size: [(d, f"T{draw.randrange(names)}", float(draw.randrange(size)), float(draw.randrange(size))) for d in ("u", "w") for _ in range(n)]
    for rows in (some(40, 10**6, 300), some(40, 30, 100), some(30, 3, 90), [*some(30, 60, 200), ("u", "Z1", None, 5.0), ("u", None, 1.0, 2.0), (None, "Z2", 1.0, 2.0)]):
        symbols = spark.createDataFrame(rows, "drawing string, tag string, x double, y double")
        want = []
        for d, a, ax, ay in rows:
            for e, b, bx, by in rows:
                if None in (d, a, b) or d != e or not a < b:
                    continue
                hidden = False
                for f, c, cx, cy in rows:
                    if f != d or None in (c, ax, ay, bx, by, cx, cy) or c in (a, b) or (ax, ay) == (bx, by):
                        continue
                    dx, dy = bx - ax, by - ay
                    t = ((cx - ax) * dx + (cy - ay) * dy) / (dx * dx + dy * dy)
                    hidden |= 0.05 < t < 0.95 and abs((cx - ax) * dy - (cy - ay) * dx) / math.sqrt(dx * dx + dy * dy) < 30
                if not hidden:
                    want.append((d, a, b))
        assert sorted((r.drawing, r.a_tag, r.b_tag) for r in extract.unobstructed(symbols).collect()) == sorted(want)
    grid = spark.range(3000).select(F.lit("u").alias("drawing"), F.concat(F.lit("G"), "id").alias("tag"), (F.col("id") % 100 * 40).cast("double").alias("x"), (F.floor(F.col("id") / 100) * 40).cast("double").alias("y"))
    pairs = extract.unobstructed(grid)
    assert pairs.where("abs(a_x - b_x) + abs(a_y - b_y) = 40").count() == 99 * 30 + 100 * 29


def test_dossier(spark):
    n = nodes(spark, [("Equipment:P-1", "Equipment", {"tag": "P-1", "name": "pump"}, ["d"]), ("WorkOrder:1", "WorkOrder", {"wo_id": "1", "date": "2024-01-01"}, ["d"]), ("WorkOrder:2", "WorkOrder", {"wo_id": "2", "date": "2024-02-01"}, ["d"]), ("Procedure:S", "Procedure", {"sop_id": "S", "title": "t"}, ["d"]), ("Chunk:INSP-1::insp", "Chunk", {"doc_id": "INSP-1", "text": "status: OVERDUE"}, ["INSP-1"]), ("Equipment:P-2", "Equipment", {"tag": "P-2"}, [])])
    e = edges(spark, [("WorkOrder:1", "PERFORMED_ON", "Equipment:P-1", []), ("WorkOrder:2", "PERFORMED_ON", "Equipment:P-1", []), ("WorkOrder:2", "EXHIBITS", "FailureMode:VIB", []), ("Procedure:S", "GOVERNS", "Equipment:P-1", []), ("Equipment:P-2", "CONNECTED_TO", "Equipment:P-1", []), ("Chunk:INSP-1::insp", "MENTIONS", "Equipment:P-1", [])])
    got = {r.asset: r for r in dossier.dossier(n, e).collect()}
    r = got["Equipment:P-1"]
    assert (r.work_order_count, [w.wo_id for w in r.work_orders], [p.sop_id for p in r.procedures], r.connected_to) == (2, ["2", "1"], ["S"], ["P-2"])
    assert [(f.code, f["count"]) for f in r.failure_modes] == [("VIB", 1)] and r.inspection.overdue
    assert got["Equipment:P-2"].work_order_count == 0


def mini(spark):
    n = nodes(spark, [("Equipment:P-101A", "Equipment", {}, []), ("FailureMode:VIB", "FailureMode", {}, []), ("Procedure:SOP-17", "Procedure", {}, [])] + [(f"Chunk:c{k}", "Chunk", {}, []) for k in range(4)])
    e = edges(spark, [("Chunk:c0", "MENTIONS", "Equipment:P-101A", []), ("Chunk:c1", "MENTIONS", "FailureMode:VIB", []), ("Chunk:c2", "MENTIONS", "Procedure:SOP-17", []), ("Procedure:SOP-17", "GOVERNS", "Equipment:P-101A", []), ("Equipment:P-101A", "CONNECTED_TO", "FailureMode:VIB", [])])
    chunks = spark.createDataFrame([("c0", "pump P-101A seal"), ("c1", "vibration high"), ("c2", "procedure governs pump"), ("c3", "unrelated words")], "chunk_id string, text string")
    return n, e, chunks


def test_questions(spark):
    n, e, chunks = mini(spark)
    asked = spark.createDataFrame([(1, "Which procedure governs P-101A?"), (2, "vibration of p101a and its cause"), (3, "most common failures"), (4, "hello and welcome"), (5, "P-101A and the plant")], "q int, text string")
    assert {r.q: r.mode for r in qa.route(asked, n, "q").collect()} == {1: "lookup", 2: "multihop", 3: "global", 4: "lookup", 5: "multihop"}
    assert {(r.q, r.key) for r in qa.link_entities(asked, n, "q").collect()} == {(1, "Equipment:P-101A"), (2, "Equipment:P-101A"), (2, "FailureMode:VIB"), (5, "Equipment:P-101A")}
    hits = spark.createDataFrame([("c2", 0.03, 1), ("c3", 0.02, 2)], "chunk_id string, score double, rank int")
    found, entities = qa.multihop("Which procedure governs pump P-101A?", n, e, chunks, hits, ["Equipment:P-101A"], steps=5)
    assert found.orderBy(F.desc("score")).first().chunk_id == "c0" and entities.count() == 3
    got = chunks.select(F.lit(1).alias("q"), "chunk_id", "text").unionByName(chunks.where("chunk_id = 'c3'").select(F.lit(4).alias("q"), "chunk_id", "text"))
    gate = {r.q: r for r in qa.gate(got, asked.withColumnRenamed("text", "question"), qa.link_entities(asked, n, "q"), "q", "chunk_id").collect()}
    assert (gate[1].refused, gate[1].support, gate[1].citations, gate[1].confidence) == (False, 2, 4, 0.93)
    assert gate[4].refused and gate[4].confidence == 0.1 and gate[3].refused
    rows = spark.createDataFrame([("The seal of P-101A", ["seal", "x"], ["d1"], ["d1", "d2"]), ("", [], [], [])], "haystack string, expects array<string>, docs array<string>, cited_docs array<string>")
    assert [(r.accuracy, r.cited) for r in qa.score_answers(rows).collect()] == [(0.5, 1.0), (1.0, 1.0)]


def test_streaming_notes(spark, tmp_path):
    from opsgraph.streaming import ingest

    schema = "note_id string, transcript string, role string"
    for k, rows in enumerate([[("VN-1", "P-101A vibration", None)], [("VN-2", "P-101A again noisy", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        q = ingest.ingest_notes(stream, f"{tmp_path}/g", f"{tmp_path}/check")
        q.awaitTermination(120)
        assert q.exception() is None
    n, e = G.load(spark, f"{tmp_path}/g/v1")
    assert {r.key for r in n.where("type <> 'Chunk'").collect()} == {"TacitNote:VN-1", "TacitNote:VN-2", "Equipment:P-101A", "FailureMode:VIB", "FailureMode:NOI"}
    assert e.where("type = 'ABOUT'").count() == 4
    assert [tuple(r)[:4] for r in spark.read.parquet(f"{tmp_path}/g/deltas").orderBy("batch").collect()] == [(0, "note", 3, 3), (1, "note", 3, 3)]


def test_streaming_rates_and_alerts(spark, sf_dir):
    from opsgraph.streaming import ingest

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    q = ingest.event_rates(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(str(r.window.start)[:10], r.event_type): r.n for r in spark.sql("select * from rates").collect()}
    want = {(str(r.day), r.event_type): r.n for r in spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want
    alerts = ingest.precursor_alerts(stream.select(F.col("user_id").alias("asset"), F.col("event_type").alias("code"), "ts"), {"purchase": "view"})
    q = alerts.writeStream.outputMode("complete").format("memory").queryName("alerts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(signals) s from alerts").first().s == spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'view'").count()


def test_readers(spark, tmp_path):
    import json

    from opsgraph.sources import readers, writers

    docs = [{"doc_id": f"D{k}", "filename": f"f{k}", "doc_type": t, "source_kind": "pdf", "page_count": 1} for k, t in enumerate(["sop", "incident", "sop"])]
    (tmp_path / "m.json").write_text(json.dumps({"plant": "x", "generated": "y", "documents": docs}, indent=1))
    assert [r.doc_id for r in readers.manifest(spark, f"{tmp_path}/m.json", ["sop"], 1).collect()] == ["D0"]
    assert [r.pos for r in readers.manifest(spark, f"{tmp_path}/m.json").collect()] == [0, 1, 2]
    (tmp_path / "l.json").write_text(json.dumps({"image": "i", "width": 9, "height": 9, "symbols": [{"tag": "p101a", "cls": "pump", "bbox": [0, 0, 1, 1], "center": [0.5, 0.5]}], "tags": [{"text": "p101a", "bbox": [0, 0, 1, 1]}]}))
    symbols, tags = extract.drawing(readers.layer(spark, f"{tmp_path}/l.json"))
    assert (symbols.first().tag, symbols.first().x, tags.first().text) == ("P-101A", 0.5, "P-101A")
    (tmp_path / "x.csv").write_text("abbrev,expansion\n Seel ,seal\nseel,SEAL\n")
    assert readers.lexicon(spark, f"{tmp_path}/x.csv") == {"seel": "SEAL"}
    (tmp_path / "VN-7.txt").write_text("hello\nP-101A")
    assert tuple(readers.transcripts(spark, f"{tmp_path}/VN-7.txt").first()) == ("VN-7", "hello\nP-101A")
    (tmp_path / "w.csv").write_text("WO_ID,Equipment_Tag\nA,p1\nB,p2\n")
    assert [(r.WO_ID, r.row, r.Technician) for r in readers.work_orders(spark, f"{tmp_path}/w.csv").collect()] == [("A", 0, None), ("B", 1, None)]
    (tmp_path / "q.jsonl").write_text('{"tier": "T1", "question": "a", "expects": ["b"], "docs": []}\n\n')
    assert readers.questions(spark, f"{tmp_path}/q.jsonl").count() == 1
    assert spark.createDataFrame([(["", " "],), (["", "x"],)], "p array<string>").select(readers.has_text("p").alias("h")).collect() == [(False,), (True,)]
    df = spark.range(3)
    assert writers.cached(df, f"{tmp_path}/cache", "1").count() == 3 == writers.cached(spark.range(9), f"{tmp_path}/cache", "1").count()
    assert "| id |" in writers.markdown(df, "t")

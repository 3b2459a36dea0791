import threading

import pytest
from pyspark.sql import functions as F
from test_graph import edges, nodes

from opsgraph.operators import extract, rank, resolve, search
from opsgraph.operators import graph as G
from opsgraph.sources import writers
from opsgraph.streaming import ingest


def note_graph(spark, k):
    n = nodes(spark, [(f"TacitNote:{k}", "TacitNote", {"note_id": str(k)}, ["d"])])
    return n, edges(spark, [(f"TacitNote:{k}", "ABOUT", "Equipment:P-1", ["d"])])


def test_two_streams_share_a_folder(spark, tmp_path):
    """Commits of two streams at once lose nothing; a repeated batch changes nothing, what a failed one left is replaced."""
    folder = f"{tmp_path}/g"
    run = lambda kind, batch: ingest.merge_batch(spark, folder, *note_graph(spark, f"{kind}{batch}"), batch, kind)
    G.save(*note_graph(spark, "left-over"), f"{folder}/v0")
    streams = [threading.Thread(target=lambda kind=kind: [run(kind, b) for b in range(2)]) for kind in ("note", "work_order")]
    [t.start() for t in streams]
    [t.join() for t in streams]
    run("note", 1)
    done = ingest.commits(spark, folder)
    assert [v for v, _, _ in done] == [0, 1, 2, 3] and {(k, b) for _, k, b in done} == {(k, b) for k in ("note", "work_order") for b in range(2)}
    n, e = ingest.current(spark, folder)
    assert {r.key for r in n.collect()} == {"Equipment:P-1", "TacitNote:note0", "TacitNote:note1", "TacitNote:work_order0", "TacitNote:work_order1"} and e.count() == 4
    deltas = spark.read.parquet(f"{folder}/deltas")
    assert sorted((r.kind, r.batch, r.nodes_added, r.edges_added) for r in deltas.collect()) == [(k, b, 1, 1) for k in ("note", "work_order") for b in range(2)]
    sent = [r.message for r in writers.messages(G.summary(n, e), deltas).orderBy("n").collect()]
    assert len(sent) == 5 and '"hello"' in sent[0] and all('"delta"' in m for m in sent[1:])
    for _ in range(2):
        q = ingest.feed(spark, folder, f"{tmp_path}/feed")
        q.awaitTermination(120)
        assert q.exception() is None
    assert spark.read.text(f"{tmp_path}/feed").count() == 4


def test_a_version_holds_its_delta_and_gathers_no_hub(spark, tmp_path):
    """Versions merge to what the deltas give one after another, and follow a whole one; on disk a hub stays in rows of a
    stamp each, nothing is written twice, and counting by type gathers no provenance."""
    folder = f"{tmp_path}/g"
    hub = lambda k, props: nodes(spark, [(f"TacitNote:{k}", "TacitNote", {}, [f"d{k}"]), ("FailureMode:VIB", "FailureMode", props, [f"d{k}"]), ("FailureMode:VIB", "FailureMode", {"name": "later"}, [f"e{k}"])])
    deltas = [(hub(k, props), edges(spark, [(f"TacitNote:{k}", "ABOUT", "FailureMode:VIB", [f"d{k}"]), (f"TacitNote:{k}", "ABOUT", "Equipment:P-1", [f"d{k}"])])) for k, props in enumerate([{"code": "VIB", "name": ""}, {"code": "x"}, {"code": "y", "name": "z"}])]
    whole = G.apply_delta(*G.load(spark, f"{tmp_path}/none"), *deltas[0])
    for start in (0, 1):
        at = f"{folder}{start}"
        if start:
            G.save(*whole[:2], f"{at}/v0")
            (tmp_path / f"g{start}" / "commits").mkdir()
            (tmp_path / f"g{start}" / "commits" / "000000000~note~0").touch()
        for batch in range(start, 3):
            ingest.merge_batch(spark, at, *deltas[batch], batch, "note")
        n, e = ingest.current(spark, at)
        got = {r.key: r for r in n.collect()}
        assert set(got) == {"TacitNote:0", "TacitNote:1", "TacitNote:2", "FailureMode:VIB", "Equipment:P-1"} and e.count() == 6
        vib = got["FailureMode:VIB"]
        assert (vib.type, vib.props, vib.doc_ids) == ("FailureMode", {"code": "VIB", "name": "later"}, ["d0", "d1", "d2", "e0", "e1", "e2"])
        assert [p.doc_id for p in vib.provenance] == ["d0", "e0", "d1", "e1", "d2", "e2"]
        assert len(G.load(spark, f"{at}/v1")[0].where("type = 'TacitNote'").collect()) == 2
        rows = spark.read.parquet(*[f"{at}/parts/v{v}/nodes" for v in range(start, 3)])
        assert rows.count() == 3 * (3 - start) and rows.agg(F.max(F.size("provenance"))).first()[0] == 1
        assert sorted((r.batch, r.nodes_added, r.edges_added) for r in spark.read.parquet(f"{at}/deltas").collect()) == [(0, 2, 2), (1, 1, 2), (2, 1, 2)][start:]
        assert "collect_list" not in G.summary(n, e)._jdf.queryExecution().optimizedPlan().toString()


def test_tags_and_codes_of_a_note_are_found_once(spark, tmp_path, monkeypatch):
    """A batch's nodes, edges and counts read what was heard; it isn't found anew for each of them, and isn't kept."""
    asked = []
    monkeypatch.setattr(extract, "notes", lambda rows, f=extract.notes: asked.append(rows.columns) or f(rows))
    spark.createDataFrame([("N1", "P-101A vibration", None), ("N1", "P-101A vibration", None), ("N2", None, None)], "note_id string, transcript string, role string").write.json(f"{tmp_path}/in")
    q = ingest.ingest_notes(spark.readStream.schema("note_id string, transcript string, role string").json(f"{tmp_path}/in"), f"{tmp_path}/g", f"{tmp_path}/check")
    q.awaitTermination(120)
    assert q.exception() is None and {"tags", "codes", "o"} <= set(asked[0])
    assert writers.names(spark, f"{tmp_path}/g/heard") == []
    assert sorted((r.part, r.type, r.n) for r in G.summary(*ingest.current(spark, f"{tmp_path}/g")).where("type is not null").collect()) == [("edge", "ABOUT", 2), ("edge", "MENTIONS", 1), ("node", "Chunk", 2), ("node", "Equipment", 1), ("node", "FailureMode", 1), ("node", "TacitNote", 2)]


def test_a_broken_snapshot_is_an_error(spark, tmp_path):
    G.save(*note_graph(spark, 1), f"{tmp_path}/g")
    import shutil

    shutil.rmtree(f"{tmp_path}/g/edges")
    with pytest.raises(Exception):
        [df.count() for df in G.load(spark, f"{tmp_path}/g")]


def test_cached_embeddings_and_saved_index(spark, tmp_path):
    from opsgraph.functions import text as X

    chunks = spark.createDataFrame([("a", "pump seal"), ("b", "pump seal"), ("c", None)], "chunk_id string, text string")
    first = search.embedded(chunks, f"{tmp_path}/cache", X.hash_embedding)
    want = {r.chunk_id: r.e for r in chunks.select("chunk_id", X.hash_embedding("text").alias("e")).collect()}
    assert {r.chunk_id: r.embedding for r in first.collect()} == want and spark.read.parquet(f"{tmp_path}/cache").count() == 2
    asked = []
    again = search.embedded(chunks.limit(3).unionByName(spark.createDataFrame([("d", "new")], "chunk_id string, text string")), f"{tmp_path}/cache", lambda t: asked.append(t) or X.hash_embedding(t))
    assert again.count() == 4 and spark.read.parquet(f"{tmp_path}/cache").count() == 3
    search.save_index(first, f"{tmp_path}/index")
    schema = "chunk_id string, text string, embedding array<float>"
    assert search.load_index(spark, f"{tmp_path}/index", schema).count() == 3 and search.load_index(spark, f"{tmp_path}/none", schema).count() == 0


def test_questions_in_blocks(spark):
    rows = spark.range(200).select(F.col("id").alias("key"), (F.col("id") * 7 % 50).cast("double").alias("x"))
    asked = spark.range(20).select(F.col("id").alias("q"), F.col("id").cast("double").alias("y"))
    found = lambda most: sorted(map(tuple, search.against(rows, asked, "q", "key", -F.abs(F.col("x") - F.col("y")), 3, most).collect()))
    assert found(200) == found(6) and len(found(6)) == 60


def test_fuzzy_tags_against_all_pairs(spark):
    import random

    r = random.Random(9)
    tag = lambda: r.choice(["P-", "FV-"]) + "".join(r.choice("123") for _ in range(r.randrange(1, 4)))
    tags, known = {tag() for _ in range(40)}, list(dict.fromkeys(tag() for _ in range(12)))
    got = {x.tag: x.match for x in resolve.fuzzy_tags(spark.createDataFrame([(t,) for t in tags], "tag string"), spark.createDataFrame(list(zip(known, range(12))), "tag string, ord long")).collect()}
    want = {t: next((k for k in known if resolve._prefix(k) == resolve._prefix(t) and (k == t or resolve._one_edit(k, t))), None) for t in tags}
    assert got == {t: k for t, k in want.items() if k}


def test_readings_of_a_drawing(spark):
    raw = spark.createDataFrame([(1, [("p101a", "pump", [0.0, 0.0, 4.0, 2.0]), (None, "x", [0.0] * 4)], [["p101a", "v 12"], ["p101a"], ["a", None]])], "drawing int, symbols array<struct<tag:string,cls:string,bbox:array<double>>>, connections array<array<string>>")
    seen, pairs = extract.normalised_reading(raw)
    assert [(r.tag, r.x, r.y) for r in seen.collect()] == [("P-101A", 2.0, 1.0)] and [tuple(r) for r in pairs.collect()] == [(1, "P-101A", "V-12")]
    kind = "drawing int, tag string"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    symbols, lines = extract.read_drawing(frame([(1, "A"), (2, "B")], kind), frame([(1, "X"), (3, "C")], kind), frame([(1, "A", "A2")], "drawing int, a string, b string"), frame([(1, "X", "Y"), (2, "B", "B2"), (3, "C", "D")], "drawing int, a string, b string"))
    assert sorted(map(tuple, symbols.collect())) == [(1, "A"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, lines.collect())) == [(1, "A", "A2"), (2, "B", "B2"), (3, "C", "D")]


def test_communities_have_modularity(spark):
    """Three cliques in a ring are found; their modularity is that of the formula."""
    cliques = [(f"{c}{i}", f"{c}{j}") for c in "abc" for i in range(5) for j in range(i)]
    pairs = cliques + [("a0", "b0"), ("b1", "c0"), ("c1", "a1")]
    e = edges(spark, [(a, "CONNECTED_TO", b, []) for a, b in pairs])
    n = nodes(spark, [(k, "Equipment", {}, []) for k in sorted({x for p in pairs for x in p})])
    found = rank.communities(n, e, steps=12)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.community, set()).add(r.key[0])
    assert sorted(map(sorted, groups.values())) == [["a"], ["b"], ["c"]]
    assert abs(rank.modularity(e, found) - (30 / 33 - 3 * (22 / 66) ** 2)) < 1e-9
    assert rank.modularity(e.limit(0), found) == 0.0


def test_levels_of_communities(spark):
    """Further levels join whole communities and raise modularity; they end by themselves."""
    pairs = [(f"n{k:02d}", f"n{k + 1:02d}") for k in range(39)]
    e = edges(spark, [(a, "CONNECTED_TO", b, []) for a, b in pairs])
    n = nodes(spark, [(f"n{k:02d}", "Equipment", {}, []) for k in range(40)] + [("alone", "Equipment", {}, [])])
    one, more = ({r.key: r.community for r in rank.communities(n, e, steps=8, levels=k).collect()} for k in (1, 6))
    assert set(one) == set(more) and more["alone"] == "alone"
    assert len({(one[k], more[k]) for k in one}) == len(set(one.values())) > len(set(more.values()))
    at = lambda found: rank.modularity(e, spark.createDataFrame(list(found.items()), "key string, community string"))
    assert at(more) > at(one) + 0.05
    same = {r.key: r.community for r in rank.communities(n, e.limit(0), levels=3).collect()}
    assert same == {k: k for k in one}


def test_drawing_records(spark):
    symbols = spark.createDataFrame([("D9", 0, "p101a", "pump", [1.04, 2.0, 3.0, 4.06]), ("D9", 1, "FV-112", "odd", None), ("D9", 2, " ", "tank", None)], "drawing string, pos int, tag string, cls string, bbox array<double>")
    pairs = spark.createDataFrame([("D9", "p101a", "fv112", "llm_vision")], "drawing string, a_tag string, b_tag string, reader string")
    n, e = extract.drawing_records(symbols, pairs)
    got = {r.key: r for r in n.collect()}
    assert set(got) == {"Equipment:P-101A", "Equipment:FV-112"}
    assert got["Equipment:P-101A"].props == {"tag": "P-101A", "type": "pump"} and got["Equipment:FV-112"].props == {"tag": "FV-112"}
    stamp = got["Equipment:P-101A"].provenance[0]
    assert (stamp.doc_id, stamp.extractor, stamp.confidence, stamp.bbox) == ("D9", "geometry", 0.85, [1.0, 2.0, 3.0, 4.1])
    assert {(r.source, r.type, r.target, r.provenance[0].extractor) for r in e.collect()} == {("Equipment:P-101A", "EXTRACTED_FROM", "Document:D9", "geometry"), ("Equipment:FV-112", "EXTRACTED_FROM", "Document:D9", "geometry"), ("Equipment:P-101A", "CONNECTED_TO", "Equipment:FV-112", "llm_vision")}


def test_nearest_against_all_pairs(spark, monkeypatch):
    """Products against cosines one by one: copies, zeros, nulls, other lengths, NaN; more questions than a block."""
    import random

    draw = random.Random(3)
    vectors = [[draw.gauss(0, 1) for _ in range(5)] for _ in range(150)]
    vectors += [vectors[7]] * 40 + [[0.0] * 5] * 15 + [[-v for v in vectors[7]], None, [1.0, None, 0.0, 0.0, 0.0], [1.0, 2.0], [float("nan")] * 5, [2 * v for v in vectors[7]]]
    order = list(range(len(vectors)))
    draw.shuffle(order)
    rows = spark.createDataFrame([(i, vectors[k]) for i, k in enumerate(order)], "key long, v array<float>")
    asked = rows.select(F.col("key").alias("q"), "v")
    monkeypatch.setattr(search, "QUESTION_ROWS", 90)
    monkeypatch.setattr(search, "PRODUCT_ROWS", 32)
    got = search.nearest(rows, asked, "q", "key", "v", 6)
    want = search.against(rows, asked.select("q", F.col("v").alias("w")), "q", "key", search.cosine(F.col("w"), F.col("v")), 6)
    show = lambda df: sorted((r.q, r["rank"], r.key, repr(r.score)) for r in df.collect())
    assert show(got) == show(want)
    assert search.nearest(rows, asked.limit(0), "q", "key", "v", 6).isEmpty()

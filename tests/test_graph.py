import pytest
from pyspark.sql import functions as F

from opsgraph.operators import graph as G
from opsgraph.operators import rank as R
from opsgraph.operators import search as S


def nodes(spark, rows):
    """Rows (key, type, props, doc ids)."""
    made = [(k, t, p, [(d, "seed", 1.0, None, None, None, None) for d in docs], docs, i) for i, (k, t, p, docs) in enumerate(rows)]
    return spark.createDataFrame(made, G.NODES)


def edges(spark, rows):
    """Rows (source, type, target, doc ids)."""
    made = [(a, t, b, [(d, "seed", 1.0, None, None, None, None) for d in docs], i) for i, (a, t, b, docs) in enumerate(rows)]
    return spark.createDataFrame(made, G.EDGES)


def test_merge_keeps_the_first_value_and_all_provenance(spark):
    a = nodes(spark, [("Equipment:P-1", "Equipment", {"tag": "P-1", "name": ""}, ["d2"])])
    b = nodes(spark, [("Equipment:P-1", "Component", {"name": "pump", "tag": "other"}, ["d1"]), ("Equipment:P-1", "Equipment", {"name": "late"}, ["d2"])]).withColumn("ord", F.col("ord") + 5)
    r = G.merge_nodes(a, b).first()
    assert (r.type, r.props, r.doc_ids, [p.doc_id for p in r.provenance]) == ("Equipment", {"tag": "P-1", "name": "pump"}, ["d1", "d2"], ["d2", "d1", "d2"])
    again = G.merge_nodes(G.merge_nodes(a), a).first()
    assert len(again.provenance) == 2  # a bag


def test_delta_counts_new_rows_and_adds_bare_ends(spark):
    n, e = nodes(spark, [("Equipment:P-1", "Equipment", {}, [])]), edges(spark, [])
    new_n = nodes(spark, [("Equipment:P-1", "Equipment", {}, []), ("WorkOrder:1", "WorkOrder", {}, [])])
    new_e = edges(spark, [("WorkOrder:1", "PERFORMED_ON", "Equipment:P-1", ["d"]), ("WorkOrder:1", "EXHIBITS", "FailureMode:VIB", ["d"]), ("WorkOrder:1", "PERFORMED_ON", "Equipment:P-1", ["d"])])
    n2, e2, counts = G.apply_delta(n, e, new_n, new_e)
    assert tuple(counts.first()) == (1, 2)
    assert {(r.key, r.type) for r in n2.collect()} == {("Equipment:P-1", "Equipment"), ("WorkOrder:1", "WorkOrder"), ("FailureMode:VIB", "FailureMode")}
    assert {(r.type, len(r.provenance)) for r in e2.collect()} == {("PERFORMED_ON", 2), ("EXHIBITS", 1)}


def test_linkage_needs_three_document_types(spark):
    n = nodes(spark, [("Equipment:P-1", "Equipment", {}, ["w"]), ("Equipment:P-2", "Equipment", {}, [])] + [(f"Document:{d}", "Document", {"doc_id": d, "doc_type": t}, []) for d, t in (("w", "work_order"), ("s", "sop"), ("i", "incident"))])
    e = edges(spark, [("Procedure:1", "GOVERNS", "Equipment:P-1", ["s"]), ("Incident:1", "OCCURRED_AT", "Equipment:P-1", ["i", "unlisted"])])
    linked = G.linkage(n, e)
    assert {tuple(r) for r in linked.collect()} == {("Equipment:P-1", 3, True), ("Equipment:P-2", 0, False)}
    assert tuple(G.linkage_share(linked).first()) == (2, 1, 50.0)
    assert tuple(G.linkage_share(linked.limit(0)).first()) == (0, 0, 0.0)


def test_snapshot(spark, tmp_path):
    empty = G.load(spark, f"{tmp_path}/none")
    assert [df.count() for df in empty] == [0, 0]
    n, e = nodes(spark, [("Equipment:P-1", "Equipment", {"tag": "P-1"}, ["d"])]), edges(spark, [("a", "ABOUT", "b", ["d"])])
    G.save(n, e, f"{tmp_path}/g")
    n2, e2 = G.load(spark, f"{tmp_path}/g")
    assert n2.collect() == n.collect() and e2.collect() == e.collect()


def ring(spark):
    n = nodes(spark, [(k, "Equipment", {}, []) for k in "abcdefg"])
    return n, edges(spark, [("a", "CONNECTED_TO", "b", []), ("b", "CONNECTED_TO", "c", []), ("d", "CONNECTED_TO", "c", []), ("e", "CONNECTED_TO", "f", []), ("c", "CONNECTED_TO", "c", [])])


def test_neighbours_ego_paths_components(spark):
    n, e = ring(spark)
    assert sorted((r.other, r.direction) for r in G.incident(e).where("key = 'c'").collect()) == [("b", "in"), ("c", "in"), ("c", "out"), ("d", "in")]
    kept, inside = G.ego(n, e, "b", 1)
    assert sorted(r.key for r in kept.collect()) == ["a", "b", "c"] and inside.count() == 3
    assert R.shortest_path(e, "a", "d") == [("a", "CONNECTED_TO", "b"), ("b", "CONNECTED_TO", "c"), ("c", "CONNECTED_TO", "d")]
    assert R.shortest_path(e, "a", "e") == []
    assert {r.key: r.component for r in R.components(n, e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e", "g": "g"}
    parts = {r.key: r.community for r in R.communities(n, e).collect()}
    assert parts["e"] == parts["f"] != parts["a"] and parts["g"] == "g"


def test_pagerank_against_plain_python(spark):
    n, e = ring(spark)
    keys, out = "abcdefg", {"a": "b", "b": "c", "d": "c", "e": "f", "c": "c"}
    score, home = {k: 1 / 7 for k in keys}, {k: 1.0 if k == "a" else 0.0 for k in keys}
    for _ in range(6):
        loose = sum(score[k] for k in keys if k not in out)
        score = {k: 0.85 * (sum(score[s] for s, t in out.items() if t == k) + loose * home[k]) + 0.15 * home[k] for k in keys}
    got = {r.key: r.score for r in R.pagerank(n, e, ["a", "none"], steps=6).collect()}
    assert got == pytest.approx(score) and sum(got.values()) == pytest.approx(1)
    assert R.pagerank(n, e, ["none"]).count() == 0
    assert len(R.pagerank(n, e, ["a"], steps=2, top=3).collect()) == 3


def test_bm25_and_fusion(spark):
    import math
    import re
    from collections import Counter

    texts = {1: "seal leak on pump", 2: "pump vibration vibration", 3: "valve stuck", 4: "pump seal seal replaced"}
    asked = "seal pump pump"
    tok = {k: re.findall(r"[a-z0-9][a-z0-9\-/]*", t) for k, t in texts.items()}
    df = Counter(w for t in tok.values() for w in set(t))
    idf = {w: math.log(4 - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean_idf, avg = sum(idf.values()) / len(idf), sum(map(len, tok.values())) / 4
    idf = {w: v if v >= 0 else 0.25 * mean_idf for w, v in idf.items()}
    want = {k: sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in asked.split()) for k, t in tok.items() if set(t) & set(asked.split())}
    chunks = spark.createDataFrame(list(texts.items()), "k int, text string")
    got = {r.k: r.score for r in S.bm25(chunks, spark.createDataFrame([(7, asked)], "q int, text string"), "k", "q").collect()}
    assert got == pytest.approx(want)
    first = spark.createDataFrame([(7, 1, 1), (7, 2, 2)], "q int, k int, rank int")
    second = spark.createDataFrame([(7, 2, 1), (7, 3, 2)], "q int, k int, rank int")
    fused = {r.k: r.score for r in S.fuse("q", "k", 5, first, second).collect()}
    assert fused == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62}) == {r.k: r.score for r in S.fuse("q", "k", 5, second, first).collect()}
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0], [2.0, 4.0])], "z array<float>, a array<float>, b array<float>").select(S.cosine(F.col("z"), F.col("a")).alias("x"), S.cosine(F.col("a"), F.col("b")).alias("y")).first()
    assert zero.x == 0 and zero.y == pytest.approx(1)


def test_first_write_of_a_chunk_stays(spark):
    index = spark.createDataFrame([("c1", "old")], "chunk_id string, text string")
    new = spark.createDataFrame([("c1", "new"), ("c2", "b"), ("c2", "a")], "chunk_id string, text string")
    assert sorted(tuple(r) for r in S.upsert_chunks(index, new).collect()) == [("c1", "old"), ("c2", "a")]

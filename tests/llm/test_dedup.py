import random
from collections import Counter

import brute
import pytest

from opsgraph.llm import minhash_dedup, queries, suffix_dedup


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def near_copies():
    """Texts near the threshold on both sides, chains of links, and a group of many near copies."""
    r = random.Random(11)
    rows, words = [], [f"w{i}" for i in range(500)]
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randrange(5, 120))]
        for _ in range(r.randrange(1, 9)):
            copy = list(base)
            for _ in range(r.randrange(0, 5)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append(" ".join(copy))
            base = copy if r.random() < 0.4 else base
    base = [r.choice(words) for _ in range(300)]
    for k in range(60):
        copy = list(base)
        copy[r.randrange(300)] = f"x{k}"
        rows.append(" ".join(copy))
    r.shuffle(rows)
    return [(1000 + 7 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("which", ["hard", "near", "sf"])
@pytest.mark.parametrize("block", [4, 512])
def test_near_duplicates(spark, sf_dir, which, block, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rows = brute.hard_documents() if which == "hard" else near_copies() if which == "near" else [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in brute.classes(rows).items()}


def test_components_of_a_long_chain(spark):
    r = random.Random(4)
    nodes = list(range(60))
    r.shuffle(nodes)
    links = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(nodes, nodes[1:], strict=False)] + [(100, 101)], "x long, y long")
    got = {x.id: x.component for x in minhash_dedup.components(links).collect()}
    assert {got.get(i, i) for i in range(60)} == {0} and got[101] == 100


@pytest.mark.parametrize("which", ["hard", "near", "sf"])
@pytest.mark.parametrize("spread", [3, 4096])
def test_repeats(spark, sf_dir, which, spread, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPREAD", spread)
    rows = brute.hard_documents() if which == "hard" else near_copies() if which == "near" else [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {}
    for r in suffix_dedup.remove_repeats(table(spark, rows)).collect():
        got[r.doc_id] = (r.n_bytes, sum(e - s for s, e in r.removed), len(r.removed), brute.sha(bytes(r.kept)))
    want = brute.without_repeats(rows)
    assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {}


def test_suffix_arrays():
    r = random.Random(2)
    for length in (5, 8, 20):
        for _ in range(25):
            base = bytes(r.choice(b"ab") for _ in range(60))
            parts = [bytes(r.choice(b"abc") for _ in range(r.randrange(20))) + base[(a := r.randrange(40)) : a + r.randrange(30)] + bytes(r.choice(b"abc") for _ in range(r.randrange(10))) for _ in range(r.randrange(1, 8))]
            count = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
            assert [x.tolist() for x in suffix_dedup.repeated_starts(parts, length)] == [[i for i in range(len(p) - length + 1) if count[p[i : i + length]] > 1] for p in parts]


@pytest.mark.parametrize("name", ["op1_minhash_dedup", "op6_suffix_dedup"])
def test_empty_and_odd_tables(spark, tmp_path, name):
    schema = "doc_id long, text string, id int, n int, body string"
    same = "same words here again and " * 20
    for k, rows in enumerate([[], [(None, None, 1, 1, "")] * 2 + [(None, same, 1, 1, "")] * 2 + [(5, same, 2, 2, "b")] * 2 + [(6, "", 0, 0, "c")]]):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        got = queries.QUERIES[name](spark, f"{tmp_path}/{k}").collect()
        assert len(got) == len(rows)

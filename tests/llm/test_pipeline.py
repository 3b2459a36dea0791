import re

import brute

import corpus_pipeline as pipeline
from opsgraph.llm import queries
from opsgraph.llm.secret_scan import find_secrets, redacted


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "language_id":
            assert {d for d, r in before.items() if len(r.text) > 60 and re.search("[a-z]{3}", r.text)} <= set(after) and set(after) <= set(before)
        elif name == "minhash_dedup":
            assert set(after) == {d for d, (_, c) in brute.classes([(d, r.text) for d, r in before.items()], 80).items() if c == d}
        elif name == "decontamination":
            assert set(after) == {d for d, r in before.items() if not any(x in r.text for x in items)}
        elif name == "secret_scan":
            assert {d: r.text for d, r in after.items()} == {d: redacted(r.text, sum(find_secrets(r.text), [])) for d, r in before.items()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=f"{queries.TOKENIZERS}/piece_bpe_32k.model")
            assert {d: list(r.ids) for d, r in after.items()} == {d: model.encode(r.text) for d, r in before.items()}
    whole = pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == set(after)


def test_near_duplicates_with_null_ids(spark, sf_dir):
    """The stage keeps the rows that the operator marks as kept, those with a null id included."""
    texts = [f"w{k} " + " ".join(f"w{k}x{i}" for i in range(30)) for k in range(4)]
    rows = [(1, texts[0]), (2, texts[0]), (None, texts[0]), (None, texts[1]), (3, texts[2]), (None, texts[3]), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, texts[0]), (None, texts[1]), (3, texts[2]), (None, texts[3]), (None, None)], key=str)


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, matches int, row_key string, place int, labels string"


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, one id twice, and columns of names made on the way."""
    same, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(58)) + " x y"
    rows = [(1, same, "en", "s"), (1, same, "en", "s"), (1, same, None, "s"), (2, near, "en", None), (3, "other words of their own in a row", "en", "s"), (3, "a second text of the same number here", "en", "s"), (None, None, None, None), (None, None, None, None)]
    rows += [(None, "nameless text that stands by itself", "en", "s")] * 2 + [(4, "", "en", "s"), (5, " ", None, None), (6, "long " * 30_000, "en", "s"), (7, "12 34 56", "en", "s")]
    return spark.createDataFrame([(*r, len(r[1] or ""), True, 1, "k", 2, "l") for r in rows], ODD)


def test_stages_on_odd_rows(spark, sf_dir):
    docs = odd_documents(spark)
    stages = dict(pipeline.STAGES)
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    every = key(docs)
    letters = [(d, t) for d, t in every if re.search("[a-z]", t or "")]
    got = stages["language_id"](spark, docs, sf_dir)
    assert got.columns == pipeline.COLUMNS and key(got) == letters
    got = stages["minhash_dedup"](spark, docs, sf_dir)
    assert got.columns == pipeline.COLUMNS and key(got) == sorted({x for x in every if x[0] != 2}, key=str)
    first = [r for r in got.collect() if r.doc_id == 1]
    assert [(r.lang, r.source) for r in first] == [(None, "s")]
    for name in ("decontamination", "secret_scan"):
        got = stages[name](spark, docs, sf_dir)
        assert got.columns == pipeline.COLUMNS and key(got) == every
    got = stages["sentencepiece"](spark, docs, sf_dir).collect()
    assert len(got) == len(every) and all(r.n_tokens == len(r.ids) for r in got)


def test_stages_on_an_empty_table(spark, sf_dir):
    for name, stage in pipeline.STAGES:
        got = stage(spark, odd_documents(spark).limit(0), sf_dir)
        assert got.collect() == [] and (name == "sentencepiece" or got.columns == pipeline.COLUMNS)


def test_near_duplicates_from_four_fifths_on(spark, sf_dir):
    """Two documents that share 0.82 of their shingles are one group here, those that share 0.78 aren't."""
    words = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:94] + [f"x{i}" for i in range(10)])), (3, " ".join(f"z{i}" for i in range(104))), (4, " ".join([f"z{i}" for i in range(91)] + [f"y{i}" for i in range(13)]))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()) == [1, 3, 4]

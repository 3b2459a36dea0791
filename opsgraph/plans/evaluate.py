"""The evaluation run: recall against a gold set, answers by tier and condition, compliance, linkage; one report."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compliance, qa
from ..operators import graph as G
from ..sources import writers
from .ask import Corpus, ask

#: How questions are asked, by condition.
CONDITIONS = {"vector_only": {"baseline": True}, "graph_only": {"graph_only": True}, "hybrid": {}}


def recalls(corpus: Corpus, gold_nodes: DataFrame, gold_edges: DataFrame) -> DataFrame:
    """``part``, ``type`` (null for all), ``gold``, ``found``, ``pct`` of nodes by key and of edges by their three parts."""
    whole = lambda df: df.select("type", F.concat("source", F.lit("-["), "type", F.lit("]->"), "target").alias("key"))
    nodes = qa.recall(gold_nodes.select("type", "key"), corpus.nodes).withColumn("part", F.lit("node"))
    edges = qa.recall(whole(gold_edges), whole(corpus.edges)).withColumn("part", F.lit("edge"))
    return nodes.unionByName(edges).select("part", "type", "gold", "found", "pct")


def answers(corpus: Corpus, questions: DataFrame, conditions: dict[str, dict] | None = None) -> DataFrame:
    """``tier``, ``condition``, ``accuracy`` and ``cited`` in percent, median ``latency`` in seconds, ``n``.

    ``questions`` (tier, question, expects, docs) are a benchmark of some dozens, asked one at a time."""
    rows = []
    for r in questions.collect():
        for name, how in (CONDITIONS if conditions is None else conditions).items():
            start = time.time()
            got = ask(corpus, r.question, **how)
            took = time.time() - start
            said = " ".join([got.text, *(c["quote"] or "" for c in got.citations), *(c["doc_id"] for c in got.citations)])
            rows.append((r.tier, name, said, r.expects or [], r.docs or [], [c["doc_id"] for c in got.citations], took))
    asked = questions.sparkSession.createDataFrame(rows, "tier string, condition string, haystack string, expects array<string>, docs array<string>, cited_docs array<string>, latency double")
    return qa.score_answers(asked).groupBy("tier", "condition").agg(F.round(100 * F.avg("accuracy"), 1).alias("accuracy"), F.round(100 * F.avg("cited"), 1).alias("cited"), F.round(F.median("latency"), 2).alias("latency"), F.count("*").alias("n")).orderBy("tier", "condition")


def report(corpus: Corpus, gold_nodes: DataFrame, gold_edges: DataFrame, questions: DataFrame, verdicts: DataFrame, conditions: dict[str, dict] | None = None) -> str:
    """The whole run as Markdown; ``verdicts`` are those of the compliance scan."""
    share = G.linkage_share(G.linkage(corpus.nodes, corpus.edges))
    return writers.evaluation(recalls(corpus, gold_nodes, gold_edges).orderBy("part", F.col("type").desc_nulls_last()), answers(corpus, questions, conditions), compliance.counts(verdicts), share)

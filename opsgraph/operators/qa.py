"""Question answering over graph and index: entity linking, routing, retrieval, refusal, cited answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from . import rank, search

REFUSAL = "The available documents do not support an answer to this question."


def mentioned(question: Column | str) -> Column:
    """Keys of the entities that a question names, in order, each once; whether the graph has them is for a join."""
    q = F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit(""))
    ids = lambda kind, pattern: F.transform(X.all_matches(q, pattern), lambda m: F.concat(F.lit(f"{kind}:"), F.upper(m)))
    return F.array_distinct(
        F.concat(
            F.transform(X.extract_tags(q), lambda t: F.concat(F.lit("Equipment:"), t)), F.transform(X.failure_codes(q), lambda c: F.concat(F.lit("FailureMode:"), c)),
            ids("Procedure", r"(?i)\bSOP-\d+\b"), ids("Incident", r"(?i)\bINC-\d{4}-\d+\b"), ids("WorkOrder", r"(?i)\bWO-\d+\b"),
        )
    )


def link_entities(questions: DataFrame, nodes: DataFrame, qid: str, text: str = "text") -> DataFrame:
    """``qid``, ``pos``, ``key`` of the entities named that the graph has."""
    return questions.select(qid, F.posexplode(mentioned(text)).alias("pos", "key")).join(nodes.select("key"), "key", "left_semi").select(qid, "pos", "key")


def route(questions: DataFrame, nodes: DataFrame, qid: str, text: str = "text") -> DataFrame:
    """``qid``, ``entities``, ``mode``: global by its words; multihop by its words, two entities, or "and" with one;
    else lookup.  Codes count without being in the graph, tags don't."""
    q = F.coalesce(F.col(text), F.lit(""))
    tags = questions.select(qid, F.explode(X.extract_tags(text)).alias("t")).join(nodes.where(F.startswith("key", F.lit("Equipment:"))).select(F.substring("key", 11, 1000).alias("t")).distinct(), "t", "left_semi").groupBy(qid).agg(F.count("*").alias("tags"))
    ids = F.size(F.array_distinct(X.all_matches(q, r"\b(?:SOP-\d+|INC-\d{4}-\d+|OISD-[A-Z0-9-]+|WO-\d+)\b")))
    out = questions.join(tags, qid, "left").withColumn("entities", F.coalesce("tags", F.lit(0)) + F.size(X.failure_codes(q)) + ids)
    joined = F.contains(F.lower(q), F.lit(" and "))
    mode = F.when(q.rlike(f"(?i){V.GLOBAL_QUESTION}"), "global").when(q.rlike(f"(?i){V.MULTIHOP_QUESTION}") | (F.col("entities") >= 2), "multihop").when(joined & (F.col("entities") >= 1), "multihop").otherwise("lookup")
    return out.select(qid, F.col("entities").cast("long").alias("entities"), mode.alias("mode"))


def gate(retrieved: DataFrame, questions: DataFrame, linked: DataFrame, qid: str, chunk: str, text: str = "text", question: str = "question") -> DataFrame:
    """``qid``, ``support``, ``citations``, ``refused``, ``confidence``.

    Support is the most content words that a retrieved chunk shares with the question.  Without chunks, or with support
    below 2 and no entity, the answer is refused (confidence .1, two citations at most)."""
    asked = questions.select(qid, X.answer_tokens(question).alias("asked"))
    shared = retrieved.join(asked, qid).select(qid, F.size(F.array_intersect(X.answer_tokens(text), F.col("asked"))).alias("n")).groupBy(qid).agg(F.max("n").alias("support"), F.count("*").alias("chunks"))
    out = questions.select(qid).join(shared, qid, "left").join(linked.select(qid).distinct().withColumn("entity", F.lit(True)), qid, "left")
    support, n = F.coalesce("support", F.lit(0)), F.coalesce("chunks", F.lit(0))
    refused = (n == 0) | ((support < 2) & F.col("entity").isNull())
    cited = F.least(n, F.when(refused, 2).otherwise(4))
    confidence = F.when(refused, 0.1).otherwise(F.round(F.least(F.lit(0.95), 0.45 + 0.12 * cited), 2))
    return out.select(qid, support.cast("long").alias("support"), cited.cast("long").alias("citations"), refused.alias("refused"), confidence.alias("confidence"))


def citations(retrieved: DataFrame, questions: DataFrame, qid: str, chunk: str, text: str = "text", question: str = "question", most: int = 4) -> DataFrame:
    """The first chunks by rank with a short quote."""
    asked = questions.select(qid, X.query_tokens(question).alias("__q"), X.answer_tokens(question).alias("asked"))
    return retrieved.where(F.col("rank") <= most).join(asked, qid).select(qid, "rank", chunk, X.short_quote(text, F.col("asked")).alias("quote"))


def multihop(question: str, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, hits: DataFrame, seeds: list[str], k: int = 8, steps: int = 20) -> tuple[DataFrame, DataFrame]:
    """Chunks (chunk_id, text, score) and entities (key, score) for one question by graph reasoning.

    PageRank from the seeds (else from what the four best hits mention) gives entities; hits that mention one of the 15
    best count double; chunks that mention one of the 12 best and share a word are added with the entity's score times
    one more than the shared words.  ``hits``: chunk_id, score, rank of the fused search.
    """
    mentions = edges.where("type = 'MENTIONS'").select(F.regexp_replace("source", "^Chunk:", "").alias("chunk_id"), F.col("target").alias("key"))
    if not seeds:
        seeds = [r.key for r in mentions.join(F.broadcast(hits.where("rank <= 4").select("chunk_id")), "chunk_id").select("key").distinct().orderBy("key").collect()]  # entities of four chunks
    ranked = rank.pagerank(nodes, edges, seeds, V.PPR_DAMPING, steps)
    entity = F.split("key", ":")[0].isin(V.ENTITY_TYPES)
    best = ranked.where(entity).orderBy(F.desc("score"), "key").limit(15)
    best = rank.checkpointed(best.select("key", F.col("score").alias("ppr")))
    boosted = hits.join(mentions.join(F.broadcast(best), "key").select("chunk_id").distinct().withColumn("hit", F.lit(2.0)), "chunk_id", "left").select("chunk_id", (F.col("score") * F.coalesce("hit", F.lit(1.0))).alias("score"))
    first = best.orderBy(F.desc("ppr"), "key").limit(12)
    tokens = X.query_tokens(F.lit(question))
    overlap = F.size(F.array_intersect(X.query_tokens("text"), tokens))
    linked = mentions.join(F.broadcast(first), "key").join(chunks.select("chunk_id", "text"), "chunk_id").withColumn("n", overlap).where("n > 0").select("chunk_id", (F.col("ppr") * (1 + F.col("n"))).alias("score"))
    total = boosted.unionByName(linked).groupBy("chunk_id").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)
    return total.join(chunks.select("chunk_id", "text"), "chunk_id"), best.select("key", F.col("ppr").alias("score"))


def score_answers(answers: DataFrame) -> DataFrame:
    """``accuracy`` (share of expected words in answer, quotes and ids) and ``cited`` of rows: haystack, expects, docs,
    cited_docs.  Nothing expected counts as all found."""
    hay = F.lower("haystack")
    share = F.when(F.size("expects") > 0, F.size(F.filter("expects", lambda e: F.contains(hay, F.lower(e)))) / F.size("expects")).otherwise(1.0)
    hit = F.when(F.size("docs") == 0, 1.0).when(F.arrays_overlap("docs", "cited_docs"), 1.0).otherwise(0.0)
    return answers.withColumns({"accuracy": share, "cited": hit})


def recall(gold: DataFrame, found: DataFrame) -> DataFrame:
    """By ``type`` and overall (null type): gold keys, found ones, pct."""
    g = gold.select("type", "key").distinct().join(found.select("key").distinct().withColumn("hit", F.lit(1)), "key", "left")
    by = g.rollup("type").agg(F.count("*").alias("gold"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    return by.withColumn("pct", F.round(100 * F.col("found") / F.col("gold"), 1))

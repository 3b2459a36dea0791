"""From a question to a cited answer: route, retrieve, gate, cite, compose.

One question is asked at a time, so the steps are a driver-built plan over the graph and the index; what is brought to
the driver are the entities of the question, at most ten chunks and a handful of communities.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import qa, rank, search


@dataclass
class Corpus:
    """What questions are asked of.  ``chunks``: chunk_id, doc_id, page, row, text and, for dense search, embedding."""

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    communities: DataFrame | None = None


@dataclass
class Answer:
    text: str
    mode: str
    confidence: float
    citations: list[dict] = field(default_factory=list)
    path: list[tuple[str, str, str]] = field(default_factory=list)
    seeds: list[str] = field(default_factory=list)


def hybrid(corpus: Corpus, question: str, k: int = 6) -> DataFrame:
    """chunk_id, score, rank: BM25 and hash-embedding cosine fused, each with its best max(k, 10)."""
    spark = corpus.chunks.sparkSession
    asked = spark.createDataFrame([(0, question)], "q int, text string")
    most = max(k, 10)
    scores = search.bm25(corpus.chunks, asked, "chunk_id", "q")
    # Chunks without a shared token score 0 and still take part.
    lexical = search.top(corpus.chunks.select(F.lit(0).alias("q"), "chunk_id").join(scores, ["q", "chunk_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "q", "chunk_id", most)
    own = F.col("embedding") if "embedding" in corpus.chunks.columns else X.hash_embedding("text")
    dense = corpus.chunks.select("chunk_id", own.alias("e")).crossJoin(F.broadcast(asked.select("q", X.hash_embedding("text").alias("v"))))  # one question
    ranked = search.top(dense.select("q", "chunk_id", search.cosine(F.col("e"), F.col("v")).alias("score")), "q", "chunk_id", most)
    return search.fuse("q", "chunk_id", k, lexical, ranked, constant=V.RRF_CONSTANT).select("chunk_id", "score", "rank")


def global_chunks(corpus: Corpus, question: str, most: int = 4) -> list[dict]:
    """The communities whose summaries fit the question best."""
    if corpus.communities is None:
        return []
    scored = corpus.communities.withColumn("fit", X.relevance(F.lit(question), F.col("summary")))
    return [r.asDict() for r in scored.orderBy(F.desc("fit"), "id").limit(most).collect()]


def ask(corpus: Corpus, question: str, baseline: bool = False, graph_only: bool = False, seeds: list[str] | None = None, k: int = 8, steps: int = 20) -> Answer:
    """``baseline`` is lookup only; ``graph_only`` is multihop unless the router says global; given ``seeds`` (a tag read
    from a photo) it is multihop from them."""
    spark = corpus.nodes.sparkSession
    asked = spark.createDataFrame([(0, question)], "q int, text string")
    linked = [r.key for r in qa.link_entities(asked, corpus.nodes, "q").orderBy("pos").collect()]
    mode = "lookup" if baseline else qa.route(asked, corpus.nodes, "q").first()["mode"]
    if (graph_only and mode != "global") or seeds:
        mode = "multihop"
    hits = hybrid(corpus, question, 6 if mode != "multihop" else k)
    path, related, found = [], [], []
    if mode == "multihop":
        given = seeds or linked
        chunks, entities = qa.multihop(question, corpus.nodes, corpus.edges, corpus.chunks, hits, given, k, steps)
        related = [r.key for r in entities.orderBy(F.desc("score"), "key").collect() if r.key not in given]
        for target in related[:3]:
            for seed in given:
                path = path or rank.shortest_path(corpus.edges, seed, target)
        hits = chunks.select("chunk_id", "score")
    elif mode == "global":
        found = global_chunks(corpus, question)
    got = hits.join(corpus.chunks, "chunk_id").select("chunk_id", "score", *[c for c in ("doc_id", "page", "row") if c in corpus.chunks.columns], "text", F.size(F.array_intersect(X.answer_tokens("text"), X.answer_tokens(F.lit(question)))).alias("support"), X.short_quote("text", X.answer_tokens(F.lit(question))).alias("quote"))
    rows = got.orderBy(F.desc("score"), "chunk_id").collect()
    cite = lambda n: [{"chunk_id": r.chunk_id, "doc_id": getattr(r, "doc_id", r.chunk_id.split("::")[0]), "page": getattr(r, "page", None), "row": getattr(r, "row", None), "quote": r.quote} for r in rows[:n]]
    if not (mode == "global" and found) and (not rows or (max(r.support for r in rows) < 2 and not linked and not seeds)):
        return Answer(qa.REFUSAL, "refusal", 0.1, cite(2))
    cited = cite(4)
    confidence = round(min(0.95, 0.45 + 0.12 * len(cited) + (0.15 if path else 0)), 2)
    return Answer(_compose(mode, path, related, found, rows), mode, confidence, cited, path, seeds or linked)


def _short(key: str) -> str:
    return key.split(":", 1)[-1]


def _compose(mode: str, path, related, found, rows) -> str:
    lines = []
    if path:
        lines.append("**Graph path:** " + " ".join([_short(path[0][0]), *(f"—[{kind}]→ {_short(b)}" for _, kind, b in path)]))
    if mode == "multihop" and related:
        lines.append("**Related in the graph:** " + ", ".join(_short(k) for k in related[:6]))
    lines += [f"- ({c['size']}) {c['summary']}" for c in found[:3]]
    lines.append("**Supporting evidence:**")
    for n, r in enumerate(rows[:4], 1):
        where = getattr(r, "doc_id", "?") + (f" p.{r.page}" if getattr(r, "page", None) else "")
        lines.append(f"{n}. {' '.join(r.text.split())[:180]} — *[{where}]* [E{n}]")
    return "\n".join(lines)

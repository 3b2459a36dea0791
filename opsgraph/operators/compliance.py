"""Compliance of procedures with clauses: coverage of obligation terms, the critical ones above all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import best_snippet, let, obligation_terms, strings


def assess(clause: Column, procedure: Column) -> Column:
    """(score, verdict) of arrays of obligation terms.  Without obligations coverage is 1."""
    def of(x):
        general = F.when(F.size(x["c"]) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x["c"], x["p"])) / F.size(x["c"]))
        critical = F.array_intersect(x["c"], strings(V.CRITICAL_TERMS))
        share = F.when(F.size(critical) == 0, general).otherwise(F.size(F.array_intersect(critical, x["p"])) / F.size(critical))
        verdict = F.when((share >= V.CLAUSE_COVERED) & (general >= V.CLAUSE_GENERAL), "covered").when(share < V.CLAUSE_PARTIAL, "GAP").otherwise("partial")
        return F.struct(F.round(share, 2).alias("score"), verdict.alias("verdict"))

    return let(F.struct(clause.alias("c"), procedure.alias("p")), of)


def rank(verdict: Column) -> Column:
    return F.when(verdict == "GAP", 0).when(verdict == "partial", 1).otherwise(2)


def scan(clauses: DataFrame, procedures: DataFrame, requires: DataFrame, covers: DataFrame, governs: DataFrame, scope: str | None = None) -> DataFrame:
    """A row for each clause: the procedure that satisfies it best, its verdict, coverage and evidence.

    ``clauses``: clause, text; ``procedures``: procedure, text; ``requires``: procedure, clause; ``covers``: clause,
    equipment; ``governs``: procedure, equipment.  Only where no procedure requires a clause are those taken that govern
    the equipment it covers.  Of equal procedures the smallest id counts.  A clause without candidates is a GAP.  With
    a scope, clauses that cover equipment but none whose tag contains it are left out.
    """
    clauses = clauses.where(F.coalesce("text", F.lit("")) != "")
    covered = covers
    if scope:
        covered = covers.where(F.contains(F.upper("equipment"), F.lit(scope.upper())))
        away = covers.select("clause").distinct().join(covered.select("clause"), "clause", "left_anti")
        clauses = clauses.join(away, "clause", "left_anti")
    direct = requires.select("clause", "procedure").distinct()
    through = covered.join(governs, "equipment").select("clause", "procedure").distinct().join(direct.select("clause"), "clause", "left_anti")
    candidates = direct.unionByName(through)
    terms = clauses.select("clause", F.col("text").alias("clause_text"), obligation_terms("text").alias("obliged"))
    own = procedures.select("procedure", F.col("text").alias("procedure_text"), obligation_terms("text").alias("done"))
    judged = candidates.join(terms, "clause").join(own, "procedure", "left").withColumn("a", assess(F.col("obliged"), F.coalesce("done", strings([]))))
    best = judged.groupBy("clause").agg(F.min(F.struct((-rank(F.col("a.verdict"))).alias("r"), (-F.col("a.score")).alias("s"), "procedure", F.col("a.verdict").alias("verdict"), F.col("a.score").alias("score"))).alias("b"))
    out = terms.join(best, "clause", "left").select("clause", "clause_text", "obliged", F.coalesce("b.verdict", F.lit("GAP")).alias("verdict"), F.coalesce("b.score", F.lit(0.0)).alias("coverage"), F.col("b.procedure").alias("procedure"))
    out = out.join(procedures.select("procedure", F.col("text").alias("__text")), "procedure", "left")
    evidence = F.when(F.col("procedure").isNull(), F.lit("")).otherwise(best_snippet("__text", F.col("obliged")))
    return out.select("clause", "clause_text", "verdict", "coverage", "procedure", evidence.alias("evidence")).orderBy(rank(F.col("verdict")), "clause")


def counts(verdicts: DataFrame) -> DataFrame:
    """One row: covered, partial, gaps, zeros kept."""
    n = lambda v: F.coalesce(F.sum((F.col("verdict") == v).cast("long")), F.lit(0))
    return verdicts.agg(n("covered").alias("covered"), n("partial").alias("partial"), n("GAP").alias("gaps"))


def report(verdicts: DataFrame) -> DataFrame:
    """The lines of an evidence report, in order; gaps are findings."""
    head = F.when(F.col("verdict") == "GAP", "FINDING").otherwise(F.upper("verdict"))
    line = F.concat(head, F.lit(": clause "), F.col("clause").cast("string"), F.lit(" - "), F.col("clause_text"), F.when(F.col("procedure").isNotNull(), F.concat(F.lit(" ["), F.col("procedure").cast("string"), F.lit("] "), "evidence")).otherwise(F.lit(" (no procedure)")))
    return verdicts.orderBy(rank(F.col("verdict")), "clause").select("clause", line.alias("line"))

"""Writers: reports, deltas, cached tables by graph version."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share; a temporary one where none is set and Spark
    runs on one machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="opsgraph-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, in whatever store; nothing where there is no folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def markdown(df: DataFrame, title: str) -> str:
    """A small result as a Markdown table: for reports whose rows are types, tiers or verdicts."""
    rows = df.collect()
    head = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows), ""])


def evaluation(recalls: DataFrame, scores: DataFrame, verdicts: DataFrame, share: DataFrame) -> str:
    """The evaluation report."""
    return "\n".join(markdown(df, title) for title, df in (("Extraction recall", recalls), ("Answers", scores), ("Compliance", verdicts), ("Linkage", share)))


def write_deltas(df: DataFrame, path: str, commit: str) -> None:
    """Counts of one commit; written again, they replace those of the first time."""
    df.withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/commit={commit}")


def messages(summary: DataFrame, deltas: DataFrame) -> DataFrame:
    """``n``, ``message``: what a client is sent as JSON, a greeting with the graph's summary and then every delta in order."""
    hello = summary.agg(F.sort_array(F.collect_list(F.struct("part", "type", "n"))).alias("summary")).select(F.lit(-1).cast("bigint").alias("n"), F.to_json(F.struct(F.lit("hello").alias("kind"), "summary")).alias("message"))
    each = deltas.select(F.unix_micros("at").alias("n"), F.to_json(F.struct(F.lit("delta").alias("kind"), F.col("kind").alias("source"), "batch", "nodes_added", "edges_added")).alias("message"))
    return hello.unionByName(each)


def cached(df: DataFrame, path: str, version: str):
    """A derived table (communities, cards) kept for one version of the graph; another version makes it anew."""
    at = f"{path}/version={version}"
    spark = df.sparkSession
    if not exists(spark, f"{at}/_SUCCESS"):
        df.write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)

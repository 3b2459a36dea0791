"""Continuous ingest and alerts.

Every micro-batch of notes or work orders is extracted, added to the graph as a version and recorded as one row of the
deltas table; who reads a version gets it merged.  Several streams of one driver may share a folder: their commits take
turns, each makes the next version out of the last committed one, and a batch that is repeated after a failure is
recognised by its stream and number and changes nothing.
"""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, graph
from ..sources import writers

_locks: dict[str, threading.Lock] = defaultdict(threading.Lock)


def commits(spark: SparkSession, folder: str) -> list[tuple[int, str, int]]:
    """(version, stream, batch) of what is committed, in order: a name in a folder each."""
    return sorted((int(v), kind, int(batch)) for v, kind, batch in (n.split("~") for n in writers.names(spark, f"{folder}/commits") if "~" in n))


def current(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The last committed graph."""
    done = commits(spark, folder)
    return graph.load(spark, f"{folder}/v{done[-1][0]}" if done else f"{folder}/none")


def merge_batch(spark: SparkSession, folder: str, new_nodes: DataFrame, new_edges: DataFrame, batch: int, kind: str) -> None:
    """The next version out of the last one and a delta, a row of counts into ``folder/deltas``, then the commit; what
    a failed attempt left behind is written over."""
    with _locks[folder]:
        done = commits(spark, folder)
        if (kind, batch) in {(k, b) for _, k, b in done}:
            return
        nodes, edges = current(spark, folder)
        version = done[-1][0] + 1 if done else 0
        counts = graph.grow(nodes, edges, new_nodes, new_edges, folder, version)
        writers.write_deltas(counts.select(F.lit(batch).alias("batch"), F.lit(kind).alias("kind"), "nodes_added", "edges_added"), f"{folder}/deltas", f"{kind}-{batch}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits/{version:09d}~{kind}~{batch}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(path)


def feed(spark: SparkSession, folder: str, out: str, trigger: dict | None = None):
    """A query that sends each new delta on as JSON lines in ``out``; who joins later reads :func:`writers.messages`."""
    schema = "batch int, kind string, nodes_added long, edges_added long, at timestamp"
    rows = spark.readStream.schema(schema).parquet(f"{folder}/deltas/*")
    lines = rows.select(F.to_json(F.struct(F.lit("delta").alias("kind"), F.col("kind").alias("source"), "batch", "nodes_added", "edges_added")).alias("value"))
    return lines.writeStream.format("text").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def _graph_columns(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = nodes if "doc_ids" in nodes.columns else nodes.withColumn("doc_ids", F.transform("provenance", lambda p: p["doc_id"]))
    return nodes.select(*graph.NODES.names), edges.select(*graph.EDGES.names)


def ingest_notes(stream: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None):
    """A query over a stream of notes (note_id, transcript, role)."""

    def each(batch: DataFrame, n: int) -> None:
        # Tags, codes and order of a note are found once, for nodes and edges alike.
        spark, heard = batch.sparkSession, f"{folder}/heard/note-{n}"
        extract.heard(batch.dropDuplicates(["note_id"])).write.mode("overwrite").parquet(heard)
        nodes, edges, _ = extract.notes(spark.read.parquet(heard))
        merge_batch(spark, folder, *_graph_columns(nodes, edges), n, "note")
        writers.remove(spark, heard)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest_work_orders(stream: DataFrame, folder: str, checkpoint: str, doc_id: str, lexicon: dict[str, str], trigger: dict | None = None):
    """A query over a stream of work-order rows."""

    def each(batch: DataFrame, n: int) -> None:
        nodes, edges, _ = extract.work_orders(batch.dropDuplicates(["WO_ID"]), doc_id, lexicon)
        merge_batch(batch.sparkSession, folder, *_graph_columns(nodes, edges), n, "work_order")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def precursor_alerts(events: DataFrame, links: dict[str, str], window: str = "30 days", late: str = "2 days") -> DataFrame:
    """A stream of events that learned causes announce: by asset and time window, causes and effects together.

    ``events``: asset, code, ts.  ``links``: effect to cause (the learned pairs, some dozens).  The watermark bounds the
    state to windows that late events can still reach.
    """
    announces = F.create_map(*[F.lit(x) for effect, cause in links.items() for x in (cause, effect)])
    tagged = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("announces", F.try_element_at(announces, F.col("code"))).where("announces is not null")
    return tagged.groupBy(F.window("ts", window), "asset", "announces").agg(F.count("*").alias("signals"), F.max("ts").alias("latest"))


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))

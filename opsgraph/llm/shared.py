"""What the corpus operators share: where intermediate tables go, and how columns are named.

Intermediate tables are Parquet in the folder of ``spark.checkpoint.dir``, which every executor sees, so a lost
executor costs a re-read and not a recomputation.  Where the setting is unset (tests, notebooks) a temporary folder
is made on the driver's machine and set as the checkpoint folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="opsgraph-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/opsgraph-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")  # the table stands for them, so its shuffle files can go
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` wrote, once nothing reads them any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def reject_clashes(given: list[str], made: list[str]) -> None:
    """An error where a column that an operator makes is there already."""
    if clash := sorted(set(given) & set(made)):
        raise ValueError(f"columns {clash} are made here")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str | Column = "text") -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: an array bound by a lambda is a value, a repeated expression isn't."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(listed: Column, zero: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], size: int = 256) -> Column:
    """What ``step`` puts out (an array of type ``kind`` for each element), all in a row; it gets a state and an element
    and gives the next state and those outputs.

    An array that grows in an accumulator is copied at every step.  Here it grows within a block of ``size`` elements
    and the blocks' outputs grow by one a block, so the time is linear for all but millions of elements.
    """
    empty = F.expr(f"cast(array() as array<{kind}>)")

    def one(acc, x):
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def blocks(values):
        def block(acc, b):
            part = F.aggregate(F.slice(values, b * size + 1, F.lit(size)), F.struct(acc["state"].alias("state"), empty.alias("out")), one)
            return let(part, lambda done: F.struct(done["state"].alias("state"), F.concat(acc["out"], F.array(done["out"])).alias("out")))

        start = F.struct(zero.alias("state"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int"))), start, block)["out"])

    return let(listed, lambda values: F.when(F.size(values) == 0, empty).otherwise(blocks(values)))


def column_map(
    convert: Callable[[pa.Array], dict[str, pa.Array]], text: str, out: pa.Schema, keep: list[str], rows: int = 4096, chars: int = 4 << 20
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: ``convert`` gets slices of the text column of at most ``rows`` rows and about ``chars``
    bytes (one row at least), so memory is bounded by a slice and not by Arrow's batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
            start, total = 0, 0
            for i, size in enumerate(sizes):
                total += size
                if total >= chars or i - start + 1 >= rows or i == len(sizes) - 1:
                    part = batch.slice(start, i - start + 1)
                    made = convert(part.column(part.schema.get_field_index(text)))
                    columns = {k: part.column(part.schema.get_field_index(k)) for k in keep} | made
                    yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in out], schema=out)
                    start, total = i + 1, 0

    return run

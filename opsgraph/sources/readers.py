"""Readers.  Tables come through Spark's own sources, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

MANIFEST = (
    "plant string, generated string, documents array<struct<doc_id:string,filename:string,doc_type:string,source_kind:string,page_count:int,row_count:int,layer_file:string,transcript_file:string,equipment:string,overdue:boolean>>"
)
LAYER = "image string, width int, height int, symbols array<struct<tag:string,cls:string,bbox:array<double>,center:array<double>>>, tags array<struct<text:string,bbox:array<double>>>"
WORK_ORDER = "WO_ID string, Date string, Equipment_Tag string, Type string, Problem_Text string, Action_Text string, Technician string, Downtime_Hrs int, Status string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def manifest(spark: SparkSession, path: str, only_types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Entries in the order of the file (``pos``), of some types, the first ``limit`` of them."""
    out = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.posexplode("documents").alias("pos", "d")).select("pos", "d.*")
    if only_types:
        out = out.where(F.col("doc_type").isin(only_types))
    return out.orderBy("pos").limit(limit) if limit is not None else out


def layer(spark: SparkSession, path: str) -> DataFrame:
    """A drawing's symbols and text tags."""
    return spark.read.schema(LAYER).json(path, multiLine=True)


def lexicon(spark: SparkSession, path: str) -> dict[str, str]:
    """Abbreviations to expansions; a later row of a key wins.  A lexicon is a constant of a plan: some hundred rows."""
    rows = spark.read.csv(path, header=True, schema="abbrev string, expansion string").where("abbrev is not null")
    return {r.abbrev.strip().lower(): (r.expansion or "").strip() for r in rows.collect()}


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as notes: note_id (the file's stem), transcript."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("note_id"), F.col("value").alias("transcript"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line that isn't blank."""
    return spark.read.schema("tier string, question string, expects array<string>, docs array<string>").json(path).where("question is not null")


def gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.schema("nodes array<struct<type:string,key:string,props:map<string,string>,doc_ids:array<string>>>, edges array<struct<type:string,source:string,target:string,doc_ids:array<string>>>").json(path, multiLine=True)
    return raw.select(F.explode("nodes").alias("n")).select("n.*"), raw.select(F.explode("edges").alias("e")).select("e.*")


def work_orders(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows with ``row``, the place in the file from 0; columns that the file lacks are null."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = [f.split(" ")[0] for f in WORK_ORDER.split(", ")]
    out = raw.select(*[(F.col(c) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in names], F.monotonically_increasing_id().alias("__id"), F.input_file_name().alias("__file"))
    return out.withColumn("row", F.row_number().over(Window.partitionBy("__file").orderBy("__id")) - 1).drop("__id", "__file")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Text files of pages, form feeds between them: doc_id, pages."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), F.split("value", "\f").alias("pages"))


def has_text(pages_column):
    return F.exists(pages_column, lambda p: F.trim(F.coalesce(p, F.lit(""))) != "")


def uploads(rows: DataFrame, filename: str = "filename") -> DataFrame:
    """Document type and source kind of uploaded files by name."""
    return rows.withColumns({"doc_type": X.document_kind(filename), "source_kind": X.source_kind(filename)})


try:
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class PdfPages(DataSource):
        """``spark.read.format("pdf_pages")``: doc_id, page, text; needs a PDF library on the executors.

        A file or a page that can't be read gives no rows or an empty text."""

        @classmethod
        def name(cls) -> str:
            return "pdf_pages"

        def schema(self) -> str:
            return "doc_id string, page int, text string"

        def reader(self, schema) -> DataSourceReader:
            return _PdfReader(self.options)

    class _PdfReader(DataSourceReader):
        def __init__(self, options):
            self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

        def partitions(self):
            from pyspark.sql.datasource import InputPartition

            return [InputPartition(p) for p in self.paths]

        def read(self, partition):
            from pathlib import Path

            try:
                from pypdf import PdfReader
            except ImportError as e:
                raise RuntimeError("reading PDF needs pypdf on the executors") from e
            try:
                found = PdfReader(partition.value).pages
            except Exception:
                return
            for n, page in enumerate(found, 1):
                try:
                    text = page.extract_text() or ""
                except Exception:
                    text = ""
                yield Path(partition.value).stem, n, text
except ImportError:  # an older Spark
    PdfPages = None

"""A training corpus in five stages, each by one of the corpus operators and each on all that the one before kept.

Every stage but the last returns the columns of ``documents`` and no others, whatever else a table has.

Nulls and empty texts: language ID rejects texts without letters, so later stages see none in ``run``; each stage treats
them as its operator says.  Rows with a null id are documents like others.  Repeated rows: of rows with one id and one
text the near-dedup stage keeps one, whatever their other columns say; rows of one id and different texts are documents
of their own.  Very long texts are treated whole.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsgraph.llm import decontaminate, language_id, minhash_dedup, queries, secret_scan, sentencepiece_codec
from opsgraph.llm.shared import materialise, text_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known well enough; the declared language stays as it is."""
    docs = docs.select(*COLUMNS)
    out = language_id.identify(docs, language_id.fit(docs), host=F.col("source"), declared=F.col("lang"), keep=tuple(COLUMNS))
    return out.where("kept").select(*COLUMNS)


#: Share of five-word shingles, in percent, from which two documents are near duplicates.
NEAR = 80


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows are known by id and text, so those with a null id aren't lost; of equal ones the first by the other columns
    stays.  The texts move once, by that key.
    """
    docs = docs.select(*COLUMNS).withColumn("row_key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text_of()), 256))
    kept = minhash_dedup.near_duplicates(docs, numerator=NEAR, denominator=100, keep=("row_key",)).where("kept").select("row_key")
    found = docs.join(kept.hint("shuffle_hash"), "row_key", "left_semi")
    first = Window.partitionBy("row_key").orderBy("lang", "source", "n_chars")
    return found.withColumn("place", F.row_number().over(first)).where("place = 1").select(*COLUMNS)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item."""
    out = decontaminate.find_benchmark(docs.select(*COLUMNS), queries.table(spark, sf_dir, "benchmark"), keep=tuple(COLUMNS))
    return out.where(F.size("matches") == 0).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a sign (addresses beside them stay), the length of the text as it is then."""
    keep = tuple(c for c in COLUMNS if c != "text")
    out = secret_scan.scan_secrets(docs.select(*COLUMNS), keep=keep, redact_as="[SECRET]")
    return out.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives the text back."""
    made = docs.select("doc_id", "text", F.col("text").alias("source_text"))
    out = sentencepiece_codec.encode_and_decode(made, f"{queries.TOKENIZERS}/piece_bpe_32k.model", keep=("doc_id", "source_text"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("source_text")).alias("round_trip"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode),
]
#: Trained models, regular expressions with offsets and merges can't be put as SQL: tests hold each stage against a
#: plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

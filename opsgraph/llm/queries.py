"""The registered queries of the corpus operators: each reads its whole table and derives the columns of its contract."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, language_id, license_scan, minhash_dedup, pii, secret_scan, sentencepiece_codec, sharding, suffix_dedup
from .shared import text_of

#: Where the public tokenizer files are, unless a parameter says otherwise.
TOKENIZERS = os.environ.get("OPSGRAPH_TOKENIZERS") or os.path.dirname(public_tokenizers.path("piece_bpe_32k.model"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = language_id.fit(documents)
    return language_id.identify(documents, model, host=F.col("source"), declared=F.col("lang"), keep=("doc_id",))


def lang_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on web pages: host, suffix and the declared language come from the page."""
    model = language_id.fit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    pages = table(spark, sf_dir, "pages")
    body = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+/([a-z]{2})(?:/|$)", 1)
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-zA-Z]{2})", 1)
    rows = pages.select("page_id", body.alias("text"), host.alias("host"), F.when(declared != "", declared).otherwise(path).alias("declared"))
    return language_id.identify(rows, model, host=F.col("host"), declared=F.col("declared"), suffix=F.substring_index("host", ".", -1), keep=("page_id",))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    at = F.transform("base", lambda b: b["at"])
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"]))), ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    return out.select(
        "doc_id", *[pii.counted(base, k).alias(f"n_{k}") for k in pii.BASE], F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_records(table(spark, sf_dir, "documents").select("doc_id", "text"))
    body = text_of()
    return out.select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return out.select("doc_id", "n_bytes", cut.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("findings", lambda f: f["base"])
    kinds = F.array(*[F.lit(k) for k in ("assign", "access", "hex")])
    by_start = F.array_sort(F.transform("findings", lambda f: F.struct(f["start"].alias("start"), F.when(f["base"], F.array_position(kinds, f["kind"])).otherwise(99).alias("rank"), f["kind"].alias("kind"), f["end"].alias("end"))))
    return out.select(
        "doc_id", *[pii.counted(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(by_start).alias("spans")
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    rows = fingerprints.with_next(documents, "doc_id", ["text"], {"print": fingerprints.fingerprint(F.col("text"))})
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "print", "next_print")
    rows = rows.withColumn("edited_print", fingerprints.fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.shown(F.col("print")).alias("fingerprint"), fingerprints.shown(F.col("edited_print")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), fingerprints.likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), f"{TOKENIZERS}/piece_bpe_32k.model")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_benchmark(documents, table(spark, sf_dir, "benchmark"))
    return out.where(F.size("matches") > 0).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_language_id, op3_license_scan, op4_pii, op5_sharding, op6_suffix_dedup, op7_secret_scan, op8_fingerprints, op9_sentencepiece, op10_decontamination, lang_pages)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: What SQL can say as a whole.  Rules with offsets, trained models, merges and draws of a permutation are held against
#: plain versions by tests instead.
ORACLE_SQL: dict[str, str] = {
    # All pairs with a shingle in common, then everything reachable over the linked ones.
    "op1_minhash_dedup": f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS same FROM s GROUP BY doc_id), r AS MATERIALIZED (SELECT same, min(doc_id) AS id, any_value(n) AS n FROM n GROUP BY same),
  t AS MATERIALIZED (SELECT r.id, r.n, s.s FROM r JOIN s ON s.doc_id = r.id), c AS (SELECT a.id AS x, b.id AS y, count(*) AS c, any_value(a.n) + any_value(b.n) AS total FROM t a JOIN t b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id),
  e AS MATERIALIZED (SELECT x, y FROM c WHERE 100 * c >= 85 * (total - c)), u AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e), reach AS (SELECT DISTINCT x AS id, x AS other FROM u UNION SELECT reach.id, u.y FROM reach JOIN u ON u.x = reach.other),
  k AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.component, r.id, d.doc_id) AS component_id, d.doc_id = coalesce(k.component, r.id, d.doc_id) AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.same = n.same LEFT JOIN k ON k.id = r.id""",
    # All windows of 200 bytes by their MD5, in hexadecimal; texts are cut first, as substr walks from the start.
    "op6_suffix_dedup": """WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), p AS (SELECT doc_id, k * 500 AS base, substr(h, k * 1000 + 1, 1398) AS part FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 + 499) // 500)) AS k FROM h)),
  w AS MATERIALIZED (SELECT doc_id, base + i AS place, md5(substr(part, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, base, part, unnest(range(0, least(500, length(part) // 2 - 199))) AS i FROM p)),
  again AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1), r AS (SELECT doc_id, place FROM w SEMI JOIN again USING (m)),
  g AS (SELECT doc_id, place, sum(fresh) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM (SELECT doc_id, place, CASE WHEN place - lag(place) OVER (PARTITION BY doc_id ORDER BY place) <= 200 THEN 0 ELSE 1 END AS fresh FROM r)),
  x AS MATERIALIZED (SELECT doc_id, min(place) AS a, max(place) + 200 AS b FROM g GROUP BY doc_id, run), y AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM x GROUP BY doc_id),
  kept AS (SELECT doc_id, a AS upto, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM (SELECT doc_id, a, b FROM x UNION ALL SELECT doc_id, length(h) // 2, NULL FROM h)),
  z AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (upto - since)), '' ORDER BY since) AS left_over FROM kept JOIN h USING (doc_id) GROUP BY doc_id)
  SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(left_over)) AS kept_sha256 FROM h JOIN z USING (doc_id) LEFT JOIN y USING (doc_id)""",
}

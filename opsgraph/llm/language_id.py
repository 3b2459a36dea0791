"""Language identification by Bayesian fusion of evidence.

The text gives a likelihood for each language (naive Bayes over hashed byte trigrams of the folded text, tempered,
since trigrams are not independent).  A declared markup language and the address suffix are noisy observations of the
language.  The prior is the host's: expected counts by host from a grouped aggregation of the texts' posteriors,
smoothed towards the host's domain, which is smoothed towards the corpus.  The posterior multiplies them all.

The text model is fitted on a bounded sample of labelled rows, about ``sample_rows`` of them chosen by a hash of the
key, at any size; priors are counted over all rows.  One pass over the texts, whose evidence is written, and no shuffle
of them: only sums by host move.  Hosts are broadcast while there are at most ``BROADCAST_HOSTS``; beyond, they are joined.

Results: a text without letters (null and empty ones too) is undetermined (``und``) and not kept.  A null host has the
corpus prior, a null or unknown declaration or suffix is no evidence.  Without labelled rows every text with letters is
``und`` and kept.  Texts of any length count whole, repeated rows have equal results; of equally likely languages the
first by name is given.  A column of the input with the name of one that is made here is an error.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import column_map, materialise, reject_clashes

BUCKETS = 1 << 16
#: Labelled rows that the text model is fitted on, about, and languages at most (those with the most rows among them).
SAMPLE_ROWS, LANGUAGES = 4000, 200
#: Weight of a trigram's evidence, and pseudo-counts of a bucket, a host and a domain.
TEMPER, ALPHA, HOST_WEIGHT, DOMAIN_WEIGHT = 0.1, 0.5, 20.0, 50.0
#: Probability that a declaration, or a national suffix, is right.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.85, 0.8
#: Posterior from which a row is kept.
LEAST_POSTERIOR = 0.5
#: Hosts of at most some 100 bytes each, so a broadcast stays below a few MB.
BROADCAST_HOSTS = 20_000
#: National suffixes and the languages they speak for.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl", "se": "sv"}

_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of all byte trigrams of the lower-cased text, what isn't a letter being a space; none without letters."""
    folded = b" " + b" ".join((text or "").lower().encode().translate(_LETTERS).split()) + b" "
    if len(folded) < 3:
        return np.zeros(0, np.int64)
    b = np.frombuffer(folded, np.uint8).astype(np.int64)
    return (b[:-2] * 40503 + b[1:-1] * 9973 + b[2:] * 257) % BUCKETS


class TextModel:
    """Log-probabilities of buckets by language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        table = np.array([counts[x] for x in self.languages], float).reshape(len(self.languages), BUCKETS) + ALPHA
        self.table = np.ascontiguousarray(np.log(table / table.sum(1, keepdims=True)).T.astype(np.float32)) if self.languages else None

    def evidence(self, text: str | None) -> list[float] | None:
        """Tempered log-likelihoods less the largest, in order of ``languages``; None without letters."""
        at = trigrams(text)
        if not len(at) or not self.languages:
            return None
        total = np.add.reduce(self.table[at], 0, dtype=np.float64) * TEMPER
        return (total - total.max()).tolist()


def _code(label: Column) -> Column:
    """The language of a label such as ``en``, ``en-GB`` or ``EN_us``."""
    return F.lower(F.substring_index(F.substring_index(F.trim(label), "-", 1), "_", 1))


def fit(df: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """The text model from about ``sample_rows`` labelled rows with the smallest hashes of the key."""
    labelled = df.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), _code(F.col(label).cast("string")).alias("label"), F.col(text).alias("text"))
    share = min(1.0, sample_rows / max(1, labelled.count()))
    if share < 1:
        labelled = labelled.where(F.pmod(F.xxhash64(F.col("key")), F.lit(1 << 30)) < int(share * (1 << 30)))
    known = [r.label for r in labelled.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LANGUAGES).collect()]
    labelled = labelled.where(F.col("label").isin(known))
    schema = "label string, bucket int, n long"

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                np.add.at(sums.setdefault(name, np.zeros(BUCKETS, np.int64)), trigrams(body), 1)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["label", "bucket", "n"])

    counts: dict[str, np.ndarray] = {}
    rows = labelled.select("label", "text").mapInArrow(count, schema).groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # languages times buckets at most
        counts.setdefault(r.label, np.zeros(BUCKETS, np.int64))[r.bucket] = r.n
    return TextModel(counts)


def with_evidence(df: DataFrame, model: TextModel, text: str = "text") -> DataFrame:
    """All columns and ``__evidence``, the text's log-likelihoods (null without letters)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*df.schema, T.StructField("__evidence", T.ArrayType(T.DoubleType()))])
    sent = df.sparkSession.sparkContext.broadcast((model.languages, model.table))
    keep = df.columns

    def convert(texts: pa.Array) -> dict[str, pa.Array]:
        own = object.__new__(TextModel)
        own.languages, own.table = sent.value
        return {"__evidence": pa.array([own.evidence(t) for t in texts.to_pylist()], pa.list_(pa.float64()))}

    return df.mapInArrow(column_map(convert, text, to_arrow_schema(schema), keep), schema)


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def _observed(value: Column, languages: list[str], right: float) -> Column:
    """Log-probability of a noisy observation for each language; zeros where it says nothing."""
    other = (1 - right) / max(1, len(languages) - 1)
    known = F.array(*[F.when(value == x, F.lit(float(np.log(right)))).otherwise(F.lit(float(np.log(other)))) for x in languages])
    return F.when(value.isin(languages), known).otherwise(F.array(*[F.lit(0.0)] * len(languages)))


def host_priors(rows: DataFrame, languages: list[str]) -> DataFrame:
    """``__host`` and ``__prior``: expected counts by host, smoothed towards the domain's, those towards the corpus's.

    ``rows`` have ``__host`` and ``__posterior``.  Sums are partial before the shuffle, so a hot host is one row a task.
    """
    k = len(languages)
    sums = [F.sum(F.col("__posterior")[i]).alias(f"c{i}") for i in range(k)]
    hosts = rows.where(F.col("__posterior").isNotNull()).groupBy("__host").agg(*sums)
    hosts = hosts.withColumn("__domain", F.when(F.col("__host").contains("."), F.substring_index("__host", ".", -2)).otherwise(F.lit("")))
    domains = hosts.groupBy("__domain").agg(*[F.sum(f"c{i}").alias(f"d{i}") for i in range(k)])
    whole = domains.agg(*[F.sum(f"d{i}").alias(f"g{i}") for i in range(k)])
    def add(names):
        return reduce(lambda a, b: a + b, [F.col(x) for x in names])
    prior = [(F.col(f"g{i}") + 1) / (add([f"g{j}" for j in range(k)]) + k) for i in range(k)]
    domain = [(F.col(f"d{i}") + DOMAIN_WEIGHT * prior[i]) / (add([f"d{j}" for j in range(k)]) + DOMAIN_WEIGHT) for i in range(k)]
    host = [(F.col(f"c{i}") + HOST_WEIGHT * F.col(f"p{i}")) / (add([f"c{j}" for j in range(k)]) + HOST_WEIGHT) for i in range(k)]
    domains = domains.crossJoin(F.broadcast(whole)).select("__domain", *[domain[i].alias(f"p{i}") for i in range(k)])  # one row
    return hosts.join(domains, "__domain").select("__host", F.array(*host).alias("__prior"))


def identify(df: DataFrame, model: TextModel, text: str = "text", host: Column | None = None, declared: Column | None = None, suffix: Column | None = None, least: float = LEAST_POSTERIOR, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns (all by default) and ``language``, ``posterior``, ``kept``; one row for each row.

    ``host`` is an address's host (or any name of a source), ``declared`` a language code, ``suffix`` the last label of
    the host.  The evidence of the rows is written with the columns to keep, so leave out what isn't needed.
    """
    keep = list(df.columns if keep is None else keep)
    reject_clashes(keep, ["language", "posterior", "kept"])
    null = F.lit(None).cast("string")
    host, declared, suffix = (x if x is not None else null for x in (host, declared, suffix))
    if not model.languages:
        letters = F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}")
        return df.select(*keep, F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), letters.alias("kept"))
    k, pairs = len(model.languages), [F.lit(x) for p in SUFFIXES.items() for x in p]
    spoken = F.create_map(*pairs)[F.lower(suffix)]
    rows = df.select(*keep, F.col(text).alias("__text"), F.coalesce(F.lower(host), F.lit("")).alias("__host"), _code(declared).alias("__declared"), spoken.alias("__spoken"))
    likely = materialise(with_evidence(rows, model, "__text").drop("__text"), "evidence")
    priors = materialise(host_priors(likely.select("__host", _softmax(F.col("__evidence")).alias("__posterior")), model.languages), "hosts")
    few = priors.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = likely.join(F.broadcast(priors) if few else priors, "__host", "left")
    made = joined.withColumn("__posterior", F.when(F.col("__evidence").isNotNull(), posterior(model.languages)))
    top = F.array_max("__posterior")
    names = F.array(*[F.lit(x) for x in model.languages])
    made = made.withColumns({
        "language": F.when(top.isNull(), F.lit("und")).otherwise(F.get(names, (F.array_position("__posterior", top) - 1).cast("int"))),
        "posterior": F.coalesce(F.round(top, 6), F.lit(0.0)),
        "kept": F.coalesce(top >= least, F.lit(False)),
    })
    return made.select(*keep, "language", "posterior", "kept")


def posterior(languages: list[str]) -> Column:
    """Of a row's evidence, declaration, suffix and host prior, the probability of each language."""
    flat = F.array(*[F.lit(1.0 / len(languages))] * len(languages))
    logs = F.transform(
        F.arrays_zip(F.col("__evidence").alias("a"), _observed(F.col("__declared"), languages, DECLARED_RIGHT).alias("b"), _observed(F.col("__spoken"), languages, SUFFIX_RIGHT).alias("c"), F.coalesce("__prior", flat).alias("d")),
        lambda x: x["a"] + x["b"] + x["c"] + F.log(x["d"]),
    )
    return _softmax(logs)

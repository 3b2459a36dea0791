"""Names for SQL: text rules as functions, entity extraction as a table function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .vocabulary import EQUIPMENT_PREFIXES

#: SQL functions whose bodies are expressions, so that Catalyst inlines them.
SQL_FUNCTIONS = {
    "tag_prefix": ("tag STRING", "STRING", "regexp_extract(tag, '^[^0-9]*', 0)"),
    "within_one_edit": ("a STRING, b STRING", "BOOLEAN", "levenshtein(a, b, 1) >= 0"),
    "edge_key": ("source STRING, kind STRING, target STRING", "STRING", "concat(source, '-[', kind, ']->', target)"),
    "index_tokens": ("t STRING", "ARRAY<STRING>", "regexp_extract_all(lower(coalesce(t, '')), '[a-z0-9][a-z0-9\\\\-/]*', 0)"),
    "normalize_tag": (
        "tag STRING", "STRING",
        "CASE WHEN regexp_like(trim(coalesce(tag, '')), '^[A-Za-z]+[\\\\s\\\\-_]*\\\\d+[\\\\s\\\\-_]*[A-Za-z]?$') THEN concat(upper(regexp_extract(trim(tag), '^([A-Za-z]+)', 1)), '-', "
        "regexp_extract(trim(tag), '(\\\\d+)', 1), upper(regexp_extract(trim(tag), '\\\\d[\\\\s\\\\-_]*([A-Za-z])$', 1))) ELSE upper(trim(coalesce(tag, ''))) END",
    ),
}

#: Tags and ids of a text, a row each: the body of a table function, so that Catalyst inlines this as well.
ENTITIES = (
    "SELECT inline(concat(transform(array_distinct(filter(transform(regexp_extract_all(coalesce(t, ''), '\\\\b[A-Za-z]{1,3}[- ]?\\\\d{2,4}[A-Za-z]?\\\\b', 0), "
    "x -> concat(upper(regexp_extract(x, '^([A-Za-z]+)', 1)), '-', regexp_extract(x, '(\\\\d+)', 1), upper(regexp_extract(x, '\\\\d([A-Za-z])$', 1)))), "
    f"x -> substring_index(x, '-', 1) IN ({', '.join(repr(p) for p in EQUIPMENT_PREFIXES)}))), x -> named_struct('kind', 'Equipment', 'value', x)), "
    "transform(array_distinct(transform(regexp_extract_all(coalesce(t, ''), '(?i)\\\\b(?:SOP-\\\\d+|INC-\\\\d{4}-\\\\d+|WO-\\\\d+)\\\\b', 0), x -> upper(x))), "
    "x -> named_struct('kind', CASE left(x, 1) WHEN 'S' THEN 'Procedure' WHEN 'I' THEN 'Incident' ELSE 'WorkOrder' END, 'value', x))))"
)


def register(spark: SparkSession, llm=None) -> None:
    """Temporary functions of the session.  ``llm``, a function from a list of texts to a list of JSON strings, becomes
    the batched function ``llm_extract``; without one there is none (rules are the default)."""
    for name, (parameters, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION extract_entities(t STRING) RETURNS TABLE(kind STRING, value STRING) RETURN {ENTITIES}")
    if llm is not None:

        @F.pandas_udf("string")
        def extracted(texts: pd.Series) -> pd.Series:
            return pd.Series(llm(texts.fillna("").tolist()))

        spark.udf.register("llm_extract", extracted)

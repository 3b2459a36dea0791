import datetime
import glob
import math
import os

import duckdb
import pytest

from opsgraph.plans import queries as plans


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)[:10]
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    df = plans.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in plans.SQL:
        assert rows
        return
    want = oracle.sql(plans.SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    order = [want.columns.index(c) for c in names]
    assert sorted(tuple(plain(r[c]) for c in names) for r in rows) == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["best_snippet", "chunk_documents", "short_quotes"])
def test_odd_documents(spark, tmp_path, name):
    """Null, empty and blank texts, blank lines, spaces at the ends, other white space, control characters."""
    texts = [
        None, "", " ", " \t ", "\n\n", "\x01", "\x01\u00a0", "\u00a0", "\u00a0pump seal. \u00a0Leak of the seal\u00a0", "\u3000wide", "  ends  ", "a\n\nb", "\n\npump\n \nvalve seal. End", "\tpump.\tvalve\t.\n", "one\x0btwo. \x0bthree seal.\x0bfour", "seal\x01pump leak. leak\x01end",
        "pump\x1cseal\x85leak\u2028end.\u2003seal", "\r\nseal.\r\npump", "x" * 699 + "\n\n" + "y" * 700, "\U0001f600" * 701, "e\u0301" * 700, "\u0130nsan se\u0130l. \u212aelvin seal pump", "\u0130 SEAL. \u0130SEAL", ".. . .", "..\n.\n", "\n" * 5 + "seal", " \n " * 400, "\u1680seal\u180e. \u200bpump", "\ufeffpump seal. \ufeff",
        " ".join(f"w{i}" for i in range(16)) + "\x0bseal", "\t", "\f", "a. " + "\u00a0" * 300 + "seal pump leak", "\x00seal. \x00pump",
    ]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "seal leak of the pump kelvin"), (1, "iseal insan seil three pump")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(plans.SQL[name])
    got = plans.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)

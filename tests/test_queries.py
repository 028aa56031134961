"""Every registered query against its oracle, in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


def test_names_pair_up():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    expected = sorted(repr(tuple(plain(r[k]) for k in at)) for r in want.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect()) == expected


def test_text_fields_of_odd_texts(spark, tmp_path):
    texts = [None, "", "  ", "\t", "\n \n", "\u00a0", "\u3000 ", " a ", "\u00a0a", " " * 40 + "abc", "\u2003" * 41 + "abc", "\t" * 40 + "x", "e\u0301" * 60, "x" * 3000, "a\x00b", "\u200b"]
    rows = [(i, text, lang, "web") for i, (text, lang) in enumerate((t, x) for t in texts for x in ("en", None, "", " ", "\u3000"))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r.text_id: (r.title, r.body) for r in QUERIES["text_fields"](spark, str(tmp_path)).collect()}
    assert got == {k: (title, body) for k, title, body in con.sql(f"SELECT text_id, title, body FROM ({ORACLES['text_fields']}) x").fetchall()}
    assert got[1] == (None, None) and got[45] == (" " * 40 + "abc", " " * 40 + "abc\nen")


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1

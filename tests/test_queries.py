"""Every query that has SQL, on the smallest tables, against DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return value.isoformat() if hasattr(value, "isoformat") else repr(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    got = entry.queries()[name](spark, DATA)
    names = sorted(got.columns)
    want = tables.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == names
    places = [want.columns.index(c) for c in names]
    rows = sorted(tuple(plain(r[i]) for i in places) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == rows


def test_names_tell_what_they_have_no_sql_for():
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert without <= {"op1_toxicity", "op2_jaccard_join", "op4_decontaminate", "op5_additive_ann", "op7_quality", "op9_recompression", "op10_token_store", "op11_pii", "pipeline", "doc_id_hash", "page_documents", "svd_neighbors", "glove_train_cost", "word2vec_vectors", "skipgram_vectors", "paragraph_vectors", "cbow_vectors"}

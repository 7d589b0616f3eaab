"""The operators' queries against their SQL: on the smallest tables, and on tables with
copies, repeats, revisits and gaps."""

import math

import duckdb
import pytest

from verbarium.llm import queries

DATA = "/root/testdata/sf0.001"


def plain(value):
    return ("nan" if math.isnan(value) else f"{value:.9g}") if isinstance(value, float) else repr(value)


def same(spark, name, folder, tables):
    con = duckdb.connect()
    for table in tables:
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet{'' if folder == DATA else '/*.parquet'}')")
    got = queries.QUERIES[name](spark, folder)
    names = sorted(got.columns)
    want = con.sql(queries.ORACLE[name])
    places = [want.columns.index(c) for c in names]
    rows = sorted(tuple(plain(r[i]) for i in places) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == rows
    return want


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_smallest_tables(spark, name):
    same(spark, name, DATA, ["documents", "pages", "embeddings"])


def test_revisits(spark, tmp_path):
    html = "<p>" + "x" * 120
    rows = [(i, f"http://h.org/{i}", html if i % 3 else f"own {i} " * 30) for i in range(40)] + [(50, None, None), (51, None, ""), (52, "http://é", "short"), (53, "u", "short")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = same(spark, "op6_warc", str(tmp_path), ["pages"])
    assert sum(r[want.columns.index("record_type")] == "revisit" for r in want.fetchall()) == 25


def test_copies_and_repeats(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(30))
    long = " ".join(f"l{i}" for i in range(400))
    texts = [passage, passage, f"a {passage} b", None, "", "one", "one two", "ONE two", long, long + " tail", "x " * 60, f"{passage} {passage}", "one\ttwo\n"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("op2_jaccard_join", "op9_recompression", "op8_mixing"):
        same(spark, name, str(tmp_path), ["documents"])

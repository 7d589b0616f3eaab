import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verbarium.llm import token_store
from verbarium.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


PIECES = st.sampled_from(["word", "Wörd", " ", "  ", "\n", "\n\n", "\t", " ", " ", "　", ".", ",", "!?", "'s", "'", "don't", "é", "12", "３", "日本", "<|endoftext|>", "<|", "\x1c", "—", "😀", "\r\n", "a.b", "...", "\x85"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=5))
def test_pieces_encode_as_whole_texts(texts):
    tool = token_store.encoder(tokenizer_path())
    ids, sizes = zip(*tool.encode(pa.array(texts)))
    got = np.split(np.concatenate(ids), np.cumsum(np.concatenate(sizes))[:-1])
    assert [x.tolist() for x in got] == [tool.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def expected(tokenizer, rows):
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(spark, tokenizer, tmp_path, encoding):
    rows = [(i * 7 % 101, f"Text {i} of some, words.\n" * (i % 5)) for i in range(101)]
    rows += [(3, "twice"), (3, "twice"), (3, None), (None, "no id"), (200, ""), (201, "long word " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as shard").repartition(3)
    path = str(tmp_path / "store")
    token_store.write_tokens(docs, path, tokenizer_path(), encoding=encoding, shards=3)
    key = lambda r: (r[1], r[2])
    assert sorted(map(tuple, token_store.read_digests(spark, path).collect()), key=key) == expected(tokenizer, rows)
    assert sorted(map(tuple, token_store.read_metadata(spark, path).collect()), key=key) == [r[:3] for r in expected(tokenizer, rows)]
    (row,) = token_store.read_tokens(spark, path, [14]).collect()
    assert row["ids"] == [*tokenizer.encode(dict(rows)[14], add_special_tokens=False).ids, 0]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_store.token_digests(docs, tokenizer_path()).collect() == []


def test_metadata_reads_few_columns(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_tokens(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), path, tokenizer_path())
    plan = token_store.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_rows_without_an_id_fill_several_shards(spark, tokenizer, tmp_path):
    rows = [(None, f"text {i % 400} of none") for i in range(2000)] + [(7, f"{i} of seven") for i in range(500)] + [(8, "copy")] * 500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    path = str(tmp_path / "store")
    token_store.write_tokens(docs, path, tokenizer_path(), shards=4)
    sizes = [r["n"] for r in spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 1500
    got = sorted(map(tuple, token_store.read_digests(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 2000 + [7] * 500 + [8] * 500
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in expected(tokenizer, [(r[0] or 0, r[1]) for r in rows]))

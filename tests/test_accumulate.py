"""Sums inside tasks against joins of every word."""

import random

import pytest
from pyspark.sql import functions as F

from verbarium.operators import accumulate, cooccurrence


def docs_of(spark, seed):
    rng = random.Random(seed)
    words = ["a", "B", "Ñu", "cc", "d_1", "½", "ß", "x", "é", "3"] + [f"r{i}" for i in range(30)]
    marks = [" ", " ", " ", ". ", ".", "\n", ", ", " — ", "\n\n"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(30)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, ". \n. "), (903, "a " * 3000), (904, "İstanbul ǅ ﬁn")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def plain(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("small", [False, True])
def test_words_and_cells(spark, monkeypatch, small):
    if small:  # tiny runs, tables and bounds
        for name, value in (("RUN", 50), ("DENSE", 3), ("MOST_HELD", 40)):
            monkeypatch.setattr(accumulate, name, value)
    docs = docs_of(spark, 1)
    rows = cooccurrence.sentence_table(docs, "text")
    by_row = lambda least: rows.where(F.size("tokens") >= least).select(F.explode("tokens").alias("word")).groupBy("word").count()
    for least in (1, 2):
        assert plain(cooccurrence.vocabulary_of(docs, "text", least_tokens=least)) == plain(by_row(least))
        assert plain(cooccurrence.vocabulary(rows, least_tokens=least)) == plain(by_row(least))
    vocab = cooccurrence.with_ids(cooccurrence.vocabulary_of(docs, "text", min_count=3)).cache()
    for window, weighting in ((5, "count"), (3, "inverse"), (25, "inverse"), (4, "expected")):
        joined = cooccurrence.counted(cooccurrence.placed(rows, vocab, numbered=False), window, weighting)
        key = ("w", "c", F.round("x", 6).alias("x"))
        want = plain(joined.select(*key))
        assert plain(cooccurrence.cells_of(docs, vocab, window, weighting).select(*key)) == want
        assert plain(accumulate.cells(rows, vocab, window, weighting, "tokens").select(*key)) == want


def test_large_vocabularies_are_joined(spark, monkeypatch):
    docs = docs_of(spark, 2)
    vocab = cooccurrence.with_ids(cooccurrence.vocabulary_of(docs, "text")).cache()
    want = plain(cooccurrence.cells_of(docs, vocab, 5))
    monkeypatch.setattr(accumulate, "MOST_WORDS", 10)
    assert accumulate.cells(docs, vocab, 5) is None
    assert plain(cooccurrence.cells_of(docs, vocab, 5)) == want


def test_pairs_are_summed_before_they_travel(spark):
    """The rows that are shuffled are a few blobs a task, whatever the number of pairs."""
    docs = spark.createDataFrame([(i, "one two three four " * 500) for i in range(40)], "doc_id bigint, text string").repartition(4).cache()
    vocab = cooccurrence.with_ids(cooccurrence.vocabulary_of(docs, "text"))
    cells = accumulate.cells(docs, vocab, 5)
    assert cells.agg(F.sum("x")).first()[0] == 2 * 40 * sum(2000 - d for d in range(1, 6))
    assert cells.count() == 16


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    vocab = cooccurrence.with_ids(cooccurrence.vocabulary_of(docs, "text"))
    assert vocab.collect() == [] and cooccurrence.cells_of(docs, vocab, 5).collect() == []
    assert cooccurrence.cells_of(docs_of(spark, 3), vocab, 5).collect() == []


def test_pairs_of_a_batch_take_bounded_memory():
    """Pairs of all distances of a run are held at once, so runs are short."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["word " * 20_000] * 60)], ["text"])  # 6 MB
    sums = accumulate.Sums(1_000_000, np.ones(10))
    tracemalloc.start()
    n = 0
    for words, sentence in accumulate.runs(iter([batch]), True):
        sums.add(2000 + np.arange(len(words)) % 5000, sentence)
        n += len(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1_200_000 and sums.take(last=True)[1].sum() == 60 * sum(20_000 - d for d in range(1, 11))
    assert peak < 350 << 20


@pytest.mark.parametrize("small", [False, True])
def test_widths_and_drops_by_key(spark, monkeypatch, small):
    """Widths of their own and dropped words, inside tasks as by joins; nothing is joined, and no word's row travels."""
    if small:
        for name, value in (("RUN", 50), ("DENSE", 3), ("MOST_HELD", 40)):
            monkeypatch.setattr(accumulate, name, value)
    docs = docs_of(spark, 3)
    rows = cooccurrence.sentence_table(docs, "text")
    vocab = cooccurrence.with_ids(cooccurrence.vocabulary_of(docs, "text", min_count=3)).cache()
    for subsample in (0.0, 0.02):
        placed = cooccurrence.placed(rows, vocab, subsample=subsample, seed=5).cache()
        want = plain(cooccurrence.cooccurrence(cooccurrence.pairs(placed, 4, dynamic=True, seed=5)))
        found = cooccurrence.dynamic_cells(docs, vocab, 4, subsample=subsample, seed=5)
        assert plain(found) == want
        assert plain(cooccurrence.dynamic_cells(rows, vocab, 4, "tokens", subsample=subsample, seed=5)) == want
        assert plain(cooccurrence.subsampled_counts(docs, vocab, subsample, seed=5)) == plain(placed.groupBy(F.col("id").cast("bigint").alias("id")).agg(F.count("*").alias("kept")))
        lists = accumulate.id_lists(rows, vocab, subsample, seed=5).collect()
        assert sorted(i for r in lists for i in r["ids"]) == sorted(r["id"] for r in placed.collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Generate" not in plan


def test_no_word_is_common_enough(spark):
    docs = docs_of(spark, 4)
    vocab = cooccurrence.with_ids(cooccurrence.vocabulary_of(docs, "text", min_count=10**6)).cache()
    assert cooccurrence.subsampled_counts(docs, vocab, 1e-3).count() == 0
    assert cooccurrence.ppmi(cooccurrence.dynamic_cells(docs, vocab, 3, subsample=1e-3)).count() == 0

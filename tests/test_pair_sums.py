from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from verbarium.operators import accumulate, cooccurrence


@pytest.mark.parametrize("n", [40, 3_000_000_000])
@pytest.mark.parametrize("window", [1, 5])
def test_pairs_are_summed_exactly(monkeypatch, n, window):
    """With the distance in the number that is sorted, or beside it where words are too many."""
    monkeypatch.setattr(accumulate, "DENSE", 4)
    sorted_places, real = [], accumulate.merged
    monkeypatch.setattr(accumulate, "merged", lambda k, v: sorted_places.append(len(k)) or real(k, v))
    rng = np.random.default_rng(3)
    weights, _ = accumulate._fraction(window, "inverse")
    ranks, sentence = rng.integers(0, 40, 3000), np.sort(rng.integers(0, 200, 3000))
    want = Counter()
    for d, weight in enumerate(weights, 1):
        for i in np.flatnonzero(sentence[d:] == sentence[:-d]).tolist():
            want[min(ranks[i], ranks[i + d]) * n + max(ranks[i], ranks[i + d])] += weight
    sums = accumulate.Sums(n, weights)
    sums.add(ranks, sentence)
    assert len(sorted_places) == (n > 40)
    keys, values = sums.take(last=True)
    assert dict(zip(keys.tolist(), values.tolist(), strict=True)) == {int(k): x for k, x in want.items()}
    sums.add(ranks[:0], sentence[:0])
    assert not len(sums.take()[0])


def test_sums_travel_in_few_bytes():
    """Differences and sums by their bytes: pairs of one task, dealt out to 32 partitions, took 7 to 8 bytes each."""
    rng = np.random.default_rng(5)
    ranks = np.minimum((1 / rng.random(400_000)).astype(np.int64), 99_999)
    sums = accumulate.Sums(100_000, accumulate._fraction(5, "inverse")[0])
    sums.add(ranks, np.arange(len(ranks)) // 20)
    keys, values = sums.take()
    keys = np.append(keys, 7)  # not in order, as where the dense table goes first
    values = np.append(values, 0.1)
    blob = accumulate.squeezed(keys, values)
    assert len(blob) < 4 * len(keys)
    for got, want in zip(accumulate.unsqueezed(blob), (keys, values), strict=True):
        assert got.dtype == want.dtype and (got == want).all()
    assert not len(accumulate.unsqueezed(accumulate.squeezed(keys[:0], values[:0]))[0])


def test_words_are_found_without_a_table_of_the_vocabulary(monkeypatch):
    words = pa.array([f"w{x}" for x in range(300_000)] + ["", "x" * 5000, "x" * 5001])
    own = accumulate.hashes(words)
    assert (accumulate.hashes(words.slice(299_990).cast(pa.large_string())) == own[299_990:]).all() and len(np.unique(own)) == len(own)
    order = np.argsort(own).astype(np.int32)
    chosen = accumulate.Chosen((words, None, None, own[order], order))
    asked, old = pa.array(["w7", "w300000", "w299999", "x" * 5001, "w7"], pa.large_string()), pa.default_memory_pool()
    pool = pa.proxy_memory_pool(old)
    pa.set_memory_pool(pool)
    try:
        assert chosen.ranked(asked).tolist() == [7, -1, 299_999, 300_002, 7]
    finally:
        pa.set_memory_pool(old)
    assert (pool.max_memory() or 0) < 1 << 20
    real = accumulate.hashes
    monkeypatch.setattr(accumulate, "hashes", lambda x: np.full(len(x), real(words.slice(9, 1))[0]))
    assert chosen.ranked(asked).tolist() == [-1] * 5  # an equal hash isn't an equal word


def test_words_that_share_a_hash_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a c. b c")], "doc_id bigint, text string")
    vocab = cooccurrence.with_ids(cooccurrence.vocabulary_of(docs, "text")).cache()
    want = sorted(map(tuple, accumulate.cells(docs, vocab, 2).collect()))
    monkeypatch.setattr(accumulate, "hashes", lambda x: np.zeros(len(x), dtype=np.uint64))
    assert accumulate.cells(docs, vocab, 2) is None
    assert sorted(map(tuple, cooccurrence.cells_of(docs, vocab, 2).collect())) == want


@pytest.mark.parametrize("joined", [False, True])
def test_ppmi_of_one_way_of_each_pair(spark, monkeypatch, joined):
    """Half the cells are stored, with the same result."""
    docs = spark.createDataFrame([(k, "a b a c d. b c a a " * (k % 3 + 1) + f"e{k} d") for k in range(20)], "doc_id bigint, text string")
    vocab = cooccurrence.with_ids(cooccurrence.vocabulary_of(docs, "text")).cache()
    got = lambda cells, **how: {(r["w"], r["c"]): round(r["x"], 9) for r in cooccurrence.ppmi(cells, **how).collect()}
    want = got(cooccurrence.cells_of(docs, vocab, 3))
    if joined:
        monkeypatch.setattr(accumulate, "MOST_WORDS", 1)
    half = cooccurrence.cells_of(docs, vocab, 3, mirror=False)
    assert half.where("w = c").count() > 0 and half.count() == cooccurrence.cells_of(docs, vocab, 3).where("w <= c").count()
    assert want and got(half, mirrored=False) == want


def test_rows_travel_packed_in_the_same_order(spark):
    """One blob for each partition and task, not a row each; the order is that of the hashes."""
    rows = spark.range(5000, numPartitions=2).selectExpr("cast(id as int) as w", "if(id % 7 = 0, null, concat('x', id)) as c", "id / 4 as x")
    sent = cooccurrence.packed_rows(rows.selectExpr("*", "w % 3 as _part"), "_part")
    assert sent.count() == 6
    want = [tuple(r) for r in rows.selectExpr("*", "xxhash64(7, w, c, x) as h").orderBy("h").select("w", "c", "x").collect()]
    assert [tuple(r) for r in cooccurrence.shuffled(rows, 7).collect()] == want
    assert cooccurrence.shuffled(rows.where("w < 0"), 7).count() == 0

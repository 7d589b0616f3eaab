"""Trainings in strata against serial ones, and what they find on planted groups."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from verbarium.operators import accumulate, cooccurrence
from verbarium.plans import strata, training


def topics(spark, n=240, seed=1):
    rng = random.Random(seed)
    own = [[f"{t}{k}" for k in range(8)] for t in "xyz"]
    rows = [(i, 0, rng.choices(own[i % 3], k=12) + rng.choices(["the", "of"], k=3)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, sid int, tokens array<string>")


def apart(vectors, group):
    """Least mean cosine inside groups less the greatest between them."""
    names = sorted(vectors)
    x = np.array([vectors[k] for k in names])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    g = np.array([group(k) for k in names])
    same = {a: (x[g == a] @ x[g == a].T).mean() for a in set(g)}
    other = {(a, b): (x[g == a] @ x[g == b].T).mean() for a in set(g) for b in set(g) if a < b}
    return min(same.values()) - max(other.values())


def test_strata_meet_every_cell_once(spark):
    """Whatever the number of blocks, the steps see all cells, and each with its own parameters."""
    rng = np.random.default_rng(1)
    n, m = 23, 17
    i, j = rng.integers(0, n, 400), rng.integers(0, m, 400)
    cells = spark.createDataFrame(list(zip(i.tolist(), j.tolist(), [1.0] * 400)), "i int, j int, x double").repartition(3)

    def count(a, b, i, j, x, rng):
        np.add.at(a, (i, 0), b[j, 1] + 1)
        np.add.at(b, (j, 0), a[i, 1])
        return float(x.sum()), float(len(i))

    for p in (1, 4, 7):
        own = lambda side, b, count, rng: np.column_stack((np.zeros(count), np.arange(count) * p + b))  # noqa: E731, B023
        state = strata.started(spark, p, lambda b: len(range(b, n, p)), lambda b: len(range(b, m, p)), own, 1)  # noqa: B023
        state, cost = strata.epoch(state, strata.packed_cells(cells, p), p, (2, 2), count, 1)
        rows = {r["id"]: r["vec"] for r in strata.vectors(state, "r", p, 2).collect()}
        columns = {r["id"]: r["vec"] for r in strata.vectors(state, "c", p, 2).collect()}
        assert cost == 1.0 and len(rows) == n and len(columns) == m
        assert all(rows[k] == [float(sum(b + 1 for a, b in zip(i, j) if a == k)), float(k)] for k in range(n))
        assert all(columns[k][0] == float(sum(a for a, b in zip(i, j) if b == k)) for k in range(m))


def test_least_squares_falls_as_a_serial_trainer(spark):
    rows = topics(spark)
    costs = {}
    for p in (1, 4):
        costs[p] = []
        model = training.glove(rows, dimension=6, min_count=1, window=4, epochs=12, costs=costs[p], blocks=p)
        vec = {r["word"]: r["vec"] for r in model.collect() if r["word"] not in ("the", "of")}
        assert len(vec) == 24 and apart(vec, lambda w: w[0]) > 0
    for one, four in zip(costs[1][5:], costs[4][5:], strict=True):
        assert abs(one - four) < 0.05 * costs[1][0]
    assert costs[4][-1] < costs[4][0] / 4


def test_skipgram_in_strata(spark):
    rows, costs = topics(spark), []
    model = training.skipgram(rows, dimension=8, min_count=1, window=4, epochs=6, alpha=0.05, blocks=4, costs=costs)
    vec = {r["word"]: r["vec"] for r in model.collect() if r["word"] not in ("the", "of")}
    assert costs[-1] < costs[0] and len(vec) == 24 and apart(vec, lambda w: w[0]) > 0.3
    assert sorted(map(tuple, training.skipgram(rows.repartition(5), dimension=2, min_count=10_000).collect())) == []


def test_paragraph_vectors(spark):
    rows, costs = topics(spark, 150), []
    tags, vocab, columns = training.paragraph_vectors(rows, dimension=8, min_count=1, epochs=12, alpha=0.05, costs=costs, blocks=3)
    vec = {r["tag"]: r["vec"] for r in tags.collect()}
    topic = lambda tag: int(tag.split("_")[0]) % 3
    assert len(vec) == 150 and costs[-1] < costs[0] and apart(vec, topic) > 0.4
    new = training.inferred(topics(spark, 30, seed=9).withColumn("doc_id", F.col("doc_id") + 3000), vocab, columns, 8, epochs=20, alpha=0.05)
    both = vec | {r["tag"]: r["vec"] for r in new.collect()}
    assert len(both) == 180 and apart(both, topic) > 0.2


def test_alias_table():
    rng = np.random.default_rng(2)
    weights = np.array([5.0, 0.0, 1.0, 3.0, 0.5])
    share, other = strata.alias_table(weights)
    drawn = rng.integers(0, 5, 200_000)
    drawn = np.where(rng.random(200_000) < share[drawn], drawn, other[drawn])
    assert np.abs(np.bincount(drawn, minlength=5) / 200_000 - weights / weights.sum()).max() < 0.01


def test_too_large_to_share_raises(spark, monkeypatch):
    monkeypatch.setattr(training, "MOST_SHARED", 10)
    rows = topics(spark, 12)
    for work in (lambda: training.svd(rows, dimension=2, min_count=1), lambda: training.word2vec(rows, dimension=2, min_count=1, algorithm="cbow", hsoftmax=False)):
        with pytest.raises(ValueError):
            work()
    assert cooccurrence.vocabulary(rows).count() > 10


def test_cbow_examples_are_whole(spark):
    """Every word with a neighbour is a centre once, with all words of its own sentence in the window."""
    lists = [[1, 2, 3, 4], [5], [2, 2], []]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32()))], ["ids"])
    want = sorted((s[i] - 1, tuple(sorted(x - 1 for x in s[max(0, i - 2) : i] + s[i + 1 : i + 3]))) for s in lists for i in range(len(s)) if len(s) > 1)
    for most in (1, 3, 100):
        got = [(c, tuple(sorted(x[on > 0].tolist()))) for part in training._examples([batch], np.array([-2, -1, 1, 2]), True, most) for c, x, on in zip(*part, strict=True)]
        assert sorted((int(c), w) for c, w in got) == want
        pairs = [(int(c), int(x[0])) for part in training._examples([batch], np.array([-2, -1, 1, 2]), False, most) for c, x, _ in zip(*part, strict=True)]
        assert sorted(pairs) == sorted((c, x) for c, words in want for x in words)


def test_cbow_finds_groups(spark):
    rows = topics(spark, 600)
    for options in ({"hsoftmax": False, "negative": 4}, {"hsoftmax": True}):
        model = training.word2vec(rows, dimension=8, min_count=1, window=4, algorithm="cbow", epochs=12, alpha=0.3, **options)
        vec = {r["word"]: r["vec"] for r in model.collect() if r["word"] not in ("the", "of")}
        assert len(vec) == 24 and apart(vec, lambda w: w[0]) > 0.1


def test_scatter_adds_what_repeats():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((5, 3))
    b, at, v = a.copy(), rng.integers(0, 5, 40), rng.standard_normal((40, 3))
    np.add.at(a, at, v)
    strata.scatter(b, at, v)
    strata.scatter(b, at[:0], v[:0])
    assert np.allclose(a, b)


def test_parts_meet_every_cell_once(spark, monkeypatch):
    """Whatever the blocks, parts and jobs, the steps see all cells, and rows keep their names."""
    monkeypatch.setattr(strata, "PART_ROWS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # several parts a task
    rng = random.Random(4)
    rows = [(d, s, rng.choices("abcdefg", k=rng.choice([0, 3, 9])) + ["?"]) for d in range(12) for s in range(3)]
    sentences = spark.createDataFrame(rows, "doc_id bigint, sid int, tokens array<string>").repartition(3)
    vocab = spark.createDataFrame([(w, 9, i) for i, w in enumerate("abcdefg", 1)], "word string, count bigint, id int")

    def count(a, b, i, j, x, rng):
        np.add.at(a, (i, 0), x * (b[j, 2] + 1))
        np.add.at(b, (j, 1), x)
        return float(x.sum()), float(x.sum())

    for most, p, chain in ((accumulate.MOST_WORDS, 3, 1), (accumulate.MOST_WORDS, 3, 2), (0, 1, 1)):
        monkeypatch.setattr(accumulate, "MOST_WORDS", most)
        parts = training.tagged(sentences, vocab, p, "doc_id", 2, 1)
        first = parts.where("kind = 'r'").select("task", "part", F.expr("cast(repeat(chr(0), length(v)) as binary)").alias("v"))
        columns = spark.createDataFrame([("c", b, np.array([[1.0, 0.0, k] for k in range(b, 7, p)]).tobytes()) for b in range(p)], strata.STATE)
        done, columns, cost, old = strata.epoch_of_parts(first, columns, parts, p, 2, count, 1, chain=chain)
        assert cost == 1.0 and parts.where("kind = 't'").count() > 3
        blobs = {(r["task"], r["part"]): np.frombuffer(r["v"], "<f4").reshape(-1, 2) for r in done.collect()}
        names = {(r["task"], r["part"]): strata.parted(bytes(r["v"])) for r in parts.where("kind = 't'").collect()}
        got = {tag: float(v[0]) for k, tags in names.items() for tag, v in zip(tags, blobs[k], strict=True)}
        assert got == {f"{d}_{s}": float(sum("abcdefg".index(w) + 1 for w in t if w != "?")) for d, s, t in rows}
        seen = {b: np.frombuffer(v, "<f8").reshape(-1, 3) for b, v in ((r["block"], bytes(r["v"])) for r in columns.collect())}
        assert {"abcdefg"[k * p + b]: x[k, 1] for b, x in seen.items() for k in range(len(x))} == {w: float(sum(t.count(w) for _, _, t in rows)) for w in "abcdefg"}
        assert len(strata.named_vectors(done, parts.where("kind = 't'").select("task", "part", "v"), p, 2).collect()) == len(rows)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_frequent_words_do_not_overshoot():
    """Most pairs of a block have one word; steps on it taken together must not grow without end."""
    rng = np.random.default_rng(2)
    i, j = (np.minimum((1 / rng.random(20_000)).astype(np.int64) - 1, 599) for _ in range(2))
    a, b = (rng.random((600, 8)) - 0.5) / 8, np.hstack((np.bincount(j, minlength=600)[:, None] + 1.0, np.zeros((600, 8))))
    costs = []
    for number in range(4):
        cost, pairs = strata.negative_sampling(3, 0.025)(a, b, i, j, np.full(len(i), 7.0), np.random.default_rng(number))
        costs.append(cost / pairs)
        assert pairs == 140_000
    assert np.isfinite(a).all() and np.isfinite(b).all() and costs[-1] < costs[0] < 4 * np.log(2)


def test_svd_passes_read_pieces(spark):
    """Cells are put in order once; a pass sorts none of them, and gives the exact singular values."""
    rng = np.random.default_rng(4)
    dense = np.where(rng.random((80, 80)) < 0.3, rng.random((80, 80)), 0.0)
    dense[7], dense[:, 9] = 0, 0
    rows = [(int(w), int(c), float(dense[w, c])) for w, c in zip(*np.nonzero(dense), strict=True)]
    cells = spark.createDataFrame(rows, "w int, c int, x double")
    u, s, v = training.truncated_svd(cells, 80, 3, passes=60, tolerance=1e-9)
    want = np.linalg.svd(dense)
    assert np.allclose(s, want[1][:3]) and np.allclose(np.abs((u * want[0][:, :3]).sum(axis=0)), 1, atol=1e-3) and (v[9] == 0).all()
    pieces = list(training._of_pieces(training._pieces(iter(cells.orderBy("w", "c").toArrow().to_batches()))))
    assert sum(len(c) for c, *_ in pieces) == len(rows) and all((np.diff(c[turned]) >= 0).all() for c, *_, turned in pieces)


def test_parts_are_read_and_written_few_at_a_time(spark, monkeypatch):
    """A part is megabytes: a row group holds GROUPED of them, where it held all of a file."""
    monkeypatch.setattr(strata, "PART_BYTES", 4 * 8 * 2)  # parts of two rows, or a batch
    monkeypatch.setattr(strata, "GROUPED", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = spark.createDataFrame([(d, s, ["a", "b", "c"][: 1 + d % 3]) for d in range(30) for s in range(2)], "doc_id bigint, sid int, tokens array<string>").coalesce(1)
        vocab = cooccurrence.with_ids(cooccurrence.vocabulary(rows)).cache()
        parts = training.tagged(rows, vocab, 2, "doc_id", 8, 1)
        state = spark.createDataFrame([(0, k, bytes([k])) for k in range(20)], "task int, part bigint, v binary").coalesce(1)
        more = spark.read.parquet(strata.stored(state.withColumn("kind", F.lit("r")), "kind"))
        for table, whole in ((parts, 30), (more, 20)):
            files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in table.inputFiles()]
            sizes = [m.row_group(g).num_rows for m in files for g in range(m.num_row_groups)]
            assert max(sizes) <= 3 and sum(sizes) == table.count() >= whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

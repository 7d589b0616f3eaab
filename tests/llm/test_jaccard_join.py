import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbarium.llm import jaccard_join
from verbarium.llm.common import drop, materialize


def brute(rows, n, percent):
    """(id, size, component) of each row, from all pairs."""

    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if len(words) < n:
            return {tuple(words)} if words else set()
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((d, len(s), least[root(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def texts(seed, groups, vocabulary=400):
    """Groups of near copies of every size, with shared passages and exact copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([1, 2, 3, 8, 15, 40, 120]))]
        if rng.random() < 0.5:
            base[rng.randrange(len(base)) :] += passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [word()] * rng.randrange(1, 3)
            out.append(rng.choice(["  ", "\n", " "]).join(copy))
    rng.shuffle(out)
    return out


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as size", "'x' as sig", "doc_id as rep")
    return sorted((tuple(r) for r in jaccard_join.similar(docs.repartition(3), **options).collect()), key=repr)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_against_all_pairs(spark, n, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 300)  # many blocks a group
    rows = list(enumerate(texts(n, 90)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a"), (1004, "A"), (None, "a b c d e f"), (1005, "x " * 5000)]
    rows += [(1006, "x " * 5000), (7, rows[7][1]), (2000, rows[7][1].upper())]
    assert run(spark, rows, n=n, percent=percent) == brute(rows, n, percent)


def test_empty(spark):
    assert run(spark, []) == []


def test_all_alike(spark):
    rows = [(i, "the same text in every row of it") for i in range(50)]
    assert {r[2] for r in run(spark, rows)} == {0}


def test_search_finds_what_all_pairs_find():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64))
    sets = [np.unique(np.concatenate((base[rng.random(len(base)) > rng.choice([0.02, 0.2])], rng.integers(0, 2**63, rng.integers(0, 6), dtype=np.uint64)))) for _ in range(80)]
    forest, expected = jaccard_join.Forest(80), jaccard_join.Forest(80)
    for x, y in jaccard_join.t_occurrence(sets, 90):
        forest.join(x, y)
    for i in range(80):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 90 * (len(sets[i]) + len(sets[j]) - common):
                expected.join(i, j)
    same = lambda f: [[f.root(i) == f.root(j) for j in range(80)] for i in range(80)]
    assert same(forest) == same(expected)


def test_large_groups_in_rounds(spark, monkeypatch):
    """A group of many blocks is sent in several rounds, none of which sends more than a few copies of its sets."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 300)
    monkeypatch.setattr(jaccard_join, "COPIES", 2)
    written, real = [], jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df: written.append(df.columns) or real(df))
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base[: i % 30], f"x{i}", *base[i % 30 :]])) for i in range(120)] + [(500 + i, f"y{i} z y{i + 1}") for i in range(9)]
    assert run(spark, rows, n=1, percent=80) == brute(rows, 1, 80)
    assert written.count(["a", "b"]) >= 4


def test_written_tables_leave_no_shuffles(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffles()
    rows, path = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    wanted = time.time() + 10
    while shuffles() - before and time.time() < wanted:
        time.sleep(0.2)
    assert not shuffles() - before and sorted(r["k"] for r in rows.collect()) == list(range(7))
    drop(spark, path)

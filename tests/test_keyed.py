"""The table in buckets and the queue of jobs over it."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from verbarium.operators.jobqueue import JobQueue
from verbarium.sources.keyed import Folder, KeyedTable

SCHEMA = "k long, at long, text string"


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), ["k"], "at", 8)


def test_a_batch_rewrites_only_its_buckets(spark, table):
    first = [(k, 1, f"a{k}") for k in range(200)] + [(None, 1, None)]
    table.upsert(spark.createDataFrame(first, SCHEMA))
    before = table.manifest()["folders"]
    table.upsert(spark.createDataFrame([(7, 2, "new"), (7, 0, "old"), (7, 2, "new")], SCHEMA))
    after = table.manifest()["folders"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert rows(table.read()) == {r for r in first if r[0] != 7} | {(7, 2, "new")}
    assert rows(table.read(1)) == set(first)
    assert rows(table.lookup(7)) == {(7, 2, "new")} and rows(table.lookup(None)) == {(None, 1, None)} and rows(table.lookup(1000)) == set()
    assert table.lookup(7).rdd.getNumPartitions() == 1


def test_older_rows_ties_and_repeated_batches(spark, table):
    one = lambda *r: spark.createDataFrame([r], SCHEMA)
    assert table.upsert(one(1, 5, "a"), ("w", 0)) == 1
    assert table.upsert(one(1, 4, "b"), ("w", 1)) == 2
    assert rows(table.read()) == {(1, 5, "a")}
    assert table.upsert(one(1, 5, "c"), ("w", 2)) == 3
    assert rows(table.read()) == {(1, 5, "c")}
    assert table.upsert(one(1, 9, "d"), ("w", 2)) == 3 and rows(table.read()) == {(1, 5, "c")}
    assert table.upsert(one(1, 9, "d"), ("other", 0)) == 4 and rows(table.read()) == {(1, 9, "d")}


def test_empty_batches_further_columns_and_names_of_its_own(spark, table):
    none = spark.createDataFrame([], SCHEMA)
    table.upsert(none)
    assert rows(table.read()) == set() and table.lookup(1).count() == 0
    table.upsert(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], SCHEMA))
    before = table.manifest()["folders"]
    table.upsert(none, ("w", 0))
    assert table.manifest()["folders"] == before
    table.upsert(spark.createDataFrame([(1, 2, "c", 0.5)], SCHEMA + ", x double"))
    assert rows(table.read()) == {(1, 2, "c", 0.5), (2, 1, "b", None)}
    with pytest.raises(ValueError):
        table.upsert(none.withColumn("key_bucket", F.lit(1)))


def test_old_versions_are_cleared(spark, table):
    for v in range(4):
        table.upsert(spark.range(20).select(F.col("id").alias("k"), F.lit(v).cast("long").alias("at"), F.lit(str(v)).alias("text")))
    assert table.clear(1) > 0 and table.clear(1) == 0
    assert rows(table.read()) == {(k, 3, "3") for k in range(20)}
    with pytest.raises(Exception):
        table.read(2).count()


def test_writers_at_once_lose_nothing(spark, table):
    def write(k):
        for at in range(3):
            table.upsert(spark.createDataFrame([(k, at, "x"), (100 + at, k, "y")], SCHEMA), (str(k), at))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    assert table.version() == 12
    assert rows(table.read()) == {(k, 2, "x") for k in range(4)} | {(100 + at, 3, "y") for at in range(3)}


def test_a_file_is_placed_once(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: folder.put_new("x", str(i)), range(8)))
    assert sum(won) == 1 and folder.get("x") == str(won.index(True)) and folder.names() == ["x"]


def test_a_rename_does_not_overwrite(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    folder.links = False
    assert folder.put_new("x", "1") and not folder.put_new("x", "2")
    assert folder.get("x") == "1" and [n for n in folder.names() if not n.startswith(".")] == ["x"]


def test_workers_never_share_a_job(spark, tmp_path):
    def queue():
        return JobQueue(spark, str(tmp_path / "q"), 4)

    queue().add(spark.range(12).withColumnRenamed("id", "job_id"))
    with ThreadPoolExecutor(3) as pool:
        taken = list(pool.map(lambda w: queue().take(w, 0, 60, 3), "abc"))
    assert sorted(j for ids in taken for j in ids) == list(range(9))


def test_an_abandoned_job_is_taken_up_until_its_tries_are_spent(spark, tmp_path):
    q = JobQueue(spark, str(tmp_path / "q"), 4, most=3)
    q.add(spark.range(2).select(F.col("id").alias("job_id"), F.lit("m").alias("model")))
    assert q.take("a", 0, 60) == [0] and q.take("b", 59, 60, 5) == [1] and q.take("c", 59.5, 60) == []
    q.renew("b", 100, 60)
    assert q.take("c", 130, 60, 5) == [0]
    q.finish("a", 131, F.lit(True))
    q.finish("b", 131, F.lit(True))
    q.give_back("c", 131, F.lit(True))
    assert rows(q.jobs().select("job_id", "status", "worker", "tries", "model")) == {(0, "PENDING", None, 2, "m"), (1, "SUCCESS", "b", 1, "m")}
    assert q.take("d", 132, 1) == [0] and q.take("d", 200, 1) == []
    q.add(spark.range(3).select(F.col("id").alias("job_id"), F.lit("n").alias("model")))
    assert rows(q.jobs().select("job_id", "model")) == {(0, "m"), (1, "m"), (2, "n")}

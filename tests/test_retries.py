"""Times of fetches: waits after failures and distances within a source, over restarts."""

from datetime import datetime, timedelta, timezone

from verbarium.streaming import flows, retries

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "data_source string, source_id string, ts timestamp, outcome string"


def minute(at):
    return (at.replace(tzinfo=timezone.utc) - START) / timedelta(minutes=1)


class Log:
    """Each call of ``run`` adds a file of (source, id, minute, outcome) and goes on from the checkpoint."""

    def __init__(self, spark, tmp_path, **parameters):
        self.spark, self.at, self.parameters, self.seen = spark, str(tmp_path), parameters, set()

    def run(self, *rows):
        frame = self.spark.createDataFrame([(s, i, START + timedelta(minutes=m), o) for s, i, m, o in rows], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(f"{self.at}/in")
        orders = retries.fetch_orders(flows.stream(self.spark, f"{self.at}/in"), **self.parameters)
        got = {(r["data_source"], r["source_id"], minute(r["at"]), r["number_of_tries"]) for r in retries.run_to(orders, f"{self.at}/out", f"{self.at}/checkpoint").collect()}
        new, self.seen = got - self.seen, got
        return new


def test_failures_wait_longer_each_time_and_end(spark, tmp_path):
    log = Log(spark, tmp_path, wait=600, gap=60, most=3, lanes=1)
    assert log.run(("s", "a", 0, "pending"), ("s", "b", 0, "pending"), ("s", "c", 0, "pending"), ("t", "z", 1, "pending"), ("t", "tick", 2, "notfound")) == {("s", "a", 0, 0), ("s", "b", 1, 0), ("t", "z", 1, 0)}
    assert log.run(("s", "a", 3, "failure"), ("s", "b", 3, "success"), ("t", "tick", 12, "notfound")) == {("s", "c", 2, 0)}
    assert log.run(("s", "c", 12.5, "failure"), ("s", "b", 12, "failure"), ("t", "tick", 20, "notfound")) == {("s", "a", 13, 1)}
    assert log.run(("s", "a", 21, "failure"), ("s", "b", 22, "failure"), ("t", "tick", 100, "notfound")) == {("s", "c", 22.5, 1), ("s", "a", 41, 2)}
    assert log.run(("s", "a", 101, "failure"), ("t", "tick", 900, "notfound")) == set()


def test_rows_without_values_and_repeated_ones(spark, tmp_path):
    log = Log(spark, tmp_path, wait=60, gap=60, lanes=2)
    rows = [("s", "a", 0, "pending"), ("s", "a", 0, "pending"), (None, "a", 0, "pending"), ("s", None, 0, "pending"), ("s", "b", 0, None), ("s", "tick", 50, "success")]
    got = log.run(*rows)
    assert {r[:2] for r in got} == {("s", "a"), ("s", "b")} and len(got) == 2


def test_many_entries_of_a_lane(spark, tmp_path, monkeypatch):
    """Entries of a bucket, taken in over several reads of it and over restarts, are each told of once."""
    monkeypatch.setattr(retries, "TAKEN", 50)
    monkeypatch.setattr(retries, "BUCKETS", 3)
    log = Log(spark, tmp_path, wait=600, gap=0.5, lanes=1)
    rows = [("s", f"e{i:03}", 0, "pending") for i in range(300)]
    assert log.run(*rows, ("t", "tick", 60, "success")) == {("s", f"e{i:03}", i / 120, 0) for i in range(300)}
    failed = [("s", f"e{i:03}", 61, "failure") for i in range(0, 300, 2)]
    done = [("s", f"e{i:03}", 61, "success") for i in range(0, 300, 4)]
    assert log.run(*failed, *done, ("t", "tick", 90, "success")) == {("s", f"e{i:03}", 71 + n / 120, 1) for n, i in enumerate(range(2, 300, 4))}

"""Training and testing jobs that several workers share (survey P12): a worker leases
jobs until a deadline; the lease of a worker that is gone runs out and another takes the
job up. Every change is a batch of a ``KeyedTable`` that counts only on top of the
version that it was read from, so no two workers hold a lease of one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbarium.sources.keyed import KeyedTable

FREE, LEASED, DONE = "PENDING", "PROGRESS", "SUCCESS"


class JobQueue:
    """Rows (job_id, status, worker, until, tries, change, ...). Times are seconds of one
    clock, which the caller reads. ``most`` tries; then a job is left alone."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, most: int = 5):
        self.table = KeyedTable(spark, path, ["job_id"], "change", buckets)
        self.most = most

    def jobs(self) -> DataFrame:
        return self.table.read()

    def add(self, jobs: DataFrame) -> None:
        """Jobs (job_id, ...); those that the queue has stay as they are."""
        fresh = jobs.withColumns({"status": F.lit(FREE), "worker": F.lit(None).cast("string"), "until": F.lit(None).cast("double"), "tries": F.lit(0), "change": F.lit(0).cast("bigint")})
        while True:
            version = self.table.version()
            new = fresh.join(self.jobs().select("job_id"), "job_id", "left_anti") if version else fresh
            if self.table.upsert(new, at=version) is not None:
                return

    def take(self, worker: str, now: float, lease: float, n: int = 1) -> list:
        """The ids of up to ``n`` jobs leased to ``worker``: the smallest that are free or
        whose lease has run out."""
        ids: list = []

        def change(jobs: DataFrame) -> DataFrame:
            ids[:] = [r[0] for r in jobs.where(self._open(now)).select("job_id").orderBy("job_id").limit(n).collect()]
            return jobs.where(F.col("job_id").isin(ids)).withColumns({"status": F.lit(LEASED), "worker": F.lit(worker), "until": F.lit(float(now + lease)), "tries": F.col("tries") + 1})

        self._change(change, lambda: bool(ids))
        return ids

    def renew(self, worker: str, now: float, lease: float) -> None:
        """All jobs that ``worker`` holds, from now on."""
        self._change(lambda jobs: jobs.where(self._held(worker, now)).withColumn("until", F.lit(float(now + lease))))

    def finish(self, worker: str, now: float, done: Column) -> None:
        """Those of the worker's jobs for which ``done`` is true; jobs whose lease has run
        out aren't theirs any more."""
        self._change(lambda jobs: jobs.where(self._held(worker, now)).where(done).withColumns({"status": F.lit(DONE), "until": F.lit(None).cast("double")}))

    def give_back(self, worker: str, now: float, failed: Column) -> None:
        """Those that failed are free again; the try counts."""
        self._change(lambda jobs: jobs.where(self._held(worker, now)).where(failed).withColumns({"status": F.lit(FREE), "worker": F.lit(None).cast("string"), "until": F.lit(None).cast("double")}))

    def _open(self, now: float) -> Column:
        gone = (F.col("status") == LEASED) & (F.col("until") <= now)
        return ((F.col("status") == FREE) | gone) & (F.col("tries") < self.most)

    def _held(self, worker: str, now: float) -> Column:
        return (F.col("status") == LEASED) & (F.col("worker") == worker) & (F.col("until") > now)

    def _change(self, change, wanted=lambda: True) -> None:
        """Anew from the latest version until no other change comes between."""
        while True:
            version = self.table.version()
            rows = change(self.table.read(version)).withColumn("change", F.lit(version).cast("bigint"))
            if not wanted() or self.table.upsert(rows, at=version) is not None:
                return

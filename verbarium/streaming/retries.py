"""When each entry of the crawl log is to be fetched, kept by a stream (survey R02, R03, I04).

A new entry is due at once, a failed one after a wait that doubles with every failure, a
successful, missing or given-up one never again. A source's fetches keep a distance, so
that only so many a minute are out. The clock is the watermark of the log's own times: an
order goes out when its time has passed, by a timer of its source, and a restart goes on
from the checkpoint.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ORDERS = "data_source string, source_id string, at timestamp, number_of_tries int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Buckets of a lane's entries, and rows that a lane takes in at a time.
BUCKETS, TAKEN = 256, 200_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fetch_orders(log: DataFrame, wait: int = 60, gap: float = 1.0, most: int = 5, delay: str = "0 seconds", lanes: int = 8) -> DataFrame:
    """(data_source, source_id, at, number_of_tries) of each fetch, from a stream of
    (data_source, source_id, ts, outcome); outcomes are pending (new), failure, success or
    notfound. ``wait`` and ``gap`` are in seconds.

    Orders of a source go by due time, then id; each is ``gap`` seconds after the one before
    at least. A large source is dealt over ``lanes`` by its ids; a lane keeps the distance of
    ``gap * lanes``. The number of failures and the latest of them count, whatever order
    rows come in; rows at or before the watermark are dropped as late, as are those without an
    id, a time or a source. State, on disk: the entries of a lane in BUCKETS by their names,
    each read and written once for the rows of a batch that fall into it."""
    wait_ms, gap_ms = int(wait * 1000), int(gap * 1000 * lanes)
    lane = F.conv(F.substring(F.md5("source_id"), 1, 8), 16, 10).cast("bigint") % lanes
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).where("data_source is not null and source_id is not null and ts is not null")
    rows = rows.select("data_source", lane.cast("int").alias("lane"), "source_id", "ts", F.unix_millis("ts").alias("ms"), "outcome")
    waits, buckets, taken = [wait_ms * 2**k for k in range(most)], BUCKETS, TAKEN

    class Retries(StatefulProcessor):  # a local class travels by value
        def init(self, handle) -> None:
            self.handle = handle
            # name: (due, tries, failed); due: the time in ms, or one of the two marks below
            self.buckets = handle.getMapState("buckets", "bucket int", "entries binary")
            self.last = handle.getValueState("last", "at long")
            self.alarm = handle.getValueState("alarm", "at long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            first, held, size = None, {}, 0
            for frame in rows:
                for row in zip(frame["source_id"], frame["ms"], frame["outcome"]):
                    held.setdefault(zlib.crc32(row[0].encode()) % buckets, []).append(row)
                size += len(frame)
                if size >= taken:
                    first, held, size = self._take(held, first), {}, 0
            first = self._take(held, first)
            if first is not None:
                self._wake(first)
            yield from ()

        def _entries(self, bucket: int) -> dict:
            return pickle.loads(self.buckets.getValue((bucket,))[0]) if self.buckets.containsKey((bucket,)) else {}

        def _take(self, held: dict[int, list], first: int | None) -> int | None:
            """Enter rows by bucket; the first time that any of them, or ``first``, is due."""
            out, over = -1, -2
            for bucket, rows in held.items():
                entries = self._entries(bucket)
                for name, ms, outcome in rows:
                    due, tries, failed = entries.get(name, (None, 0, -1))
                    if due == over:
                        continue
                    if outcome == "failure":
                        tries, failed = tries + 1, max(failed, int(ms))
                        due = failed + waits[tries - 1] if tries < most else over
                    elif outcome in ("success", "notfound"):
                        due = over
                    elif due is None or (tries == 0 and due != out):
                        due = int(ms) if due is None else min(due, int(ms))
                    else:
                        continue
                    entries[name] = (due, tries, failed)
                    if due >= 0:
                        first = due if first is None else min(first, due)
                self.buckets.updateValue((bucket,), (pickle.dumps(entries, protocol=4),))
            return first

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentWatermarkInMs()
            last = self.last.get()[0] if self.last.exists() else None
            ready, later = [], None
            for _, (blob,) in self.buckets.iterator():
                for name, (due, tries, _) in pickle.loads(blob).items():
                    if 0 <= due < now:
                        ready.append((due, name, tries))
                    elif due >= now:
                        later = due if later is None else min(later, due)
            ready.sort()
            gone, of = [], {}
            for due, name, tries in ready:
                at = due if last is None else max(due, last + gap_ms)
                if at >= now:
                    later = at
                    break
                last = at
                gone.append((key[0], name, at, tries))
                of.setdefault(zlib.crc32(name.encode()) % buckets, []).append(name)
            for bucket, names in of.items():
                entries = self._entries(bucket)
                entries.update((name, (-1, *entries[name][1:])) for name in names)
                self.buckets.updateValue((bucket,), (pickle.dumps(entries, protocol=4),))
            self.alarm.clear()
            if gone:
                self.last.update((last,))
            if later is not None:
                self._wake(later)
            if gone:
                yield pd.DataFrame(gone, columns=["data_source", "source_id", "ms", "number_of_tries"])

        def _wake(self, due: int) -> None:
            """One timer a lane, for the first time that an order may go out."""
            at = due + 1
            if self.last.exists():
                at = max(at, self.last.get()[0] + gap_ms + 1)
            if self.alarm.exists():
                old = self.alarm.get()[0]
                if old <= at:
                    return
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
            self.alarm.update((at,))

        def close(self) -> None:
            pass

    orders = rows.groupBy("data_source", "lane").transformWithStateInPandas(Retries(), ORDERS.replace("at timestamp", "ms long"), "append", "eventTime")
    return orders.select("data_source", "source_id", F.timestamp_millis("ms").alias("at"), "number_of_tries")


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams started here keep their state in RocksDB."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, old)


def run_to(orders: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All orders that are ready, as Parquet files; called again, it goes on from there."""
    with state_on_disk(orders.sparkSession):
        orders.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return orders.sparkSession.read.schema(ORDERS).parquet(path)

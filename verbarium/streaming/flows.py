"""Streaming readings of the crawl (survey R01-R07)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from operator import itemgetter
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verbarium.operators import corpus
from verbarium.sources.keyed import KeyedTable


def stream(spark: SparkSession, path: str, per_trigger: int = 10) -> DataFrame:
    """A folder of Parquet files as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def stream_of(table: DataFrame) -> DataFrame:
    """All files of a table that was read from Parquet files, as one stream."""
    files, reader = [f.split("/") for f in table.inputFiles()], table.sparkSession.readStream.schema(table.schema)
    if len(files) == 1:  # other tables may lie beside it
        return reader.option("pathGlobFilter", files[0][-1]).parquet("/".join(files[0][:-1]))
    return reader.parquet("/".join(commonprefix([f[:-1] for f in files])))


def daily_counts(log: DataFrame, at: str = "ts", source: str = "event_type", late: str | None = None) -> DataFrame:
    """Events and words a day and source. Without ``late`` no row is ever too
    late; with it a watermark bounds the state."""
    rows = log.withWatermark(at, late) if late else log
    return rows.groupBy(F.window(at, "1 day").alias("w"), source).agg(F.count("*").alias("n"), F.sum("value").alias("words")).select(F.col("w.start").alias("day"), source, "n", "words")


def run_once(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """All that is there, into a memory table."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return df.sparkSession.table(name)


def upsert_each(df: DataFrame, path: str, keys: list[str], order: str, checkpoint: str):
    """Each batch replaces the rows of its keys. Versions of the table lie side by
    side and are named by their batch, so a batch that runs again writes the same."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        old = spark.read.parquet(f"{path}/{number - 1}") if number else rows.limit(0)
        corpus.upsert(old, rows, keys, order).write.mode("overwrite").parquet(f"{path}/{number}")

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_into(df: DataFrame, table: KeyedTable, name: str, checkpoint: str):
    """Each batch into the buckets that it touches; ``name`` is the stream's own
    among those that write to the table, so a batch that runs again changes nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        table.upsert(rows, (name, number))

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ENTRY = "data_source string, source_id string, outcome string, number_of_tries int"


def entry_states(tries: DataFrame, most: int = 5) -> DataFrame:
    """The outcome and the number of tries of each entry, from a stream of (data_source,
    source_id, ts, outcome). After success or ``most`` tries nothing changes."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        outcome, n = state.get if state.exists else ("pending", 0)
        first: list[tuple] = []  # a batch may come in several frames, in any order; no more than its first tries count
        for frame in frames:
            first = sorted(chain(first, zip(frame["ts"].tolist(), frame["outcome"].tolist(), strict=True)), key=itemgetter(0))[:most]
        for _, new in first:
            if outcome not in ("success", "notfound") and n < most:
                outcome, n = new, n + 1
        state.update((outcome, n))
        yield pd.DataFrame([(*key, outcome, n)], columns=["data_source", "source_id", "outcome", "number_of_tries"])

    return tries.groupBy("data_source", "source_id").applyInPandasWithState(step, ENTRY, "outcome string, n int", "update", GroupStateTimeout.NoTimeout)


def run_states(states: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Of each entry the last of its ``entry_states``, which each batch leaves as files; called
    again, it goes on from there."""
    states.sparkSession.createDataFrame([], states.schema).write.mode("overwrite").parquet(f"{path}/none")

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/{number}")

    states.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = states.sparkSession.read.schema(states.schema).option("recursiveFileLookup", "true").parquet(path)
    last = F.max_by("outcome", "number_of_tries").alias("outcome")
    return rows.groupBy("data_source", "source_id").agg(last, F.max("number_of_tries").alias("number_of_tries"))


def deltas(sizes: DataFrame, at: str = "ts", size: str = "words") -> DataFrame:
    """Growth from one observation to the next."""
    from pyspark.sql import Window

    return sizes.withColumn("delta", F.col(size) - F.coalesce(F.lag(size).over(Window.orderBy(at)), F.lit(0)))

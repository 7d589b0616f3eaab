"""Sinks (survey K01-K14)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.functions import vector as V
from verbarium.operators import corpus, wikitext

TRIPLE = np.dtype([("w", "<i4"), ("c", "<i4"), ("x", "<f8")])


def write_corpus(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by source."""
    docs.write.mode(mode).partitionBy("data_source").parquet(path)


def upsert_corpus(spark, path: str, new: DataFrame, to: str, order: str = "date_scraped") -> None:
    """The old table and new rows, the latest of each id, into another folder."""
    corpus.upsert(spark.read.parquet(path), new, ["_id"], order).write.mode("overwrite").parquet(to)


def write_texts(docs: DataFrame, path: str, per_file: int = 100_000, compression: str = "none") -> None:
    """Contents as text files of bounded size."""
    docs.select(F.col("content").alias("value")).write.option("maxRecordsPerFile", per_file).option("compression", compression).text(path)


def digested(lines: DataFrame) -> DataFrame:
    """One row: the MD5 of all lines in order, joined by line feeds, and their number. The
    digest takes one line after the other, so one task makes it; it gets each different line
    once, with its count, in compressed runs, and holds one run at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([place]), pa.array([sink.getvalue().to_pybytes()])], ["part", "place", "run"])
            place += 1

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, n = hashlib.md5(), 0
        for batch in batches:
            for run in batch.column(2):
                for rows in pa.ipc.open_stream(run.as_buffer()):
                    for line, count in zip(rows.column(0), rows.column(1).to_pylist(), strict=True):
                        line = b"\n" + line.as_py()
                        if not n:
                            made.update(line[1:])
                        rest, n = count - (not n), n + count
                        at_once = max(1, (1 << 20) // len(line))
                        for at in range(0, rest, at_once):
                            made.update(line * min(at_once, rest - at))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([made.hexdigest()]), pa.array([n])], ["lines", "n"])

    each = lines.groupBy(F.col("value").cast("binary").alias("value")).agg(F.count("*").alias("n")).orderBy("value")
    runs = each.mapInArrow(pack, "part long, place long, run binary").repartition(1).sortWithinPartitions("part", "place")
    return runs.mapInArrow(digest, "lines string, n long").agg(F.max("lines").alias("lines"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))


def write_model(model: DataFrame, path: str) -> None:
    """(word, idx, vec) with unit rows, so older models are mended on the way;
    zero rows stay."""
    model.withColumn("vec", V.unit(F.col("vec")).cast("array<float>")).write.mode("overwrite").parquet(path)


CELLS = "data binary"


def write_cells(cells: DataFrame, path: str, rows: int = 100_000) -> None:
    """Co-occurrences (w, c, x) as binary triples: two 32-bit integers and a double,
    little-endian, many to a row, sorted by words (T08)."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = np.empty(len(frame), dtype=TRIPLE)
            out["w"], out["c"], out["x"] = frame["w"], frame["c"], frame["x"]
            yield pd.DataFrame({"data": [out[k : k + rows].tobytes() for k in range(0, len(out), rows)]})

    cells.select("w", "c", "x").orderBy("w", "c").mapInPandas(pack, CELLS).write.mode("overwrite").parquet(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages (id, url, title, text) as elements of pseudo XML files."""
    pages.select(wikitext.wrapped(F.col("id"), F.col("url"), F.col("title"), F.col("text")).alias("value")).write.text(path)


def write_vectors(model: DataFrame, path: str, layout: str = "sum") -> None:
    """Text vectors of (word, vec, context): the sum, the word's alone, or both."""
    vec = {"word": F.col("vec"), "all": F.concat("vec", "context"), "sum": F.zip_with("vec", "context", lambda a, b: a + b)}[layout]
    model.select(F.concat_ws(" ", "word", F.array_join(F.transform(vec, lambda x: F.format_string("%.6f", x.cast("double"))), " ")).alias("value")).write.text(path)


def write_test_set(items: DataFrame, path: str) -> None:
    """The columns' words, spaces between them."""
    items.select(F.concat_ws(" ", *items.columns).alias("value")).write.text(path)


def ensure_table(spark, name: str, schema: str, force: bool = False) -> None:
    """K14."""
    if force:
        spark.sql(f"drop table if exists {name}")
    spark.sql(f"create table if not exists {name} ({schema}) using parquet")

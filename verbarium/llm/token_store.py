"""Token-ID output: Parquet list columns with dictionary or delta encoding.

Documents are dealt out by ranges of their id, sorted, encoded in that order and
written by Spark's own Parquet writer, one file a range. A row keeps its shard and
its offset in the shard next to the ids, so the position of any document in the
whole token sequence comes from two small columns and the totals of the shards;
page indexes (which the writer adds) and small row groups let a reader fetch the
tokens of a few documents, or the metadata alone, without the rest.

Defined results: a null text is encoded as an empty one (the end id alone); null
ids come first; rows with the same id stand together, ordered by the text's
first 64 characters and a hash, over as many shards as they need; an empty table makes an empty store;
columns besides the id and the text are ignored. Ids are whole numbers; others raise
TypeError."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbarium.llm.common import Words, kept, runs_of, whole_numbers, width, unkept, workspace

STORE = "shard int, {id} bigint, start_in_shard bigint, n_tokens bigint, ids array<int>"
#: What a byte may be at a cut: an ASCII letter or digit, one of the stops, visible
#: ASCII, a line feed, a space, the first byte of a character that isn't white space.
_ALNUM, _STOP, _VISIBLE, _FEED, _SPACE, _START = 1, 2, 4, 8, 16, 32


def _kinds() -> bytes:
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[[*range(48, 58), *range(65, 91), *range(97, 123)]] |= _ALNUM
    kinds[[ord(c) for c in ".,;:!?"]] |= _STOP
    kinds[33:127] |= _VISIBLE
    kinds[10] |= _FEED
    kinds[32] |= _SPACE
    starts = np.ones(256, dtype=bool)
    starts[:33] = False
    starts[[0x7F, 0x85, 0xA0, 0xC2, 0xE1, 0xE2, 0xE3]] = False
    kinds[starts] |= _START
    return kinds.tobytes()


_KINDS = _kinds()


class Encoder:
    """Encodes batches of texts with a file of the tokenizers library.

    Byte-level BPE merges within the pieces that its pattern finds. A text may be cut
    where a piece must end: before a U+0020 that a non-space follows, between an ASCII
    letter or digit and one of ``.,;:!?``, and around a single line feed between
    visible ASCII characters. Each distinct piece of a batch is then encoded once, and
    pieces seen before come from a bounded table (by a 64-bit key of bytes and
    length). Other tokenizers get the whole texts."""

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = tool = Tokenizer.from_file(path)
        kind = str(tool.pre_tokenizer)
        self.by_piece = kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind and tool.normalizer is None and tool.post_processor is None
        if self.by_piece:  # in this vocabulary a character stands for a byte
            self.bytes_of = np.zeros(max(tool.get_vocab().values()) + 1, dtype=np.int64)
            for token, i in tool.get_vocab(with_added_tokens=False).items():
                self.bytes_of[i] = len(token)
            for i, added in tool.get_added_tokens_decoder().items():
                self.bytes_of[i] = len(added.content.encode())
        self.most, self.job = most, ""
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.origin, self.sizes = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.pool = np.empty(0, dtype=np.int32)

    def encode(self, column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each row) of runs of rows, in order."""
        if not self.by_piece:
            column = pc.fill_null(column.cast(pa.large_string()), "")
            for at in range(0, len(column), 64):
                got = [x.ids for x in self.tokenizer.encode_batch(column[at : at + 64].to_pylist(), add_special_tokens=False)]
                yield np.array([i for x in got for i in x], dtype=np.int32), np.array([len(x) for x in got], dtype=np.int64)
            return
        for buf, bounds, _ in runs_of(column, limit):
            yield self._run(buf, bounds)

    @staticmethod
    def cuts(raw: bytes, bounds: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(raw) + 1, dtype=np.uint8)
        if len(raw) > 1:
            kind = np.frombuffer(raw.translate(_KINDS), dtype=np.uint8)
            left, right = kind[:-1], kind[1:]
            into = (left // _VISIBLE) & (right // _FEED) & 1  # a line feed after a visible character
            cut[1:-1] = (left & (right // _STOP) & 1) | into
            cut[2:-1] |= into[:-1] & (left[1:] // _FEED) & (right[1:] // _VISIBLE) & 1  # and one after it
            cut[:-2] |= (left // _SPACE) & (right // _START) & 1
        cut[bounds] = 1
        return np.flatnonzero(cut.view(bool))

    def _run(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edges = self.cuts(buf.tobytes(), bounds)
        if len(edges) < 2:
            return np.empty(0, dtype=np.int32), np.zeros(len(bounds) - 1, dtype=np.int64)
        pieces = Words.__new__(Words)
        pieces.buf, pieces.starts, pieces.ends = buf, edges[:-1], edges[1:]
        which, keys = pd.factorize(pieces._hash())
        first = np.empty(len(keys), dtype=np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        order = np.argsort(keys)
        place = np.empty(len(keys), dtype=np.int64)
        place[order] = np.arange(len(keys))
        which, keys, first = place[which], keys[order], first[order]
        if len(self.keys) + len(keys) > self.most:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = (at < len(self.keys)) & (self.keys[np.minimum(at, max(len(self.keys) - 1, 0))] == keys) if len(self.keys) else np.zeros(len(keys), dtype=bool)
        if not known.all():
            new = np.flatnonzero(~known)
            self._learn(buf, pieces.starts[first[new]], pieces.ends[first[new]])
            self.slots = np.insert(self.slots, at[new], np.arange(len(self.sizes) - len(new), len(self.sizes)))
            self.keys = np.insert(self.keys, at[new], keys[new])
            at = np.searchsorted(self.keys, keys)
        slot = self.slots[at][which]
        each = self.sizes[slot]
        ends = np.cumsum(each)
        ids = self.pool[np.repeat(self.origin[slot] - (ends - each), each) + np.arange(ends[-1])]
        totals = np.concatenate(([0], ends))
        return ids, np.diff(totals[np.searchsorted(pieces.starts, bounds)])

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode pieces. Those that begin with a space and a visible ASCII character
        may follow one another in one text; the bytes of its tokens tell them apart."""
        second = buf[np.minimum(starts + 1, len(buf) - 1)]
        chained = (buf[starts] == 32) & (ends - starts > 1) & (second > 32) & (second < 127)
        raw, size = buf.tobytes(), ends - starts
        origin, counts = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        parts, at = [self.pool], len(self.pool)
        of = np.flatnonzero(chained)
        for part in np.array_split(of, len(of) // 2000 + 1) if len(of) else []:
            text = b"".join(raw[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True))
            got = np.array(self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, dtype=np.int32)
            reach, wanted = np.cumsum(self.bytes_of[got]), np.cumsum(size[part])
            stop = np.searchsorted(reach, wanted) + 1
            if stop[-1] > len(reach) or not np.array_equal(reach[stop - 1], wanted):
                chained[part] = False  # bytes that aren't UTF-8 were replaced
                continue
            begin = np.concatenate(([0], stop[:-1]))
            origin[part], counts[part] = at + begin, stop - begin
            parts.append(got)
            at += len(got)
        of = np.flatnonzero(~chained)
        for k in range(0, len(of), 4096):
            part = of[k : k + 4096]
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
            got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts[part] = [len(x) for x in got]
            origin[part] = at + np.cumsum(counts[part]) - counts[part]
            parts.append(np.array([i for x in got for i in x], dtype=np.int32))
            at += len(parts[-1])
        self.origin, self.sizes = np.concatenate((self.origin, origin)), np.concatenate((self.sizes, counts))
        self.pool = np.concatenate(parts)


def encoder(path: str, job: str = "") -> Encoder:
    """The worker's encoder, with the pieces that its earlier tasks of this job have met."""
    out = kept(("encoder", path), lambda: Encoder(path))
    if out.job != job:
        out.job = job
        out._forget()
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, encoding: str = "dictionary", row_group_mb: int = 16, page_kb: int = 128, shards: int | None = None) -> None:
    """Encode ``docs`` and write the token store to ``path``.

    ``tokenizer``: path of a tokenizers file, on every executor. ``encoding``:
    "dictionary", or "delta" (DELTA_BINARY_PACKED), of the ids; the id and offset
    columns are always delta encoded."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    whole_numbers(docs, id_col, "token_store")
    shards = shards or width(docs.select(id_col, text_col), 32)
    job = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at, tool = TaskContext.get().partitionId(), 0, encoder(tokenizer, job)
        for batch in batches:
            row = 0
            for ids, sizes in tool.encode(batch.column(1)):
                n, ends = len(sizes), np.cumsum(sizes)
                with_end = np.insert(ids, ends, end_id).astype(np.int32)
                sizes = sizes + 1
                offsets = np.concatenate(([0], np.cumsum(sizes)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, dtype=np.int32)), batch.column(0).slice(row, n), pa.array(at + offsets[:-1]), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(with_end))],
                    ["shard", id_col, "start_in_shard", "n_tokens", "ids"],
                )
                row, at = row + n, at + int(offsets[-1])

    rows = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    # the rows of one id, or of none, go to as many shards as they need
    keys = {"_head": F.substring("_text", 1, 64), "_hash": F.xxhash64("_text"), "_from": F.spark_partition_id()}
    rows = rows.withColumns(keys).repartitionByRange(shards, id_col, *keys).sortWithinPartitions(id_col, "_head", "_hash", "_text").select(id_col, "_text")
    writer = rows.mapInArrow(run, STORE.format(id=id_col)).write.mode("overwrite")
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_mb << 20,
        "parquet.page.size": page_kb << 10,
        "parquet.page.row.count.limit": 2000,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
        "parquet.enable.dictionary#shard": "true",
    }
    writer.options(**options).parquet(path)


def read_metadata(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens and start (ids of all documents before it): the ids' column
    isn't read."""
    store = spark.read.schema(STORE.format(id=id_col)).parquet(path)
    return _with_start(spark, path, store.select("shard", id_col, "start_in_shard", "n_tokens"), id_col)


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None, id_col: str = "doc_id") -> DataFrame:
    """id and ids of the documents named, or of all; the filter on the sorted id
    column skips files, row groups and pages."""
    store = spark.read.schema(STORE.format(id=id_col)).parquet(path)
    return (store.where(F.col(id_col).isin(ids)) if ids is not None else store).select(id_col, "ids")


def read_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and the unsigned CRC-32 of the ids as little-endian
    32-bit integers, all from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unkept()  # the writers' pieces
        for batch in batches:
            ids = batch.column(4)
            bounds = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64())], ["shard", id_col, "start_in_shard", "n_tokens", "ids_crc32"])

    store = spark.read.schema(STORE.format(id=id_col)).parquet(path)
    schema = f"shard int, {id_col} bigint, start_in_shard bigint, n_tokens bigint, ids_crc32 bigint"
    return _with_start(spark, path, store.mapInArrow(run, schema), id_col)


def _with_start(spark: SparkSession, path: str, rows: DataFrame, id_col: str) -> DataFrame:
    # one row a shard: their number is bounded by the partitions of the write
    totals = spark.read.schema(STORE.format(id=id_col)).parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = totals.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_before"))
    out = rows.join(before, "shard").withColumn("start", F.col("_before") + F.col("start_in_shard"))
    return out.select(id_col, "start", "n_tokens", *[c for c in rows.columns if c == "ids_crc32"])


def token_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write a token store into the shared folder and return read_digests of it."""
    path = workspace(docs.sparkSession)
    write_tokens(docs, path, tokenizer, id_col, text_col, **options)
    return read_digests(docs.sparkSession, path, id_col)

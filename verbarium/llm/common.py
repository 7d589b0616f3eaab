"""What the training-data operators share: a shared workspace, word hashing over
Arrow buffers, packed shuffles and distributed connected components."""

from __future__ import annotations

import hashlib
import math
import pickle
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from verbarium.session import shuffles_released, small_batches

#: The white space that separates words: U+0020 and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- workspace


def workspace(spark: SparkSession) -> str:
    """A new folder path that driver and executors share.

    It lies under ``spark.checkpoint.dir``; where that is unset and all runs in one
    process (tests, local runs) a local temporary folder becomes the checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="verbarium-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/verbarium/{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it again, which
    cuts the lineage and survives lost executors; the files of its shuffles go, and
    Python gets bounded batches."""
    spark = df.sparkSession
    path = path or workspace(spark)
    with shuffles_released(spark), small_batches(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def shared(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object of any class: its classes travel by value, as functions do, so
    executors need no copy of the package. ``opened`` reads it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(held: Broadcast) -> object:
    """What ``shared`` has sent; each call makes a new copy."""
    return pickle.loads(held.value)


def whole_numbers(df: DataFrame, id_col: str, operator: str) -> None:
    """Raise where an operator's ids must be whole numbers and aren't."""
    kind = dict(df.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{operator}: {id_col} must hold whole numbers, not {kind}; number the rows first")


def buffered(batches: Iterator[pa.RecordBatch], most: int = 32 << 20) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def kept(key: object, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps for its later tasks. Functions travel by
    value, so each task has globals of its own; a module of the worker's outlives them."""
    shelf = sys.modules.setdefault("_verbarium_worker", types.ModuleType("_verbarium_worker")).__dict__.setdefault("shelf", {})
    if key not in shelf:
        shelf[key] = make()
    return shelf[key]


def unkept() -> None:
    """Let go of what ``kept`` holds in this worker, before work that doesn't need it."""
    shelf = sys.modules.get("_verbarium_worker")
    if shelf is not None:
        shelf.__dict__["shelf"].clear()


def width(df: DataFrame, target_mb: int = 32) -> int:
    """How many partitions to deal a table out to: the session's setting, or more
    where the optimizer's estimate of the table's size asks for it."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    asked = math.ceil(size / (target_mb << 20)) if size < 1 << 50 else 0  # a plan of unknown size says more
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(asked, 200_000))


# ------------------------------------------------------------- word hashing

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_KEYS = np.frombuffer(hashlib.shake_128(b"verbarium bytes").digest(2048), dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPAN = 1 << 18
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n."""
    size = 1 << max(10, (max(n, 1) - 1).bit_length())
    if (base, size) not in _powers:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        _powers[base, size] = np.multiply.accumulate(out)
    return _powers[base, size][:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(buf: np.ndarray) -> np.ndarray:
    """UTF-8 with A-Z in lower case."""
    return _LOWER[buf]


def span_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of the bytes of each span; spans ascend and don't overlap."""
    n = len(starts)
    out = np.empty(n, dtype=np.uint64)
    back = inverse(_BASE)
    at = 0
    while at < n:
        origin = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, origin + _SPAN, side="right")))
        length = int(ends[to - 1] - origin)
        if length > _SPAN:  # one word longer than the span
            digest = hashlib.blake2b(buf[origin : ends[at]].tobytes(), digest_size=8).digest()
            out[at] = np.frombuffer(digest, dtype=np.uint64)[0]
        else:
            sums = np.zeros(length + 1, dtype=np.uint64)
            np.cumsum(_BYTE_KEYS[buf[origin : origin + length]] * powers(_BASE, length), out=sums[1:])
            a, b = starts[at:to] - origin, ends[at:to] - origin
            out[at:to] = (sums[b] - sums[a]) * powers(back, length)[a]
        at = to
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of a run of rows: byte spans, 64-bit keys and, for row i, the
    words ``first[i]:first[i + 1]``."""

    __slots__ = ("buf", "ends", "first", "keys", "rows", "starts")

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, rows: range, keyed: bool = True, table: np.ndarray | None = None):
        word = (_IS_WORD if table is None else table)[buf]
        begin, stop = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        stop[:-1] &= ~word[1:]
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < len(buf))]
        begin[inner] = word[inner]
        stop[inner - 1] = word[inner - 1]
        self.buf, self.rows = buf, rows
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.keys = self._hash() if keyed else None

    def _hash(self) -> np.ndarray:
        return span_keys(self.buf, self.starts, self.ends)

    def text(self, word: int) -> bytes:
        return self.buf[self.starts[word] : self.ends[word]].tobytes()

    def row_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))


def spaced(buf: np.ndarray) -> np.ndarray:
    """UTF-8 with spaces in place of U+00A0 to U+00BF but letters (as the no-break space),
    U+2000 to U+206F (as curly quotes and dashes) and U+3000 to U+303F."""
    at = np.flatnonzero((buf[:-1] == 0xC2) | (buf[:-1] == 0xE2) | (buf[:-1] == 0xE3))
    if not len(at):
        return buf
    lead, second, third = buf[at], buf[at + 1], buf[np.minimum(at + 2, len(buf) - 1)]
    two = at[(lead == 0xC2) & (second >= 0xA0) & ~np.isin(second, (0xAA, 0xB5, 0xBA))]
    three = at[((lead == 0xE2) & ((second == 0x80) | ((second == 0x81) & (third < 0xB0)))) | ((lead == 0xE3) & (second == 0x80))]
    out = buf.copy()
    for place in (two, two + 1, three, three + 1, three + 2):
        out[place[place < len(out)]] = 0x20
    return out


def words_of(column: pa.Array, lower: bool = False, keyed: bool = True, limit: int = 1 << 21, table: np.ndarray | None = None) -> Iterator[Words]:
    """The words of a string column, in runs of whole rows of about ``limit`` bytes.
    A null counts as an empty text; ``lower`` folds A-Z only; ``table`` says which
    bytes make words. With a table of one's own, punctuation beyond ASCII parts words."""
    buf_of = (lambda x: _LOWER[x]) if lower else (lambda x: x)
    if table is not None:
        fold, buf_of = buf_of, lambda x: fold(spaced(x))
    for buf, bounds, rows in runs_of(column, limit):
        yield Words(buf_of(buf), bounds, rows, keyed, table)


def runs_of(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, range]]:
    """The UTF-8 bytes of a string column in runs of whole rows of about ``limit``
    bytes: (bytes, bounds of the rows in them, row numbers)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        yield data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], range(at, to)
        at = to


def rolling(keys: np.ndarray, n: int, base: int) -> np.ndarray:
    """A 64-bit key of each ``n`` consecutive keys."""
    if len(keys) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(keys) - n + 1, dtype=np.uint64)
    for j in range(n):  # Horner's rule
        out = out * np.uint64(base) + keys[j : len(keys) - n + 1 + j]
    return mix(out)


# ---------------------------------------------------------- packed shuffles

PACKED = "pid int, blob binary"


def deal(owner: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Split records by ``owner`` (a partition number each) into one blob for
    each partition. A blob holds the columns one after the other, so that a
    shuffle moves a few large rows in place of very many small ones."""
    order = np.argsort(owner, kind="stable")
    owner, columns = owner[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.empty(0, dtype=np.int64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(owner)], strict=False):
        yield int(owner[a]), b"".join(np.ascontiguousarray(c[a:b]).tobytes() for c in columns)


def undeal(blobs: list[bytes], *dtypes: str) -> list[np.ndarray]:
    """The columns that the blobs of one partition hold."""
    each = sum(np.dtype(t).itemsize for t in dtypes)
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    for blob in blobs:
        n, at = len(blob) // each, 0
        for column, t in zip(parts, dtypes, strict=True):
            column.append(np.frombuffer(blob, dtype=t, count=n, offset=at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(c) if c else np.empty(0, dtype=t) for c, t in zip(parts, dtypes, strict=True)]


def packed_batches(rows: Iterator[tuple[int, bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (pid, blob) rows, a few MB each."""
    pids: list[int] = []
    blobs: list[bytes] = []
    size = 0
    for pid, blob in rows:
        pids.append(pid)
        blobs.append(blob)
        size += len(blob)
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), pa.array(blobs, pa.binary())], ["pid", "blob"])
            pids, blobs, size = [], [], 0
    if pids:
        yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), pa.array(blobs, pa.binary())], ["pid", "blob"])


def per_partition(packed: DataFrame, parts: int, work: Callable, schema: str) -> DataFrame:
    """Bring the blobs of each packed partition together and apply
    ``work(blobs) -> iterator of Arrow batches`` to them. One packed partition is
    held at a time; its size is bounded by the number of partitions dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        current = None
        for batch in batches:
            for pid, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if pid != current and held:
                    yield from work(held)
                    held = []
                current = pid
                held.append(blob.as_py())
        if held:
            yield from work(held)

    return packed.repartition(parts, "pid").sortWithinPartitions("pid").mapInArrow(run, schema)


# ----------------------------------------------------- connected components


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an edge list, as (node, component): the smallest
    node of each component. Only nodes with an edge to another node come out.

    Large-star and small-star steps alternate until nothing moves. Each step is
    one aggregation (with map-side combining, so a hub's neighbours don't meet in
    one task) and one join that AQE can split; each round is written to the shared
    folder, which bounds the lineage."""
    spark = edges.sparkSession
    pairs = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    )
    state, path = materialize(pairs)
    before = None
    for _ in range(rounds):
        both = state.select("u", "v").unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        small = small.where("u <> v").distinct()
        seen = Observation()
        new, new_path = materialize(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
        mark = (seen.get["n"], seen.get["sum"])
        drop(spark, path)
        state, path = new, new_path
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = state.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

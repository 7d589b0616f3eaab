"""Centroid clustering by sort-means, exact in whole numbers.

Components become floor(scale * x). Each round orders, for every centroid, the others by
their distance from it. A vector starts from the centroid that it was assigned to before,
goes through that one's list, and stops where a centroid is strictly farther from it than
twice the vector's own distance: by the triangle inequality no later one can be nearer or
as near. Vectors of one earlier centroid are scanned together, so that a step of the list
is one array operation on those that haven't stopped. Assignments are written between
rounds; sums and counts of a task are one row a centroid, summed by Spark. Only centroids
(k rows) pass the driver.

Numbers are 64-bit where that is exact; vectors with a component of 2**27 or more are
reckoned with Python's integers, and distances beyond a long come out as the largest long.

Defined results: vectors of another length, null, or with null or non-finite components
don't take part; rows without an id do, but don't start a centroid; repeated rows are
vectors of their own; ties of the starting hash (rows of one id) go by components, those
with small ones first; with
fewer than k vectors (with ids) there are fewer centroids; without any, or with an empty
table, the result is empty; zero vectors count as any other; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import materialize

_SAFE = 1 << 27
_LONGEST = (1 << 63) - 1
_HALF = 1 << 31
#: Bits of a digit of the sums.
_LIMB = 60
#: ``v``: 32-bit numbers, written so that bytes sort as numbers do; where ``wide`` text,
#: as numbers of any size need.
ROWS = "id bigint, v binary, wide boolean, cluster int, distance bigint"


def whole(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, as Python integers."""
    return np.array([[int(n * scale // d) for n, d in (x.as_integer_ratio() for x in row)] for row in flat.tolist()], dtype=object).reshape(flat.shape)


def _vectors(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of a batch of ROWS: the small ones together as int64, then the
    wide ones as Python integers."""
    wide = batch.column(2).to_numpy(zero_copy_only=False)
    blobs = batch.column(1).to_pylist()
    yield np.flatnonzero(~wide), np.frombuffer(b"".join(b for b, w in zip(blobs, wide, strict=True) if not w), dtype=">u4").reshape(-1, dim).astype(np.int64) - _HALF
    if wide.any():
        yield np.flatnonzero(wide), np.array([[int(x) for x in b.split(b",")] for b, w in zip(blobs, wide, strict=True) if w], dtype=object)


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, in the numbers that the operands are made of."""
    d = a - b
    return (d * d).sum(axis=-1)


def neighbours(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others by distance, and those squared distances."""
    far = np.array([between(centres, c) for c in centres]).reshape(len(centres), -1)
    order = np.array([np.argsort(row, kind="stable") for row in far]).reshape(far.shape)
    lists = np.array([[c for c in row if c != own] for own, row in enumerate(order.tolist())], dtype=np.int64).reshape(len(centres), -1)
    return lists, np.take_along_axis(far, lists, axis=1) if lists.size else far[:, :0]


def assign(x: np.ndarray, before: np.ndarray, centres: np.ndarray, lists: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (ties: the smaller number) and its squared
    distance, by the scan from ``before``."""
    cluster = before.copy()
    own = between(x, centres[before]) if len(x) else np.empty(0, dtype=x.dtype)
    best = own.copy()
    for c in np.unique(before).tolist():
        active = np.flatnonzero(before == c)
        for other, gap in zip(lists[c].tolist(), gaps[c].tolist(), strict=True):
            active = active[4 * own[active] >= gap]  # distances are squared
            if not len(active):
                break
            d = between(x[active], centres[other])
            nearer = (d < best[active]) | ((d == best[active]) & (other < cluster[active]))
            at = active[nearer]
            best[at], cluster[at] = d[nearer], other
    return cluster, best


def _numbers(rows: list[list[int]]) -> np.ndarray:
    """Centroids as int64 where small."""
    small = all(-_SAFE < x < _SAFE for row in rows for x in row)
    return np.array(rows, dtype=np.int64 if small else object)


def prepared(table: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """ROWS of the vectors that take part, all with centroid 0."""
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.size("v") == dim).where("not exists(v, x -> x is null)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            good = np.isfinite(flat).all(axis=1)
            flat, ids = flat[good], batch.column(0).filter(pa.array(good))
            wide = np.abs(flat).max(axis=1, initial=0) >= _SAFE / scale
            blobs: list[bytes] = [b""] * len(flat)
            for place, row in zip(np.flatnonzero(~wide), (np.floor(flat[~wide] * scale).astype(np.int64) + _HALF).astype(">u4"), strict=True):
                blobs[place] = row.tobytes()
            for place, row in zip(np.flatnonzero(wide), whole(flat[wide], scale).tolist(), strict=True):
                blobs[place] = ",".join(map(str, row)).encode()
            n = len(flat)
            yield pa.RecordBatch.from_arrays([ids, pa.array(blobs, pa.binary()), pa.array(wide), pa.array(np.zeros(n, dtype=np.int32)), pa.array(np.zeros(n, dtype=np.int64))], ["id", "v", "wide", "cluster", "distance"])

    return rows.mapInArrow(run, ROWS)


def _start(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``seed:id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    picked = rows.where("id is not null").orderBy(key, "wide", "v").limit(k).select(key.alias("key"), "v", "wide").toArrow()
    out = []
    for key, v, wide in sorted(zip(*[c.to_pylist() for c in picked.columns], strict=True), key=lambda r: (r[0], r[2], r[1])):
        out.append([int(x) for x in v.split(b",")] if wide else (np.frombuffer(v, dtype=">u4").astype(np.int64) - _HALF).tolist())
    return out


def _step(rows: DataFrame, centres: list[list[int]], dim: int) -> DataFrame:
    """ROWS with their nearest centroids."""
    own = _numbers(centres)
    tools = rows.sparkSession.sparkContext.broadcast((own, *neighbours(own)))  # k rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, lists, gaps = tools.value
        for batch in batches:
            before = batch.column(3).to_numpy().astype(np.int64)
            cluster, distance = np.zeros(len(before), dtype=np.int32), np.zeros(len(before), dtype=np.int64)
            for at, x in _vectors(batch, dim):
                cluster[at], found = assign(x, before[at], centres, lists, gaps)
                distance[at] = found if found.dtype != object else [min(d, _LONGEST) for d in found.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cluster), pa.array(distance)], ["id", "v", "wide", "cluster", "distance"])

    return rows.mapInArrow(run, ROWS)


def _limbs(total: int) -> list[tuple[int, int]]:
    """A number as (power, signed digit) to the base 2**_LIMB; the lowest is always there."""
    out, sign, rest = [], -1 if total < 0 else 1, abs(total)
    while rest or not out:
        out.append((len(out), sign * (rest & ((1 << _LIMB) - 1))))
        rest >>= _LIMB
    return out


def _moved(rows: DataFrame, centres: list[list[int]], dim: int) -> list[list[int]]:
    """Each centroid replaced by floor(sum / count) of its vectors; empty ones stay."""
    k = len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), dtype=object), np.zeros(k, dtype=np.int64)
        for batch in batches:
            cluster = batch.column(3).to_numpy()
            counts += np.bincount(cluster, minlength=k)
            for at, x in _vectors(batch, dim):
                for c in np.unique(cluster[at]).tolist():
                    sums[c] += x[cluster[at] == c].sum(axis=0).astype(object)
        found = [(c, int(counts[c]), place, power, limb) for c in np.flatnonzero(counts).tolist() for place, total in enumerate(sums[c]) for power, limb in _limbs(int(total))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else [()] * 5, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "count", "place", "power", "limb"])

    parts = rows.mapInArrow(run, "cluster int, count bigint, place int, power int, limb bigint")
    totals, counts = {}, {}
    for r in parts.groupBy("cluster", "place", "power").agg(F.sum(F.col("limb").cast("decimal(38, 0)")).alias("sum"), F.sum("count").alias("count")).toLocalIterator():  # k * dim rows, more for wide numbers
        at = r["cluster"], r["place"]
        totals[at] = totals.get(at, 0) + (int(r["sum"]) << (_LIMB * r["power"]))
        if r["power"] == 0:
            counts[at] = r["count"]
    out = [list(c) for c in centres]
    for (c, place), total in totals.items():
        out[c][place] = total // counts[c, place]
    return out


def clusters(table: DataFrame, k: int = 16, rounds: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """``id_col``, cluster, distance (squared), cluster_inertia and inertia (its sums),
    centroid_sha256 of every vector that takes part."""
    spark = table.sparkSession
    result = f"{id_col} bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    rows, _ = materialize(prepared(table, id_col, vec_col, dim, scale))
    centres = _start(rows, k, seed)
    if not centres:
        return spark.createDataFrame([], result)
    for _ in range(rounds):
        rows, _ = materialize(_step(rows, centres, dim))
        centres = _moved(rows, centres, dim)
    rows, _ = materialize(_step(rows, centres, dim))
    sums = {r["cluster"]: int(r["sum"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("sum")).collect()}  # k rows
    names = {c: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for c, v in enumerate(centres)}
    own = spark.createDataFrame([(c, min(s, _LONGEST), min(sum(sums.values()), _LONGEST), names[c]) for c, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(own), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

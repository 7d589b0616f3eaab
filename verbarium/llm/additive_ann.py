"""Approximate nearest neighbours: additive quantisation.

A vector is coded as the sum of one codeword from each of several full-dimensional
codebooks. The codebooks start as k-means of successive residuals and are refitted
together by least squares, on a bounded sample. Encoding is a beam search over the
codebooks. A query's table of inner products with all codewords scores any code by a
few look-ups (for Euclidean distance the stored norms of the sums are added); the best
candidates of each query in each block of codes are then ranked by the exact measure
on the original vectors, and so are all others whose score and slack reach the last of
these: the slack is a row's own coding error times what the sample's neighbours show, or
all of the error where the row is coded worse than most (as rows of a kind that the sample
lacks, or of very many components).

Codes lie in coarse cells (k-means of the sample), and a query asks the cells nearest
to it. How many is measured: as many as hold RECALL of the sample's own neighbours, so
clustered tables ask few and tables without clusters many. A cell is dealt out in blocks
of at most BLOCK rows by a hash of the id, and its queries in groups, so neither a large
cell nor a vector that very many rows have makes a large task. A row travels once for
each group of queries, codes and original vector together: reranking needs no look-up.

What is coded, in single precision, is a vector's direction; its length stays beside the
code in double precision, so one very long vector costs the others nothing. Rows longer
than all of the sample lie in a cell of their own, which every query asks. The ranking uses
the original vectors in double precision.

Defined results: vectors that are null, of another length than the most frequent
one, zero, or with null or non-finite components take no part, nor do null ids; equal
rows count once; ties go to the smaller id; a query has fewer neighbours if there are
fewer candidates; an empty table gives an empty result; other columns are ignored. Ids are whole numbers; others raise TypeError.
``Settings(exact=True)`` ranks every row exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import PACKED, deal, materialize, mix, opened, packed_batches, per_partition, shared, undeal, whole_numbers

#: Rows of a block, queries of a group, and rows that a cell should have at least.
BLOCK, GROUP, CELL = 1 << 16, 4096, 4096


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the rows that the codebooks and cells are fitted to: those with
    the smallest hash of their id. ``rerank``: candidates of a query in each block that
    are ranked exactly at least; they grow with the table, so recall doesn't fall with it.
    ``recall``: the share of the sample's neighbours that the cells asked must hold."""

    books: int = 32
    words: int = 64
    beam: int = 4
    sample: int = 10_000
    rounds: int = 1
    rerank: int = 400
    recall: float = 0.99
    exact: bool = False
    seed: int = 3


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        near = (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        filled = count > 0
        centres[filled] = sums[filled] / count[filled, None]
        centres[~filled] = x[rng.choice(len(x), (~filled).sum())]
    return centres


def _closeness(dots: np.ndarray, norms: np.ndarray, length: np.ndarray, size: float) -> np.ndarray:
    """What grows as the squared distance falls: of a query of length ``size`` from rows
    of these lengths, by the inner products of directions. Lengths are divided by the
    longest, lest squares overflow."""
    longest = max(length.max(), size)
    own = length / longest
    return 2 * own * (size / longest) * dots - own**2 * norms


class Quantiser:
    """``books``: codebooks x words x dimension."""

    def __init__(self, books: np.ndarray, beam: int):
        self.books, self.beam = books.astype(np.float32), beam
        self._ready = None

    def _tables(self):
        if self._ready is None:
            flat = self.books.reshape(-1, self.books.shape[2])
            self._ready = flat, flat @ flat.T, (flat**2).sum(axis=1)
        return self._ready

    def encode(self, x: np.ndarray, step: int = 512) -> np.ndarray:
        out = [self._encode(x[i : i + step]) for i in range(0, len(x), step)]
        return np.concatenate(out) if out else np.empty((0, len(self.books)), dtype=np.uint8)

    def _encode(self, x: np.ndarray) -> np.ndarray:
        """Beam search: the error of a partial sum s plus word c is known up to a
        constant from |c|^2 - 2 x.c + 2 s.c."""
        m, k, _ = self.books.shape
        flat, cross, norms = self._tables()
        dots = x @ flat.T
        n = len(x)
        codes, error = np.zeros((n, 1, m), dtype=np.int64), np.zeros((n, 1), dtype=np.float32)
        for b in range(m):
            own = slice(b * k, (b + 1) * k)
            cost = error[:, :, None] + (norms[own] - 2 * dots[:, own])[:, None, :]
            for a in range(b):
                cost += 2 * cross[own][:, codes[:, :, a] + a * k].transpose(1, 2, 0)
            wide = min(self.beam, cost.shape[1] * k)
            cost = cost.reshape(n, -1)
            best = np.argpartition(cost, wide - 1, axis=1)[:, :wide] if wide < cost.shape[1] else np.tile(np.arange(cost.shape[1]), (n, 1))
            error = np.take_along_axis(cost, best, axis=1)
            codes = np.take_along_axis(codes, (best // k)[:, :, None], axis=1)
            codes[:, :, b] = best % k
        return np.take_along_axis(codes, error.argmin(axis=1)[:, None, None], axis=1)[:, 0].astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[b][codes[:, b]] for b in range(len(self.books)))


def train(x: np.ndarray, settings: Settings) -> Quantiser:
    rng = np.random.default_rng(settings.seed)
    m, k = settings.books, min(settings.words, 256)
    rest, books = x.copy(), []
    for _ in range(m):
        books.append(_kmeans(rest, k, rng))
        rest -= books[-1][(rest @ books[-1].T - 0.5 * (books[-1] ** 2).sum(axis=1)).argmax(axis=1)]
    out = Quantiser(np.stack(books), settings.beam)
    for _ in range(settings.rounds):  # all codewords at once, by ridge regression on the codes
        used = out.encode(x).astype(np.int64) + np.arange(m) * k
        gram, right = np.zeros((m * k, m * k), dtype=np.float32), np.zeros((m * k, x.shape[1]), dtype=np.float32)
        for a in range(m):
            np.add.at(right, used[:, a], x)
            for b in range(m):
                np.add.at(gram, (used[:, a], used[:, b]), 1)
        gram[np.diag_indices(m * k)] += 0.1
        out = Quantiser(np.linalg.solve(gram, right).reshape(m, k, -1), settings.beam)
    return out


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n highest scores, ties to the first positions."""
    if len(scores) <= n:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - n)[len(scores) - n]
    above = np.flatnonzero(scores > edge)
    return np.concatenate((above, np.flatnonzero(scores == edge)[: n - len(above)]))


def directions(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(directions in single precision, lengths) of nonzero vectors of any length."""
    peak = np.abs(exact).max(axis=1, initial=0)
    scaled = exact / peak[:, None]
    size = np.sqrt((scaled**2).sum(axis=1))
    with np.errstate(over="ignore"):
        length = np.minimum(peak * size, np.finfo(np.float64).max)
    return (scaled / size[:, None]).astype(np.float32), length


class Cells:
    """Coarse cells of directions, by number from 0, and how many of them a query asks. The
    last number is the cell of rows longer than ``longest``, which every query asks."""

    def __init__(self, centres: np.ndarray, longest: float, asked: int):
        self.centres, self.longest, self.asked = centres, longest, asked
        self.half = 0.5 * (centres**2).sum(axis=1)

    def count(self) -> int:
        return len(self.centres) + 1

    def of(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.where(length > self.longest, len(self.centres), (x @ self.centres.T - self.half).argmax(axis=1))

    def order(self, x: np.ndarray) -> np.ndarray:
        """Cells of directions by promise, for each query; its own comes first."""
        near = x @ self.centres.T
        near[np.arange(len(x)), (near - self.half).argmax(axis=1)] = np.inf
        return np.argsort(-near, axis=1, kind="stable")

    def asks(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((self.order(x)[:, : self.asked], np.full((len(x), 1), len(self.centres))), axis=1)


def fit_cells(x: np.ndarray, length: np.ndarray, count: int, metric: str, n: int, settings: Settings) -> Cells:
    """Cells for ``count`` rows; ``x`` and ``length`` are the sample's directions and
    lengths. The neighbours of a row in the sample are farther than those in the table, so
    the measured number is on the safe side."""
    cells = max(1, min(math.ceil(count / CELL), len(x) // 32))
    out = Cells(_kmeans(x, cells, np.random.default_rng(settings.seed)), float(length.max()), cells)
    if cells == 1 or settings.exact:
        return out
    asking, part = x[:256], length / length.max()
    near = asking.astype(np.float64) @ x.T.astype(np.float64)
    near = near * part if metric == "ip" else 2 * near * part * part[:256, None] - part**2
    near[np.arange(len(asking)), np.arange(len(asking))] = -np.inf
    best = np.argsort(-near, axis=1)[:, :n]
    place = np.argsort(out.order(asking), axis=1)
    needed = np.sort(np.take_along_axis(place, out.of(x, length)[best], axis=1).ravel())
    out.asked = int(needed[min(len(needed) - 1, math.ceil(len(needed) * settings.recall) - 1)]) + 1
    return out


def fit_slack(tool: Quantiser, x: np.ndarray, length: np.ndarray, metric: str, n: int) -> tuple[float, float]:
    """(share of a row's coding error that the inner products of neighbours miss, the error
    beyond which all of it counts), of the sample's directions."""
    rest = x - tool.decode(tool.encode(x))
    error = np.sqrt((rest**2).sum(axis=1))
    asking, part = x[:256], length / length.max()
    near = asking @ x.T
    near = near * part if metric == "ip" else 2 * near * part * part[: len(asking), None] - part**2
    near[np.arange(len(asking)), np.arange(len(asking))] = -np.inf
    best = np.argsort(-near, axis=1)[:, :n]
    missed = (rest[best] * asking[:, None]).sum(axis=2) / np.maximum(error[best], 1e-9)
    own = (rest * x).sum(axis=1) / np.maximum(error, 1e-9)
    return float(min(1.0, max(np.quantile(missed, 0.999), np.quantile(own, 0.999), 0.0))), float(1.5 * np.median(error))


def _exactly(exact: np.ndarray, at: np.ndarray, v: np.ndarray, metric: str, step: int = 4096) -> np.ndarray:
    """The measure of the rows ``at``, a few at a time."""
    parts = (exact[at[i : i + step]] for i in range(0, len(at), step))
    return np.concatenate([np.empty(0), *((part * v).sum(axis=1) if metric == "ip" else ((part - v) ** 2).sum(axis=1) for part in parts)])


def valid(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vector as float64 bytes) of the rows that take part, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
            flat = flat[good]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array([v.tobytes() for v in flat], pa.binary())], ["id", "vec"])

    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null and not exists(v, x -> x is null)")
    sizes = rows.groupBy(F.size("v").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0)).mapInArrow(run, "id bigint, vec binary").distinct()


def _spread(ids: np.ndarray, salt: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) + np.uint64(salt)) >> np.uint64(33)).astype(np.int64)


def nearest(table: DataFrame, is_query: Column, n: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "ip", settings: Settings = Settings()) -> DataFrame:
    """query_id, rank (from 1), ``id_col`` and score of each query's n nearest found.
    ``is_query``: a condition on the id. ``metric``: "ip" (largest inner product) or
    "l2" (smallest squared distance)."""
    if metric not in ("ip", "l2"):
        raise ValueError("metric is ip or l2")
    whole_numbers(table, id_col, "additive_ann")
    spark = table.sparkSession
    rows, _ = materialize(valid(table, id_col, vec_col))
    result = f"query_id bigint, rank int, {id_col} bigint, score double"
    count = rows.count()
    if not count:
        return spark.createDataFrame([], result)
    sample = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(settings.sample).select("vec").toArrow()
    known, length = directions(np.frombuffer(b"".join(sample.column("vec").to_pylist()), dtype=np.float64).reshape(sample.num_rows, -1))
    del sample
    dim = known.shape[1]
    tool = train(known, settings)
    tools = shared(spark, (tool.books, fit_cells(known, length, count, metric, n, settings)))  # bounded by the settings
    share, worst = fit_slack(tool, known, length, metric, n)
    rows = rows.select("id", "vec").withColumnRenamed("id", id_col).withColumn("_asks", F.coalesce(is_query, F.lit(False))).withColumnRenamed(id_col, "id")

    def vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        exact = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float64).reshape(batch.num_rows, dim)
        return batch.column(0).to_numpy(), exact, *directions(exact), batch.column(2).to_numpy(zero_copy_only=False)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = opened(tools)[1]
        have, asked = np.zeros(cells.count(), dtype=np.int64), np.zeros(cells.count(), dtype=np.int64)
        for batch in batches:
            _, _, x, length, asks = vectors(batch)
            have += np.bincount(cells.of(x, length), minlength=len(have))
            asked += np.bincount(cells.asks(x[asks]).ravel(), minlength=len(have))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(have))), pa.array(have), pa.array(asked)], ["cell", "have", "asked"])

    sums = rows.mapInArrow(counted, "cell bigint, have bigint, asked bigint").groupBy("cell").agg(F.sum("have"), F.sum("asked")).orderBy("cell").collect()
    blocks = np.maximum(1, -(-np.array([r[1] for r in sums]) // BLOCK))
    groups = np.maximum(1, -(-np.array([r[2] for r in sums]) // GROUP))
    base = np.concatenate(([0], np.cumsum(blocks * groups)))  # of a cell's tasks: block * groups + group
    tasks = int(base[-1])
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, tasks))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        books, cells = opened(tools)
        tool = Quantiser(books, settings.beam)
        for batch in batches:
            ids, exact, x, length, asks = vectors(batch)
            codes, cell = tool.encode(x), cells.of(x, length)
            coded = tool.decode(codes)
            norms, error = (coded**2).sum(axis=1, dtype=np.float32), np.sqrt(((x - coded) ** 2).sum(axis=1, dtype=np.float32))
            slack = (np.where(error > worst, error, share * error) * 1.0001 + 1e-6).astype(np.float32)
            wide = np.ascontiguousarray(exact).view(f"V{8 * dim}").ravel()
            block = base[cell] + _spread(ids, 1) % blocks[cell] * groups[cell]
            most = groups[cell]
            for g in range(int(most.max(initial=0))):
                on = most > g
                for task, blob in deal(block[on] + g, ids[on], np.ascontiguousarray(codes[on]).view(f"V{codes.shape[1]}").ravel(), norms[on], slack[on], length[on], wide[on]):
                    yield task, b"C" + blob
            at = np.flatnonzero(asks)
            for k in range(0, len(at), 64):
                who = at[k : k + 64]
                asked = cells.asks(x[who])
                own, asked = np.repeat(who, asked.shape[1]), asked.ravel()
                first = base[asked] + _spread(ids[own], 2) % groups[asked]
                for b in range(int(blocks[asked].max())):
                    on = blocks[asked] > b
                    for task, blob in deal(first[on] + b * groups[asked[on]], ids[own[on]], wide[own[on]]):
                        yield task, b"Q" + blob

    def scan(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        books = opened(tools)[0]
        ids, codes, norms, slack, length, wide = undeal([memoryview(b)[1:] for b in blobs if b[:1] == b"C"], "i8", f"V{len(books)}", "f4", "f4", "f8", f"V{8 * dim}")
        asking, asked = undeal([memoryview(b)[1:] for b in blobs if b[:1] == b"Q"], "i8", f"V{8 * dim}")
        if not len(ids) or not len(asking):
            return
        order = np.argsort(ids, kind="stable")
        ids, norms, slack, length, exact = ids[order], norms[order], slack[order], length[order], wide[order].view(np.float64).reshape(len(ids), dim)
        codes = np.ascontiguousarray(codes[order].view(np.uint8).reshape(len(ids), -1).T)
        asked = asked.view(np.float64).reshape(len(asking), dim)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for q, v in zip(asking.tolist(), asked, strict=True):
            if settings.exact:
                best = np.arange(len(ids))
            else:
                toward, size = directions(v[None])
                look_up = books @ toward[0]
                dots = look_up[0][codes[0]]
                for b in range(1, len(codes)):
                    dots += look_up[b][codes[b]]
                longest = max(length.max(), size[0])
                own = length / longest
                scores = dots * own if metric == "ip" else _closeness(dots, norms, length, size[0])
                same = slice(np.searchsorted(ids, q), np.searchsorted(ids, q, side="right"))
                scores[same] = -np.inf
                best = _best(scores, settings.rerank)
                best = best[ids[best] != q]
                if len(best) >= n:  # what may still be as near as the last of them
                    most = own * (dots + slack) if metric == "ip" else 2 * own * (size[0] / longest) * (dots + slack) - own**2
                    most[same] = -np.inf
                    have = (exact[best] / longest) @ toward[0]
                    have = have if metric == "ip" else 2 * (size[0] / longest) * have - own[best] ** 2
                    most[best] = -np.inf
                    best = np.concatenate((best, np.flatnonzero(most >= np.partition(have, len(have) - n)[len(have) - n])))
            best = best[ids[best] != q]
            true = _exactly(exact, best, v, metric)
            top = np.lexsort((ids[best], -true if metric == "ip" else true))[:n]
            found.append((np.full(len(top), q), ids[best][top], true[top]))
        q, own, true = (np.concatenate(c) for c in zip(*found, strict=True))
        yield from packed_batches(deal(_spread(q, 3) % parts, q, own, true))

    def ranked(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        q, own, true = undeal(blobs, "i8", "i8", "f8")
        order = np.lexsort((own, -true if metric == "ip" else true, q))
        q, own, true = q[order], own[order], true[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) + 1
        keep = rank <= n
        yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(rank[keep].astype(np.int32)), pa.array(own[keep]), pa.array(true[keep])], ["query_id", "rank", id_col, "score"])

    packed = rows.mapInArrow(lambda b: packed_batches(dealt(b)), PACKED)
    return per_partition(per_partition(packed, min(tasks, 100_000), scan, PACKED), parts, ranked, result)

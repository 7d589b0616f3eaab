"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its features: hashed words, word
pairs and character n-grams (3 to 5 characters of a word, the white space next to it
included as its border). A softmax layer over that average gives the labels'
probabilities. Vectors and layer are trained together by numpy stochastic gradient
descent on a bounded sample of labelled rows, on the driver.

For scoring, the layer is folded into the vectors: the difference of the two logits
is an average of one number a feature, so each text is one pass over its characters.

Defined results: null and empty texts have no features and get the bias alone; null
labels, and labels other than 0 and 1, aren't learned from; of conflicting labels of
one id the smaller counts; repeated rows score alike; an empty table gives an empty
result; without labelled rows every score is 0.5; other columns are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import inverse, mix, powers, runs_of

GRAMS = (3, 4, 5)
_BASE = 0xA24BAED4963EE407
#: Bytes of a batch of scored rows, about; the executor holds one of these.
OUT_BYTES = 8 << 20


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the sample: at most so many labelled rows of each label,
    those with the smallest hash of their id."""

    bits: int = 18
    dim: int = 16
    epochs: int = 4
    rate: float = 0.2
    per_class: int = 2500
    seed: int = 7


def features(buf: np.ndarray, bounds: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers, row of each) of a run of texts, kind by kind."""
    chars = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    bounds = lead[bounds]
    n = len(chars)
    if len(bounds) < 2 or n != bounds[-1]:
        if n == 0 or len(bounds) < 2:
            return
        bounds = np.minimum(bounds, n)  # malformed UTF-8
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    row = np.pad(row, (0, n - len(row)), mode="edge") if len(row) else np.zeros(n, dtype=np.int64)
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    code = chars.astype(np.uint64) + np.uint64(1)
    code[space] = np.uint64(33)
    shift = np.uint64(64 - bits)

    # words and word pairs, from prefix sums of a polynomial
    begin, stop = ~space, ~space
    begin[1:] &= space[:-1] | (row[1:] != row[:-1])
    stop[:-1] &= space[1:] | (row[1:] != row[:-1])
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    if len(a):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(code) * powers(_BASE, n), out=sums[1:])
        words = mix((sums[b] - sums[a]) * powers(inverse(_BASE), n)[a] + (b - a).astype(np.uint64))
        yield (words >> shift).astype(np.int64), row[a]
        pair = row[a[1:]] == row[a[:-1]]
        yield (mix(words[:-1] * np.uint64(3) + words[1:])[pair] >> shift).astype(np.int64), row[a[1:]][pair]

    # character n-grams with white space at their ends only
    spaces = np.concatenate(([0], np.cumsum(space)))
    key = code
    for size in range(2, max(GRAMS) + 1):
        if n < size:
            break
        key = key[: n - size + 1] * np.uint64(_BASE) + code[size - 1 :]
        if size in GRAMS:
            inside = (spaces[size - 1 : n] - spaces[1 : n - size + 2]) == 0
            inside &= row[size - 1 :] == row[: n - size + 1]
            yield (mix(key[inside] + np.uint64(size)) >> shift).astype(np.int64), row[: n - size + 1][inside]


def counted(buf: np.ndarray, bounds: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct features and their counts of each text of a run."""
    parts = list(features(buf, bounds, bits))
    ids = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, dtype=np.int64)
    rows = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, dtype=np.int64)
    both, counts = np.unique((rows << bits) | ids, return_counts=True)
    cuts = np.searchsorted(both >> bits, np.arange(len(bounds)))
    for i in range(len(bounds) - 1):
        part = slice(cuts[i], cuts[i + 1])
        yield (both[part] & ((1 << bits) - 1)).astype(np.int32), counts[part].astype(np.int32)


def pack(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending features and their counts, in about two bytes a feature: differences
    and counts by planes of bytes, deflated."""
    gaps = np.diff(ids, prepend=0).astype("<u4")
    return zlib.compress(np.stack((gaps, counts.astype("<u4"))).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(blob), dtype=np.uint8).reshape(4, -1)
    gaps, counts = np.ascontiguousarray(raw.T).view("<u4").reshape(2, -1)
    return np.cumsum(gaps, dtype=np.int64), counts


class Sample:
    """Labelled rows, packed: a row takes a few kilobytes of the driver, and as many
    features as there are numbers for them at most. Rows are unpacked one at a time."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.labels, self.blobs = np.array([y for y, _ in rows], dtype=np.int64), [b for _, b in rows]

    def __len__(self) -> int:
        return len(self.blobs)

    def __getitem__(self, k: int) -> tuple[int, np.ndarray, np.ndarray]:
        return int(self.labels[k]), *unpack(self.blobs[k])

    def only(self, keep) -> "Sample":
        return Sample([(int(y), b) for y, b in zip(self.labels, self.blobs, strict=True) if keep(b)])


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str, text_col: str, bits: int, extract=None, values: tuple[int, ...] = (0, 1)) -> Sample:
    """A bounded sample, at most ``most`` labels of each value, in an order that depends
    on the rows alone."""
    known = labels.where(F.col(label).isin(*values) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).alias("_label"))
    order = F.xxhash64(F.lit("sample"), id_col)
    picked = None
    for value in values:
        part = known.where(F.col("_label") == value).orderBy(order, id_col).limit(most)
        picked = part if picked is None else picked.unionAll(part)
    # at most len(values) * most rows of two numbers
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("_text")).join(F.broadcast(picked), id_col).select(id_col, "_label", "_text")
    extract = extract or counted
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buf, bounds, at in runs_of(batch.column(2), 1 << 18):
                got = [pack(*x) for x in extract(buf, bounds, bits)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at.start, len(at)), batch.column(1).slice(at.start, len(at)).cast(pa.int32()), pa.array(got, pa.binary())], [id_col, "_label", "features"])

    got = rows.mapInArrow(run, f"{id_col} {id_type}, _label int, features binary").toArrow()
    out = sorted(zip(*[c.to_pylist() for c in got.columns], strict=True))
    return Sample([x[1:] for x in out])


@dataclass
class Model:
    """``weights``: the difference of the logits that each feature gives; ``bias``."""

    weights: np.ndarray
    bias: float
    bits: int


def train(rows: Sample, settings: Settings) -> Model:
    """Stochastic gradient descent, one document a step, at a falling rate. Labels
    weigh as if they were equally frequent.

    The step of a feature's vector is that of a sum of features bounded at 2 a feature,
    not of their average: by the average's own gradient, the features of a long text
    would hardly move."""
    rng = np.random.default_rng(settings.seed)
    vectors = rng.random((1 << settings.bits, settings.dim), dtype=np.float32)
    vectors -= np.float32(0.5)
    vectors *= np.float32(2 / settings.dim)
    layer, bias = np.zeros((2, settings.dim), dtype=np.float32), np.zeros(2, dtype=np.float32)
    empty = pack(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
    rows = rows.only(lambda blob: blob != empty)
    share = np.bincount(rows.labels, minlength=2)
    step_weight = len(rows) / (2.0 * np.maximum(share, 1))
    steps, done = settings.epochs * len(rows), 0
    for _ in range(settings.epochs):
        for k in rng.permutation(len(rows)):
            y, ids, counts = rows[k]
            rate = settings.rate * (1 - done / steps) * step_weight[y]
            done += 1
            part = (counts / counts.sum()).astype(np.float32)
            own = vectors[ids]
            hidden = part @ own
            logits = layer @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = layer.T @ p
            layer -= rate * np.outer(p, hidden)
            bias -= 0.1 * rate * p
            vectors[ids] = own - (rate * np.minimum(part * len(ids), 2.0))[:, None] * back
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]), settings.bits)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    return train(labelled(docs, labels, label, settings.per_class, id_col, text_col, settings.bits), settings)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs``' id, the columns to keep and score: the probability of label 1."""
    weights, bias, bits = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias, model.bits  # 4 * 2**bits bytes

    columns = [id_col, *[c for c in keep if c != id_col]]
    own = text_col in columns and dict(docs.dtypes)[text_col] == "string"  # a kept text travels once
    rows = docs.select(*columns) if own else docs.select(*columns, F.col(text_col).cast("string").alias("_text"))
    place, n = columns.index(text_col) if own else len(columns), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for buf, bounds, at in runs_of(batch.column(place), 1 << 18):
                total, count = np.zeros(len(at)), np.zeros(len(at))
                for ids, rows in features(buf, bounds, bits):
                    total += np.bincount(rows, table[ids], minlength=len(at))
                    count += np.bincount(rows, minlength=len(at))
                scores[at.start : at.stop] = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -50, 50)))
            out = pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores)], [*batch.schema.names[:n], "score"])
            step = max(1, batch.num_rows * OUT_BYTES // max(1, out.nbytes))
            yield from (out.slice(i, step) for i in range(0, batch.num_rows, step))

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:n])
    return rows.mapInArrow(run, f"{schema}, score double")


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def assess(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(docs, labels.where(~held_out()), settings=settings)
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Toxicity: cumulative-link ordinal regression on sparse text features.

A document's grade y of 0..K-1 follows P(y > k) = sigmoid(w.x - t_k): one weight
vector that all ordered thresholds t_0 < t_1 < ... share. x holds the hashed words of
the text (letters and digits, lower-cased) and their first 4 to 7 bytes, which catch
inflected and compound forms, each once, valued by their log-odds in the sample. The expected
severity is the sum of P(y > k). Weights and thresholds are trained by stochastic
gradient descent with AdaGrad steps in numpy, on a bounded sample.

The grades are those of the labels where these have more than two (``fit`` with
``values``). Where labels only say toxic or not, ``graded`` makes grades: documents that
aren't toxic are 0, toxic ones 1, 2 or 3 by how many of their distinct words the toxic
part of the sample uses far more often than the rest. So with such labels only the first
threshold stands for a label; the others order the toxic documents among themselves.

Defined results: null and empty texts have no features and severity by the
thresholds alone; null labels aren't learned from; repeated rows score alike; an
empty table gives an empty result; without labelled rows severities are constant;
other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import Words, mix, spaced, words_of
from verbarium.llm.quality import Sample, held_out, labelled

#: Letters, digits and all bytes of other scripts make words.
_TABLE = np.zeros(256, dtype=bool)
_TABLE[48:58] = _TABLE[65:91] = _TABLE[97:123] = True
_TABLE[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes of a word's beginning that are a feature besides the word.
STEMS = (4, 5, 6, 7)


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the sample: at most so many labelled rows, toxic or not,
    those with the smallest hash of their id. ``least_rows``: about how many rows a
    feature needs to tell anything."""

    bits: int = 20
    epochs: int = 8
    rate: float = 0.3
    decay: float = 1e-4
    per_class: int = 3000
    least_rows: int = 4
    seed: int = 11
    grades: int = 4


def _features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once, sorted."""
    row = words.row_of_words()
    keys, rows = [words.keys], [row]
    size = words.ends - words.starts
    for n in STEMS:
        longer = size > n
        stem = Words.__new__(Words)
        stem.buf, stem.starts = words.buf, words.starts[longer]
        stem.ends = stem.starts + n
        keys.append(mix(stem._hash() + np.uint64(n)))
        rows.append(row[longer])
    merged = np.unique((np.concatenate(rows) << bits) | (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64))
    return merged >> bits, merged & ((1 << bits) - 1)


def presence(buf: np.ndarray, bounds: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows, ids = _features(Words(_FOLD[spaced(buf)], bounds, range(len(bounds) - 1), table=_TABLE), bits)
    cuts = np.searchsorted(rows, np.arange(len(bounds)))
    for i in range(len(bounds) - 1):
        part = ids[cuts[i] : cuts[i + 1]].astype(np.int32)
        yield part, np.ones(len(part), dtype=np.int32)


def log_odds(rows: Sample, settings: Settings) -> np.ndarray:
    """For each feature, how much more often toxic rows of the sample have it, as a
    logarithm smoothed by ``least_rows`` / 2 rows and shrunk by 1: what few rows or
    both sides have comes out as 0."""
    seen, n = np.zeros((2, 1 << settings.bits)), np.zeros(2)
    for k in range(len(rows)):
        y, ids, _ = rows[k]
        seen[min(y, 1), ids] += 1
        n[min(y, 1)] += 1
    if not n.all():
        return np.zeros(1 << settings.bits)
    least = settings.least_rows / 2 / n[1]
    odds = np.log(seen[1] / n[1] + least) - np.log(seen[0] / n[0] + least)
    return np.sign(odds) * np.maximum(np.abs(odds) - 1, 0)


def graded(rows: Sample, odds: np.ndarray, settings: Settings) -> list[tuple[int, np.ndarray]]:
    """(grade, features that tell anything) of the sample."""
    out = []
    own_grades = len(rows) and rows.labels.max() > 1
    for k in range(len(rows)):
        y, ids, _ = rows[k]
        grade = y if own_grades or not y else int(np.clip((odds[ids] > 1).sum(), 1, settings.grades - 1))
        out.append((grade, ids[odds[ids] != 0]))
    return out


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int


def train(rows: list[tuple[int, np.ndarray]], scale: np.ndarray, settings: Settings) -> Model:
    """``scale``: the value of each feature where it is present. The gradient of the likelihood of adjacent thresholds: for grade y,
    P(y) = s(u_y-1) - s(u_y) with u_k = w.x - t_k."""
    rng = np.random.default_rng(settings.seed)
    k = settings.grades - 1
    w, gw = np.zeros(1 << settings.bits), np.full(1 << settings.bits, 1.0)
    t, gt = np.linspace(0.5, 0.5 + k - 1, k), np.full(k, 1.0)
    for _ in range(settings.epochs):
        for i in rng.permutation(len(rows)):
            y, ids = rows[i]
            x = scale[ids]
            s = 1 / (1 + np.exp(-np.clip(w[ids] @ x - t, -30, 30)))
            upper, lower = (s[y - 1] if y else 1.0), (s[y] if y < k else 0.0)
            p = max(upper - lower, 1e-9)
            du = upper * (1 - upper) / p if y else 0.0
            dl = lower * (1 - lower) / p if y < k else 0.0
            step = du - dl  # of the log-likelihood by w.x
            if len(ids):
                g = step * x - settings.decay * w[ids]
                gw[ids] += g * g
                w[ids] += settings.rate * g / np.sqrt(gw[ids])
            for j, d in ((y - 1, -du), (y, dl)):
                if 0 <= j < k and d:
                    gt[j] += d * d
                    t[j] += settings.rate * d / np.sqrt(gt[j])
            t = np.maximum.accumulate(t + np.arange(k) * 1e-9)
    return Model((w * scale).astype(np.float32), t, settings.bits)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", values: tuple[int, ...] = (0, 1)) -> Model:
    """``values``: the labels to learn from, 0 up to the highest grade."""
    if len(values) > 2:
        settings = replace(settings, grades=len(values))
    rows = labelled(docs, labels, label, settings.per_class, id_col, text_col, settings.bits, presence, values)
    odds = log_odds(rows, settings)
    return train(graded(rows, odds, settings), odds, settings)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, severity (expected grade), p_toxic (of a grade over 0) and grade (the
    likeliest) of every row."""
    weights, thresholds, bits = docs.sparkSession.sparkContext.broadcast(model.weights), model.thresholds, model.bits  # 4 * 2**bits bytes
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros(batch.num_rows)
            for words in words_of(batch.column(1), lower=True, limit=1 << 18, table=_TABLE):
                rows, ids = _features(words, bits)
                sums[words.rows.start : words.rows.stop] = np.bincount(rows, weights.value[ids], minlength=len(words.rows))
            over = 1 / (1 + np.exp(-np.clip(sums[:, None] - thresholds, -30, 30)))
            each = np.diff(np.column_stack((np.ones(len(sums)), over, np.zeros(len(sums)))), axis=1) * -1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(over.sum(axis=1)), pa.array(over[:, 0]), pa.array(each.argmax(axis=1).astype(np.int32))], [id_col, "severity", "p_toxic", "grade"])

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"{id_col} {id_type}, severity double, p_toxic double, grade int")


def assess(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, severity, p_toxic, grade and toxic (1 if p_toxic >= 0.5) of
    every row; a fifth of the labels is held out."""
    model = fit(docs, labels.where(~held_out()), settings=settings)
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "severity", "p_toxic", "grade", (F.col("p_toxic") >= 0.5).cast("int").alias("toxic"))

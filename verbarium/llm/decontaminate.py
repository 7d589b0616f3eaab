"""Benchmark decontamination: pigeonhole edit matching.

Texts are word sequences (letters and digits, lower-cased; curly quotes, long dashes
and no-break spaces part words as their ASCII forms do). A test item of m words
has an error budget of k = m * percent / 100 word edits. It is cut into k + 1 pieces;
wherever the item occurs with at most k edits, one piece is there unchanged. The
pieces' first words are looked up at every position of every document by a rolling
key; around each exact hit of a whole piece, Myers' bit-parallel algorithm gives the
smallest edit distance of the item to any stretch of the document.

The items are the driver's side of the work: they are read in slices of about
SLICE_WORDS words, each a broadcast of its own. One pass over the documents takes groups
of batches through all slices, one after another, so each row comes out once and a slice
is opened once a group; a task holds one slice's tables at a time.

Defined results: null and empty texts, and items without words, match nothing;
repeated items match alike; an item with a null id is reported as null id, first;
repeated documents are judged alike; texts of any length are searched whole; an empty
table gives an empty result, an empty benchmark matches nothing; ids of items may be
numbers or strings; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import buffered, opened, rolling, shared, words_of
from verbarium.llm.toxicity import _TABLE

SLICE_WORDS = 4_000_000
_BASE = 0x9FB21C651E98DF25
#: A piece is looked up by at most so many words of its beginning.
MOST_ANCHOR = 5


def myers(pattern: list[int], text: list[int]) -> int:
    """The smallest edit distance of ``pattern`` to any stretch of ``text``."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, x in enumerate(pattern):
        masks[x] = masks.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best = m
    for x in text:
        eq = masks.get(x, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (~(zero | up) & full), up & zero
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        plus, minus = plus << 1 & full, minus << 1 & full  # a match may start anywhere
        up, down = minus | (~(zero | plus) & full), plus & zero
        best = min(best, distance)
    return best


class Items:
    """Word keys of the items of a slice, and their pieces by anchor."""

    def __init__(self, ids: list, keys: list[np.ndarray], percent: int):
        self.ids, self.keys, self.percent = ids, keys, percent
        self.budget = [len(k) * percent // 100 for k in keys]
        found: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
        for i, (own, k) in enumerate(zip(keys, self.budget, strict=True)):
            if not len(own):
                continue
            cuts = [len(own) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                q = min(b - a, MOST_ANCHOR)
                key = int(rolling(own[a : a + q], q, _BASE)[0])
                found.setdefault(q, {}).setdefault(key, []).append((i, a, b))
        self.pieces = found
        self.sorted = {q: np.array(sorted(d), dtype=np.uint64) for q, d in found.items()}
        self.sieve = {}
        for q, d in self.sorted.items():
            self.sieve[q] = np.zeros(1 << 16, dtype=bool)
            self.sieve[q][(d & np.uint64(0xFFFF)).astype(np.int64)] = True

    def search(self, keys: np.ndarray, first: np.ndarray) -> dict[int, dict[int, int]]:
        """{row: {item: distance}} of the items found in the rows' words."""
        out: dict[int, dict[int, int]] = {}
        done: dict[tuple[int, int], set[int]] = {}
        for q, known in self.sorted.items():
            rolled = rolling(keys, q, _BASE)
            at = np.flatnonzero(self.sieve[q][(rolled & np.uint64(0xFFFF)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(known, rolled[at]), len(known) - 1)
            at = at[known[slot] == rolled[at]]
            rows = np.searchsorted(first, at, side="right") - 1
            for p, row in zip(at.tolist(), rows.tolist(), strict=True):
                end = int(first[row + 1])
                if p + q > end:
                    continue
                for i, a, b in self.pieces[q][int(rolled[p])]:
                    own, k = self.keys[i], self.budget[i]
                    if p + b - a > end or not np.array_equal(keys[p : p + b - a], own[a:b]):
                        continue
                    start = p - a
                    seen = done.setdefault((row, i), set())
                    if start in seen or out.get(row, {}).get(i) == 0:
                        continue
                    seen.add(start)
                    window = keys[max(int(first[row]), start - k) : min(end, start + len(own) + k)]
                    distance = myers(own.tolist(), window.tolist())
                    if distance <= k:
                        mine = out.setdefault(row, {})
                        mine[i] = min(distance, mine.get(i, distance))
        return out


def slices(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and word keys of the benchmark, slice by slice."""
    ids, keys, size = [], [], 0
    for row in benchmark.select(F.col(id_col), F.lower(F.col(text_col).cast("string"))).orderBy(id_col).toLocalIterator():
        (words,) = words_of(pa.array([row[1]], pa.large_string()), table=_TABLE)
        ids.append(row[0])
        keys.append(words.keys)
        size += len(words.keys)
        if size > SLICE_WORDS:
            yield ids, keys
            ids, keys, size = [], [], 0
    if ids:
        yield ids, keys


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 15, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs``' id, the columns to keep, n_items (test items found), item_ids (those,
    ascending), min_distance (the fewest word edits, else null) and contaminated
    (0 or 1) of every row."""
    names = [id_col, *[c for c in keep if c != id_col]]
    rows = docs.select(*names, F.lower(F.col(text_col).cast("string")).alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    kind = {"int": "int", "bigint": "bigint"}.get(dict(benchmark.dtypes)[item_col], "string")
    benchmark = benchmark.withColumn(item_col, F.col(item_col).cast(kind))
    id_type = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]
    held = [shared(docs.sparkSession, Items(*part, percent)) for part in slices(benchmark, item_col, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = opened(held[0]) if len(held) == 1 else None
        for group in buffered(batches):
            found_ids: list[list[list]] = [[[]] * batch.num_rows for batch in group]
            fewest: list[list[int | None]] = [[None] * batch.num_rows for batch in group]
            for value in held:  # each slice is opened once for a group of batches
                items = one or opened(value)
                for batch, ids, least in zip(group, found_ids, fewest, strict=True):
                    for words in words_of(batch.column(batch.num_columns - 1), table=_TABLE):
                        for row, found in items.search(words.keys, words.first).items():
                            at = words.rows[row]
                            ids[at] = sorted([*ids[at], *(items.ids[i] for i in found)], key=lambda x: (x is not None, x))
                            least[at] = min([*found.values(), *([] if least[at] is None else [least[at]])])
                del items
            for batch, ids, least in zip(group, found_ids, fewest, strict=True):
                sizes = [len(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(id_type)), pa.array(least, pa.int32()), pa.array([int(n > 0) for n in sizes], pa.int32())],
                    [*batch.schema.names[:-1], "n_items", "item_ids", "min_distance", "contaminated"],
                )

    return rows.mapInArrow(run, f"{schema}, n_items bigint, item_ids array<{kind}>, min_distance int, contaminated int")

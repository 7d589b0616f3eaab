"""Vocabularies and co-occurrences summed inside tasks (survey M01, M02, M07, M08, A10-A13).

A task cuts runs of texts into words at once, over their bytes, and sums before anything
is shuffled: words by run, pairs of words over all of its runs. Pairs of the most frequent
words are summed in a dense table, the others in sorted runs that are merged whenever they
grow; what is full is sent on. So a pair of words is one entry a task, not one row each
time it occurs, and a hot word costs no task more than another. Entries travel packed, as
differences that compress to some two bytes, to partitions by a hash of what 1024 pairs in
a row share, where the sorted runs are merged once more.

The vocabulary is broadcast up to MOST_WORDS, by its count, with an index of hashes that
tasks only search; ``cooccurrence`` joins beyond that. Weights are summed as whole multiples of a common fraction where there is one (exact
in any order). Results equal those of ``cooccurrence.vocabulary`` and ``counted``, but that
rows without an id count and rows of one id are texts of their own."""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a run; words of the dense table; entries of the sorted runs before they go on.
RUN, DENSE, MOST_HELD = 2 << 20, 1024, 4 << 20
#: Words of a vocabulary that is broadcast, 26 bytes each and their letters.
MOST_WORDS = 16_000_000
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
_PACKED = "pid int, blob binary"


def folded(text: str | None, lowercase: bool) -> bytes:
    """Lower-cased, decomposed, without what isn't ASCII."""
    if not text:
        return b""
    text = text.lower() if lowercase else text
    return text.encode() if text.isascii() else unicodedata.normalize("NFKD", text).encode("ascii", "ignore")


def cut(parts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of folded texts, and the number of the sentence of each; no two texts
    share a sentence."""
    return _cut(parts)[:2]


def _cut(parts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As ``cut``, and the number of the first sentence of each text."""
    buf = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
    word = _WORD[buf]
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stop = buf == 10
    stop[:-1] |= (buf[:-1] == 46) & (buf[1:] == 32)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[word])])
    stops = np.flatnonzero(stop)
    begins = np.concatenate(([0], np.cumsum([len(x) + 1 for x in parts])[:-1])) if parts else np.empty(0, dtype=np.int64)
    return words, np.searchsorted(stops, starts), np.searchsorted(stops, begins)


def runs(batches: Iterator[pa.RecordBatch], lowercase: bool) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words and sentences of runs of texts, or of token lists (one sentence a row)."""
    for batch in batches:
        column = batch.column(0)
        if pa.types.is_list(column.type):
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            yield pc.list_flatten(column).cast(pa.large_string()), np.repeat(np.arange(len(sizes)), sizes)
            continue
        held, size = [], 0
        for text in column.to_pylist():
            held.append(folded(text, lowercase))
            size += len(held[-1])
            if size >= RUN:
                yield cut(held)
                held, size = [], 0
        if held:
            yield cut(held)


def _keyed(batches: Iterator[pa.RecordBatch], lowercase: bool) -> Iterator[tuple[pa.Array, np.ndarray, list[bytes]]]:
    """Words, the sentence of each (counted from 0, those with words only), and ``key|sid|``
    of each sentence, of the rows of ``_named``; a missing key is left out, as concat_ws does."""
    name = lambda key, sid: b"%d|" % sid if key is None else b"%s|%d|" % (key.encode(), sid)
    for batch in batches:
        column, keys = batch.column(0), batch.column(1).to_pylist()
        if pa.types.is_list(column.type):
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            have, sids = np.flatnonzero(sizes), batch.column(2).to_pylist()
            yield pc.list_flatten(column).cast(pa.large_string()), np.repeat(np.arange(len(have)), sizes[have]), [name(keys[i], sids[i]) for i in have.tolist()]
            continue

        def sent(held: list[bytes], own: list) -> tuple[pa.Array, np.ndarray, list[bytes]]:
            words, sentence, first = _cut(held)
            numbers, dense = np.unique(sentence, return_inverse=True)
            text = np.searchsorted(first, numbers, side="right") - 1
            return words, dense, [name(own[t], n) for t, n in zip(text.tolist(), (numbers - first[text]).tolist(), strict=True)]

        held, at, size = [], 0, 0
        for i, text in enumerate(column.to_pylist()):
            held.append(folded(text, lowercase))
            size += len(held[-1])
            if size >= RUN:
                yield sent(held, keys[at : i + 1])
                held, at, size = [], i + 1, 0
        if held:
            yield sent(held, keys[at:])


def _draws(seed: int, names: list[bytes], sentence: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """``vector.draw`` of (key, sid, pos): numbers below 2 ** 52."""
    begin = [b"%d|" % seed + x for x in names]
    digests = b"".join([hashlib.md5(begin[s] + b"%d" % p).digest() for s, p in zip(sentence.tolist(), pos.tolist(), strict=True)])
    return (np.frombuffer(digests, dtype=">u8")[::2] >> np.uint64(12)).astype(np.int64)


def _place(sentence: np.ndarray) -> np.ndarray:
    """The place of each word in its sentence, from 0."""
    if not len(sentence):
        return np.empty(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
    return np.arange(len(sentence)) - np.repeat(first, np.diff(np.append(first, len(sentence))))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits without a pattern, of numbers (splitmix64)."""
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(words: pa.Array) -> np.ndarray:
    """A number of 64 bits of each word: its bytes, each times a number of its place."""
    out = np.zeros(len(words), dtype=np.uint64)
    for at in range(0, len(words), 1 << 18):
        part = pa.concat_arrays([words.slice(at, 1 << 18).cast(pa.large_binary())])
        size = pc.binary_length(part).to_numpy()
        ends = np.cumsum(size)
        total = int(ends[-1])
        if total:
            first = int(np.frombuffer(part.buffers()[1], np.int64, 1, 8 * part.offset)[0])
            place = np.arange(total) - np.repeat(ends - size, size)
            by_place = _mixed(np.arange(int(size.max()), dtype=np.uint64))
            some = size > 0
            parts = (np.frombuffer(part.buffers()[2], np.uint8, total, first) + np.uint64(1)) * by_place[place]
            out[at : at + len(part)][some] = np.add.reduceat(parts, (ends - size)[some])
    return _mixed(out)


class Chosen:
    """The words of a vocabulary in a task's texts, by rank; with ``subsample``, frequent
    ones are dropped first (C45), by the hash of ``vector.coin``. Words are found by their
    hashes and compared by letters; no table of the vocabulary is made in a task."""

    def __init__(self, known: tuple, subsample: float = 0.0, seed: int = 0):
        self.words, _, counts, self.hashes, self.order = known
        self.seed, self.drop = seed, None
        if subsample > 0:
            limit = subsample * float(counts.sum())
            self.drop = np.where(counts > limit, 1 - np.sqrt(limit / counts), 0.0)

    def ranked(self, found: pa.Array) -> np.ndarray:
        coded = found.dictionary_encode()
        asked = coded.dictionary
        rank = np.full(len(asked), -1, dtype=np.int64)
        if len(asked) and len(self.hashes):
            own = hashes(asked)
            at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == own)
            place = self.order[at[hit]]
            same = pc.equal(self.words.take(pa.array(place)).cast(asked.type), asked.take(pa.array(hit))).to_numpy(zero_copy_only=False).astype(bool)
            rank[hit[same]] = place[same]
        return rank[coded.indices.to_numpy()] if len(rank) else np.empty(0, dtype=np.int64)

    def keyed(self, batches: Iterator[pa.RecordBatch], lowercase: bool) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        for found, sentence, names in _keyed(batches, lowercase):
            ranks = self.ranked(found)
            on = ranks >= 0
            if self.drop is not None and len(ranks):
                asked = np.flatnonzero(on)
                asked = asked[self.drop[ranks[asked]] > 0]
                coin = _draws(self.seed, names, sentence[asked], _place(sentence)[asked]) / float(1 << 52)
                on[asked] = coin >= self.drop[ranks[asked]]
            yield ranks[on], sentence[on], names


def _named(rows: DataFrame, column: str, key: str) -> DataFrame:
    """The texts, or token lists with their numbers, of a column, and their keys."""
    more = ["sid"] if "sid" in rows.columns and dict(rows.dtypes)[column].startswith("array") else []
    return rows.where(F.col(column).isNotNull()).select(column, F.col(key).cast("string").alias("_key"), *more)


def _broadcast(vocab: DataFrame, counts: bool = False) -> tuple | None:
    """What ``Chosen`` takes, broadcast, and the number of words: the words of ``vocab``
    (word, count, id), most frequent first, their ids, with ``counts`` their counts, and
    their hashes, ascending, with the rank of each. None where there are more than
    MOST_WORDS, or where two words share a hash."""
    got = vocab.select("word", "id", "count").limit(MOST_WORDS + 1).toArrow()
    if got.num_rows > MOST_WORDS:
        return None
    by = pc.sort_indices(got, sort_keys=[("count", "descending"), ("word", "ascending")])
    ids, numbers = got.column("id").take(by).to_numpy().astype(np.int32), got.column("count").take(by).to_numpy().astype(np.int64) if counts else None
    words = got.column("word").combine_chunks().take(by)
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words  # of more letters than an array may have
    del got, by
    own = hashes(words)
    order = np.argsort(own, kind="stable").astype(np.int32)
    own = own[order]
    if (own[1:] == own[:-1]).any():
        return None
    return vocab.sparkSession.sparkContext.broadcast((words, ids, numbers, own, order)), len(words)  # at most MOST_WORDS words


def kept_counts(rows: DataFrame, vocab: DataFrame, subsample: float, column: str = "text", key: str = "doc_id", seed: int = 1, lowercase: bool = True) -> DataFrame | None:
    """(id, kept): how often each word of ``vocab`` is left by ``subsample``; None where the
    vocabulary is too large to be broadcast."""
    shared = _broadcast(vocab, subsample > 0)
    if shared is None:
        return None
    known, n = shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, kept = known.value[1].astype(np.int64), np.zeros(n, dtype=np.int64)
        for ranks, _, _ in Chosen(known.value, subsample, seed).keyed(batches, lowercase):
            kept += np.bincount(ranks, minlength=n)
        at = np.flatnonzero(kept)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(kept[at])], ["id", "kept"])

    return _named(rows, column, key).mapInArrow(run, "id bigint, kept bigint").groupBy("id").agg(F.sum("kept").alias("kept"))


def id_lists(rows: DataFrame, vocab: DataFrame, subsample: float = 0.0, column: str = "tokens", key: str = "doc_id", seed: int = 1) -> DataFrame | None:
    """(ids): of each sentence, the ids of the words of ``vocab`` that are left; None where
    the vocabulary is too large to be broadcast."""
    shared = _broadcast(vocab, subsample > 0)
    if shared is None:
        return None
    known, _ = shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = known.value[1]
        for ranks, sentence, _ in Chosen(known.value, subsample, seed).keyed(batches, True):
            if len(ranks):
                first = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(first, len(ranks)).astype(np.int32)), pa.array(ids[ranks]))], ["ids"])

    return _named(rows, column, key).mapInArrow(run, "ids array<int>")


def _source(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).where(F.col(column).isNotNull())


def word_counts(rows: DataFrame, column: str = "text", lowercase: bool = True, least_tokens: int = 1) -> DataFrame:
    """(word, count) of the folded texts, or token lists, of a column. ``least_tokens``:
    shorter sentences don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, sentence in runs(batches, lowercase):
            if least_tokens > 1 and len(words):
                words = words.filter(pa.array(np.bincount(sentence)[sentence] >= least_tokens))
            coded = words.dictionary_encode()
            counts = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(counts)], ["word", "count"])

    return _source(rows, column).mapInArrow(run, "word string, count bigint").groupBy("word").agg(F.sum("count").alias("count"))


def merged(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and the sums of their values; sorted runs sort quickly."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values[order], first)


def squeezed(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Keys in an order and their sums: the first, second ... bytes of all differences, then
    of all sums, which compress to a quarter of what whole numbers do."""
    both = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes() for x in (np.diff(keys, prepend=0), values)]
    return len(keys).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(b"".join(both), asbytes=True)


def unsqueezed(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], 16 * n, asbytes=True), dtype=np.uint8).reshape(2, 8, n)
    steps, values = (np.ascontiguousarray(x.T).reshape(-1) for x in planes)
    return np.cumsum(steps.view(np.int64)), values.view(np.float64)


class Sums:
    """The pairs of a task: (lower rank * n + higher rank) and their summed weights; or,
    where each word has a width of its own, (its rank * n + the other's) and their number."""

    def __init__(self, n: int, weights: np.ndarray):
        self.n, self.weights = n, weights
        self.bits = (len(weights) - 1).bit_length()
        self.few = min(n, DENSE)
        self.table = np.zeros(self.few * self.few)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ranks: np.ndarray, sentence: np.ndarray, width: np.ndarray | None = None) -> None:
        keys, dense, apart = [], [], []
        for d in range(1, len(self.weights) + 1):
            near = np.flatnonzero(sentence[d:] == sentence[:-d])
            a, b = ranks[near], ranks[near + d]
            if width is None:
                low, high = np.minimum(a, b), np.maximum(a, b)
                common = high < self.few
            else:
                ahead, back = width[near] >= d, width[near + d] >= d
                low, high = np.concatenate((a[ahead], b[back])), np.concatenate((b[ahead], a[back]))
                common = (low < self.few) & (high < self.few)
            dense.append(low[common] * self.few + high[common])
            rest = ~common
            keys.append(low[rest] * self.n + high[rest])
            apart.append((len(dense[-1]), len(keys[-1])))
        if sum(x for x, _ in apart):
            self.table += np.bincount(np.concatenate(dense), np.repeat(self.weights, [x for x, _ in apart]), minlength=len(self.table))
        self.held.append(self._sorted(keys, [x for _, x in apart]))
        self.size += len(self.held[-1][0])
        if self.size > MOST_HELD:
            self.held = [self._merged()]
            self.size = len(self.held[0][0])

    def _sorted(self, keys: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """As ``merged``: pairs of each distance. The distance is sorted along in the last
        bits of a number, which takes a fraction of the time of sorting places."""
        if self.n * self.n >= 1 << (62 - self.bits):
            return merged(np.concatenate(keys), np.repeat(self.weights, sizes))
        both = np.concatenate([k << self.bits | d for d, k in enumerate(keys)])
        if not len(both):
            return both, np.empty(0)
        both.sort()
        keys = both >> self.bits
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        both &= (1 << self.bits) - 1
        return keys[first], np.add.reduceat(self.weights[both], first)

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        return merged(np.concatenate([k for k, _ in self.held]), np.concatenate([v for _, v in self.held])) if self.held else (np.empty(0, dtype=np.int64), np.empty(0))

    def full(self) -> bool:
        return self.size > MOST_HELD // 2 and len(self.held) == 1

    def take(self, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self._merged()
        self.held, self.size = [], 0
        if last:
            at = np.flatnonzero(self.table)
            keys = np.concatenate((at // self.few * self.n + at % self.few, keys)) if len(at) else keys
            values = np.concatenate((self.table[at], values)) if len(at) else values
        return keys, values


def _fraction(window: int, weighting: str) -> tuple[np.ndarray, float]:
    """Whole weights of the distances from 1, and what they are multiples of."""
    d = np.arange(1, window + 1)
    if weighting == "count":
        return np.ones(window), 1.0
    if weighting == "expected":
        return (window - d + 1).astype(float), float(window)
    if weighting == "inverse":
        common = math.lcm(*range(1, window + 1))
        return ((common // d).astype(float), float(common)) if window <= 20 else (1.0 / d, 1.0)
    raise ValueError("weighting is count, inverse or expected")


def cells(rows: DataFrame, vocab: DataFrame, window: int, weighting: str = "count", column: str = "text", lowercase: bool = True, dynamic: bool = False, key: str = "doc_id", subsample: float = 0.0, seed: int = 1, mirror: bool = True) -> DataFrame | None:
    """(w, c, x) of the words of ``vocab`` (word, count, id) at most ``window`` places
    apart in a sentence, words outside it left out; both ways of a pair. None where the
    vocabulary is too large to be broadcast. ``dynamic`` (W04): each centre has its own
    width of 1 to ``window``, drawn by ``key``, the sentence's number and the word's place;
    rows without a key are left out then. ``subsample``: as ``Chosen``. Not ``mirror``: one
    way of a pair alone, where both have the same sum."""
    spark = rows.sparkSession
    shared = _broadcast(vocab, subsample > 0)
    if shared is None:
        return None
    known, n = shared
    weights, unit = _fraction(window, weighting)
    keyed = dynamic or subsample > 0
    source = _named(rows.where(F.col(key).isNotNull()), column, key) if keyed else _source(rows, column)
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, size >> 22) if size < 1 << 50 else 0)  # a plan of unknown size says more

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        chosen = Chosen(known.value, subsample, seed)
        if not keyed:
            for found, sentence in runs(batches, lowercase):
                ranks = chosen.ranked(found)
                on = ranks >= 0
                yield ranks[on], sentence[on], None
            return
        for ranks, sentence, names in chosen.keyed(batches, lowercase):
            yield ranks, sentence, 1 + _draws(seed, names, sentence, _place(sentence) + 1) % window if dynamic else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(n, weights)
        for ranks, sentence, width in ranked(batches):
            sums.add(ranks, sentence, width)
            if sums.full():
                yield from packed(*sums.take())
        yield from packed(*sums.take(last=True))

    def packed(keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        owner = (((keys >> 10).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
        # numbers of 16 bits are dealt out without comparing them
        order = np.argsort(owner.astype(np.uint16) if parts <= 1 << 16 else owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=parts))
        for p in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            own = order[ends[p - 1] if p else 0 : ends[p]]
            for at in range(0, len(own), 1 << 19):
                part = own[at : at + (1 << 19)]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([squeezed(keys[part], values[part])], pa.binary())], ["pid", "blob"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        current, size, most = None, 0, MOST_HELD // 2
        for batch in batches:
            for pid, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if pid != current and held:
                    yield from mirrored(held)
                    held, size, most = [], 0, MOST_HELD // 2
                current = pid
                held.append(unsqueezed(blob.as_py()))
                size += len(held[-1][0])
                if size > most:  # what is merged doubles before it is merged again
                    held = [merged(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))]
                    size = len(held[0][0])
                    most = max(MOST_HELD // 2, 2 * size)
        if held:
            yield from mirrored(held)

    def mirrored(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids = known.value[1]
        keys, values = merged(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))
        low, high = keys // n, keys % n
        if dynamic:  # either way has a sum of its own
            for at in range(0, len(keys), 1 << 17):
                part = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(ids[low[part]]), pa.array(ids[high[part]]), pa.array(values[part] / unit)], ["w", "c", "x"])
            return
        x = np.where(low == high, 2, 1) * values / unit
        for at in range(0, len(keys), 1 << 17):
            w, c, y = ids[low[at : at + (1 << 17)]], ids[high[at : at + (1 << 17)]], x[at : at + (1 << 17)]
            other = (w != c) & mirror
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((w, c[other]))), pa.array(np.concatenate((c, w[other]))), pa.array(np.concatenate((y, y[other])))], ["w", "c", "x"])

    # by the number itself: no partition is empty, and none has several numbers
    sent = source.mapInArrow(run, _PACKED).repartitionById(parts, F.col("pid"))
    return sent.mapInArrow(total, "w int, c int, x double")

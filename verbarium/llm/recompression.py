"""Substring dedup by recompression.

Rounds of recompression name, everywhere alike, first the runs of equal words, then in
each round the pairs of neighbouring symbols whose left is on the left side of a
random split of the alphabet and whose right is on its right side. A name is a 64-bit
key of what it stands for, so equal stretches of any two documents get equal symbols
in their interior without an exchange of dictionaries. Each symbol carries its
context: the words that its parse depended on. A symbol whose context lies in a
window of 20 words is therefore in every copy of that window.

Every window is represented by its highest-level symbol of that kind, leftmost first
(or by its own key, if there's none of three words or more). Then:

1. Documents with the same word sequence are one class; all but the smallest id are
   copies. Symbols that two classes, or two places of one document, have are shared.
2. Of documents with shared symbols, the windows that these represent are compared by
   a 96-bit key: all but the first place of each are repeats.
3. The repeats' words go; what is left is joined and hashed.

Symbols and windows travel in packed blobs; a map task keeps one row a key, so a
passage that a third of all documents have costs a row a task.

Documents are ordered by id, rows without an id last, and rows of one id by the key of
their word sequence; every row takes part.

Defined results: null and empty texts have no words; rows of one id with different texts
are documents of their own, in the order above, and so are rows without an id; equal rows
are one document and get equal results; texts of any length are parsed whole; an empty
table gives an empty result; other columns are ignored. Ids are whole numbers; others raise TypeError."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import PACKED, Words, deal, materialize, mix, packed_batches, per_partition, rolling, undeal, whole_numbers, width, words_of

ROUNDS = 7
#: Words of the shortest symbol that may represent a window.
LEAST_SPAN = 3
GATHER = 1_000_000
#: Bytes of text that are parsed at a time.
RUN = 1 << 20
_PAIR, _RUN = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
_WINDOW_BASES = (0xA0761D6478BD642F, 0xE9846AF9B1A615DB)


class Symbols:
    """One level of the parse of a run of documents: names, word spans [start, stop)
    and contexts [low, high). A context that reaches beyond a document's edge lies
    outside all its windows."""

    def __init__(self, name, start, stop, low, high, row):
        self.name, self.start, self.stop, self.low, self.high, self.row = name, start, stop, low, high, row

    def _only(self, keep: np.ndarray) -> list[np.ndarray]:
        return [x[keep] for x in (self.name, self.start, self.stop, self.low, self.high, self.row)]


def token_runs(words: Words, size: int) -> Symbols:
    """Runs of equal words as symbols. That a run ends depends on the next word."""
    keys, row = words.keys, words.row_of_words()
    n = len(keys)
    fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])))
    start = np.flatnonzero(fresh)
    stop = np.append(start[1:], n)
    count = stop - start
    name = np.where(count > 1, mix(keys[start] * _RUN + count.astype(np.uint64)), keys[start])
    row = row[start]
    # one word beyond either end; before a document's first word and after its last lies nothing
    far = 2 * size
    low = np.where(start > words.first[row], start - 1, start - far)
    high = np.where(stop < words.first[row + 1], stop + 1, stop + far)
    return Symbols(name, start, stop, low, high, row)


def pair_round(s: Symbols, number: int, size: int) -> Symbols:
    """One round of pair naming."""
    right = (mix(s.name + np.uint64(number * int(_PAIR) % (1 << 64))) >> np.uint64(63)).astype(bool)
    near = s.row[1:] == s.row[:-1]
    joined = ~right[:-1] & right[1:] & near
    head, tail = np.append(joined, False), np.concatenate(([False], joined))
    far = 2 * size
    # a symbol that stays alone has seen its neighbour: on its left if it is a right symbol, else on its right
    left_low = np.concatenate(([-far], np.where(near, s.low[:-1], s.low[1:] - far)))
    right_high = np.append(np.where(near, s.high[1:], s.high[:-1] + far), s.high[-1] + far)
    alone = ~(head | tail)
    low = np.where(alone & right, np.minimum(s.low, left_low), s.low)
    high = np.where(alone & ~right, np.maximum(s.high, right_high), s.high)
    name, stop = s.name.copy(), s.stop.copy()
    at = np.flatnonzero(joined)
    name[at] = mix(s.name[at] * _PAIR + mix(s.name[at + 1] + np.uint64(number)))
    stop[at] = s.stop[at + 1]
    low[at] = np.minimum(s.low[at], s.low[at + 1])
    high[at] = np.maximum(s.high[at], s.high[at + 1])
    return Symbols(*Symbols(name, s.start, stop, low, high, s.row)._only(~tail))


class Parse:
    """The windows of a run of documents and what represents them."""

    def __init__(self, words: Words, size: int, rounds: int = ROUNDS):
        self.words, self.size = words, size
        n = len(words.keys)
        self.first = words.first
        # a window begins at every word but the last size - 1 of a document
        ends = np.maximum(words.first[1:] - size + 1, words.first[:-1])
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, words.first[:-1], 1)
        np.add.at(edge, ends, -1)
        is_window = np.cumsum(edge[:n]) > 0
        self.is_window, self.last = is_window, ends - 1
        self.open = is_window.copy()
        levels = []
        if n:
            levels.append(token_runs(words, size))
            for k in range(1, rounds + 1):
                levels.append(pair_round(levels[-1], k, size))
        self.used: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (key, first window, last window)
        for level in range(len(levels) - 1, -1, -1):
            self._take(levels[level], level)
        whole = rolling(words.keys, size, _WINDOW_BASES[0])
        self.rest = np.flatnonzero(self.open)
        self.rest_keys = mix(whole[self.rest] ^ np.uint64(0x5555555555555555)) if len(self.rest) else np.empty(0, dtype=np.uint64)
        self.whole, self.other = whole, None

    def _take(self, s: Symbols, level: int) -> None:
        """The windows still open that a symbol of this level is the first to fit in."""
        n = len(self.open)
        before = np.concatenate(([-1], np.where(s.row[1:] == s.row[:-1], s.low[:-1], -1)))
        a = np.maximum(np.maximum(before + 1, s.high - self.size), self.first[s.row])
        b = np.minimum(s.low, self.last[s.row])
        fits = (a <= b) & (s.stop - s.start >= LEAST_SPAN)
        a, b, name = a[fits], b[fits], s.name[fits]
        opened = np.concatenate(([0], np.cumsum(self.open)))
        needed = opened[b + 1] > opened[a]
        a, b, name = a[needed], b[needed], name[needed]
        self.used.append((mix(name + np.uint64(level * int(_RUN) % (1 << 64))), a, b))
        edge = np.zeros(n + 1, dtype=np.int32)
        np.add.at(edge, a, 1)
        np.add.at(edge, b + 1, -1)
        self.open &= np.cumsum(edge[:n]) == 0

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, row) of every symbol or window that represents something."""
        key = np.concatenate([u[0] for u in self.used] + [self.rest_keys])
        at = np.concatenate([u[1] for u in self.used] + [self.rest])
        return key, np.searchsorted(self.first, at, side="right") - 1

    def of_windows(self) -> np.ndarray:
        """The key that represents the window at each word (0 where there is none)."""
        out = np.zeros(len(self.open), dtype=np.uint64)
        taken = ~self.is_window
        for key, a, b in self.used:  # higher levels first
            at = np.repeat(a - np.concatenate(([0], np.cumsum(b - a + 1)[:-1])), b - a + 1) + np.arange((b - a + 1).sum())
            new = ~taken[at]
            out[at[new]] = np.repeat(key, b - a + 1)[new]
            taken[at] = True
        out[self.rest] = self.rest_keys
        return out

    def window_keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit and a 32-bit key of the windows at these words."""
        if self.other is None:
            self.other = rolling(mix(self.words.keys ^ np.uint64(_WINDOW_BASES[1])), self.size, _WINDOW_BASES[1])
        return self.whole[at], (self.other[at] >> np.uint64(32)).astype(np.uint32)


def _signature(keys: np.ndarray) -> bytes:
    return hashlib.blake2b(keys, digest_size=16).digest()


def _split_rows(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, row), and which of them occur several times."""
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    first = np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]))) if len(key) else np.empty(0, dtype=bool)
    at = np.flatnonzero(first)
    return key[at], row[at], np.diff(np.append(at, len(key))) > 1


def _shared(key: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, sig) rows, sorted; which belong to keys with several, and which
    are the first of their key."""
    key, sig, _ = _split_rows(key, sig)
    fresh = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, dtype=bool)
    group = np.cumsum(fresh) - 1
    several = np.bincount(group)[group] > 1 if len(key) else fresh
    return key, sig, several, fresh


def _by_owner(owner: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    order = np.argsort(owner, kind="stable")
    owner, columns = owner[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else []
    for a, b in zip(starts, [*starts[1:], len(owner)], strict=False):
        yield int(owner[a]), [c[a:b].tobytes() for c in columns]


FOUND = "id bigint, n_words bigint, sig binary, sha binary, sig64 bigint, text_key bigint, keys binary"
#: Stands for a null id while documents are compared.
LAST = (1 << 63) - 1


def _shift(docs: DataFrame, id_col: str) -> int:
    """What is taken off ids so that none of them is LAST."""
    least, most = docs.select(F.col(id_col).cast("bigint").alias("id")).agg(F.min("id"), F.max("id")).first()
    if most != LAST:
        return 0
    if least == -LAST - 1:
        raise ValueError("ids take up the whole range of longs")
    return 1


def _rows(docs: DataFrame, id_col: str, text_col: str, shift: int) -> DataFrame:
    """_id (LAST for null), _text and a key of the text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("bigint") - F.lit(shift), F.lit(LAST)).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_key"))


def parsed(rows: DataFrame, size: int) -> DataFrame:
    """Rows without keys: a document, its number of words, the key of its word sequence,
    the SHA-256 of its words joined and the key of its text. Rows with: shared symbols
    (``keys``: the sequences' keys, then the symbols'), for a partition of the sequences
    (``n_words``)."""
    parts = width(rows, 8)

    def out(kind: bytes, owner: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
        return ((p, kind + blob) for p, blob in deal(owner, *columns))

    def send(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
        keys, sigs, twice = (np.concatenate(c) for c in zip(*held, strict=True))
        key, sig, several, fresh = _shared(keys, sigs)
        yield from out(b"K", (key[fresh] % np.uint64(parts)).astype(np.int64), key[fresh], sig[fresh])
        key, sig, _ = _split_rows(np.concatenate((key[several], keys[twice])), np.concatenate((sig[several], sigs[twice])))
        yield from out(b"S", (sig % np.uint64(parts)).astype(np.int64), key, sig)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size_held = 0
        for batch in batches:
            ids, text_keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for words in words_of(batch.column(1), limit=RUN):
                raw, n = words.buf.tobytes(), np.diff(words.first)
                sig = b"".join(_signature(words.keys[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True))
                spans = [(int(words.starts[a]), int(words.ends[b - 1])) if b > a else (0, 0) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                sha = b"".join(hashlib.sha256(b" ".join(raw[a:b].split())).digest() for a, b in spans)
                own, text = ids[words.rows.start : words.rows.stop], text_keys[words.rows.start : words.rows.stop]
                sig64 = np.frombuffer(sig, dtype=np.uint64)[::2]
                owner = ((own.view(np.uint64) ^ sig64) % np.uint64(parts)).astype(np.int64)  # rows without an id are many documents
                yield from out(b"D", owner, own, n, np.frombuffer(sig, dtype="V16"), np.frombuffer(sha, dtype="V32"), text)
                key, row = Parse(words, size).keys()
                key, row, twice = _split_rows(key, row)
                held.append((key, sig64[row], twice))
                size_held += len(key)
                if size_held > GATHER:
                    yield from send(held)
                    held, size_held = [], 0
        if size_held:
            yield from send(held)

    def work(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        kinds = {k: [memoryview(b)[1:] for b in blobs if b[:1] == k] for k in (b"D", b"K", b"S")}
        ids, n, sig, sha, text = undeal(kinds[b"D"], "i8", "i8", "V16", "V32", "i8")
        names = ["id", "n_words", "sig", "sha", "sig64", "text_key", "keys"]
        for at in range(0, len(ids), 20_000):
            part = slice(at, at + 20_000)
            sig64 = np.frombuffer(np.ascontiguousarray(sig[part]).tobytes(), dtype=np.int64)[::2]
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(n[part]), pa.array([x.tobytes() for x in sig[part]], pa.binary()), pa.array([x.tobytes() for x in sha[part]], pa.binary()), pa.array(sig64), pa.array(text[part]), pa.nulls(len(sig64), pa.binary())], names)
        key, sig64, several, _ = _shared(*undeal(kinds[b"K"], "u8", "u8"))
        more_key, more_sig, _ = _split_rows(*undeal(kinds[b"S"], "u8", "u8"))
        owner, value = np.concatenate((sig64[several], more_sig)), np.concatenate((key[several], more_key))
        for p, blob in deal((owner % np.uint64(parts)).astype(np.int64), owner, value):
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array([p], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), none, none, pa.array([blob], pa.binary())], names)

    packed = rows.mapInArrow(lambda batches: packed_batches(mapped(batches)), PACKED)
    return per_partition(packed, parts, work, FOUND)


def gathered(packed: DataFrame, parts: int, owner: str, value: str, names: tuple[str, str]) -> DataFrame:
    """One row for each owner: its distinct values as bytes. Blobs hold both columns."""

    def work(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        owners, values = undeal(blobs, owner, value)
        values, owners, _ = _split_rows(values, owners)
        groups = list(_by_owner(owners, values))
        for at in range(0, len(groups), 5_000):
            part = groups[at : at + 5_000]
            ids = np.array([g for g, _ in part], dtype=owner).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x[0] for _, x in part], pa.binary())], list(names))

    return per_partition(packed, parts, work, f"{names[0]} bigint, {names[1]} binary")


def repeats(shared: DataFrame, size: int) -> DataFrame:
    """(sig64, starts): places of windows that begin elsewhere before. ``shared``: _id,
    _text, sig, sig64 and keys (of shared symbols) of one document of each class."""
    parts = width(shared.select("_text"), 8)

    def out(kind: bytes, owner: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
        return ((p, kind + blob) for p, blob in deal((owner % np.uint64(parts)).astype(np.int64), *columns))

    def ordered(key, check, doc, sig, at) -> tuple[np.ndarray, ...]:
        order = np.lexsort((at, sig, doc, check, key))
        key, check, doc, sig, at = key[order], check[order], doc[order], sig[order], at[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (check[1:] != check[:-1]))) if len(key) else np.empty(0, dtype=bool)
        first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(key) else np.empty(0, dtype=np.int64)
        again = (sig != sig[first]) | (at != at[first])  # a repeated row isn't another place
        return key, check, doc, sig, at, fresh, again

    def send(held: list) -> Iterator[tuple[int, bytes]]:
        key, check, doc, sig, at, fresh, again = ordered(*[np.concatenate(c) for c in zip(*held, strict=True)])
        yield from out(b"R", sig[again], sig[again], at[again])
        yield from out(b"K", key[fresh], key[fresh], check[fresh], doc[fresh], sig[fresh], at[fresh])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        held: list[tuple[np.ndarray, ...]] = []
        size_held = 0
        for batch in batches:
            ids, sig64 = batch.column(0).to_numpy(), batch.column(3).to_numpy().view(np.uint64)
            sigs, lists = batch.column(2), batch.column(4)
            for words in words_of(batch.column(1), limit=RUN):
                parse = Parse(words, size)
                keys = parse.of_windows()
                for i, row in enumerate(words.rows):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    if b - a < size or _signature(words.keys[a:b]) != sigs[row].as_py():
                        continue
                    known = np.unique(np.frombuffer(lists[row].as_py(), dtype=np.uint64))
                    slot = np.minimum(np.searchsorted(known, keys[a : b - size + 1]), len(known) - 1)
                    at = a + np.flatnonzero(known[slot] == keys[a : b - size + 1])
                    if len(at):
                        held.append((*parse.window_keys(at), np.full(len(at), ids[row]), np.full(len(at), sig64[row]), (at - a).astype(np.int32)))
                        size_held += len(at)
                if size_held > GATHER:
                    yield from send(held)
                    held, size_held = [], 0
        if size_held:
            yield from send(held)

    def work(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        kinds = {k: [memoryview(b)[1:] for b in blobs if b[:1] == k] for k in (b"K", b"R")}
        _, _, _, sig, at, _, again = ordered(*undeal(kinds[b"K"], "u8", "u4", "i8", "u8", "i4"))
        more_sig, more_at = undeal(kinds[b"R"], "u8", "i4")
        sig, at = np.concatenate((sig[again], more_sig)), np.concatenate((at[again], more_at))
        yield from packed_batches(deal((sig % np.uint64(parts)).astype(np.int64), sig, at))

    packed = shared.select("_id", "_text", "sig", "sig64", "keys").mapInArrow(lambda batches: packed_batches(mapped(batches)), PACKED)
    return gathered(per_partition(packed, parts, work, PACKED), parts, "u8", "i4", ("sig64", "starts"))


def dedup(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = False) -> DataFrame:
    """id, n_words, n_removed and kept_sha256 of every row; with ``kept_text`` also the
    words kept, joined by one space."""
    whole_numbers(docs, id_col, "recompression")
    shift = _shift(docs, id_col)
    found, _ = materialize(parsed(_rows(docs, id_col, text_col, shift), size))
    whole = found.where("keys is null").drop("keys")
    classes, _ = materialize(whole.groupBy("sig", "sig64").agg(F.min(F.struct("id", "text_key")).alias("rep"), F.count("*").alias("copies")).select("sig", "sig64", F.col("rep.id").alias("rep"), F.col("rep.text_key").alias("rep_key"), "copies"))
    parts = width(docs.select(id_col, text_col), 8)
    lists = gathered(found.where("keys is not null").select(F.col("n_words").cast("int").alias("pid"), F.col("keys").alias("blob")), parts, "u8", "u8", ("sig64", "keys"))
    shared = classes.join(lists, "sig64").select(F.col("rep").alias("_id"), F.col("rep_key").alias("_key"), "sig", "sig64", "keys")
    texts, _ = materialize(_rows(docs, id_col, text_col, shift).hint("merge").join(shared, ["_id", "_key"]).drop("_key"))
    again = repeats(texts, size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in range(batch.num_rows):
                words = (batch.column(0)[row].as_py() or "").encode().split()
                starts = np.frombuffer(batch.column(2)[row].as_py(), dtype=np.int32)
                (keyed,) = words_of(batch.column(0).slice(row, 1))
                if _signature(keyed.keys) != batch.column(1)[row].as_py():
                    continue
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, np.minimum(starts + size, len(words)), -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                out.append((batch.column(1)[row].as_py(), int(gone.sum()), hashlib.sha256(kept).digest(), kept.decode("utf-8", "replace") if kept_text else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["cut_sig", "cut_n", "cut_sha", "cut_text"])

    cuts = texts.join(again, "sig64").select("_text", "sig", "starts").mapInArrow(cut, "cut_sig binary, cut_n bigint, cut_sha binary, cut_text string").dropDuplicates(["cut_sig"])
    # classes of one row that lose nothing need no look-up
    changed = classes.join(cuts.withColumnRenamed("cut_sig", "sig"), "sig", "left").where("copies > 1 or cut_n is not null").select("sig", "rep", "cut_n", "cut_sha", "cut_text")
    rows = whole.join(changed, "sig", "left")
    copy = (F.col("id") > F.col("rep")) & (F.col("n_words") >= size)
    own = F.coalesce(copy, F.lit(False))
    removed = F.when(own, F.col("n_words")).otherwise(F.coalesce("cut_n", F.lit(0)))
    sha = F.when(own, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.lower(F.hex(F.coalesce("cut_sha", "sha"))))
    name = (F.nullif(F.col("id"), F.lit(LAST)) + F.lit(shift)).alias(id_col)
    out = rows.select(name, "n_words", removed.cast("bigint").alias("n_removed"), sha.alias("kept_sha256"), *([F.when(own, F.lit("")).otherwise(F.col("cut_text")).alias("kept_text"), F.col("id").alias("_id"), F.col("text_key").alias("_key")] if kept_text else []))
    if kept_text:  # rows that lose nothing keep their own text
        words = F.array_join(F.regexp_extract_all("_text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), " ")
        out = out.join(_rows(docs, id_col, text_col, shift).distinct(), ["_id", "_key"]).withColumn("kept_text", F.coalesce("kept_text", words, F.lit(""))).drop("_id", "_key", "_text")
    return out

"""Phrase collocations: generalised suffix automata of shards, counts reduced globally.

A shard is a run of whole texts. Its automaton is bounded in depth: a state is a string
of words that ends somewhere, the suffix link drops its first word, and a state's endpos
count is what ends there itself plus the counts of the states that link to it. States are
built from the longest down, level by level, so a level costs one sort of distinct
strings. Symbols are (language, word), numbered exactly within the shard; nothing is told
by hashes. A shard gives one row a distinct string, which Spark sums over all shards.

Three rounds keep the strings few: words; pairs of frequent words; strings of three words
and more whose pairs are all frequent. A string can only be frequent if its parts are.
What is frequent reaches the next round as a Bloom filter of a fixed number of bits: if
the filter fills up, more strings are counted than need be, and results stay the same.

Among the globally frequent phrases, each link (drop the first word) and each prefix (drop
the last) with an equal count marks the shorter one as subsumed: a longer phrase with the
count of a phrase inside it passes that count on to every phrase between the two.

Defined results: null and empty texts have no words; a null lang counts as ``und`` (and
joins rows that say so); repeated rows and ids count again; a language without candidates
has no rows; ties go as the contract says (score, count, phrase in UTF-8 order), of equal
cuts the first; an empty table gives an empty result; other columns are ignored. One text
is held whole by the task that reads it. Counts are exact; products are decimals of 38
digits, enough up to 10**15 words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbarium.llm.common import Words, lowered, materialize, mix, runs_of, span_keys

#: What parts pieces (ASCII and line ends), and what parts words besides.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
NO_LANG = "und"
COUNTS = "lang string, size int, phrase string, a bigint"
_BITS = 26
_IN_PIECE = np.ones(256, dtype=bool)
_IN_PIECE[list(BREAKS + BLANKS)] = False
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(BREAKS)] = True


class Automaton:
    """The states of ``low`` to ``depth`` words of the strings that end at ``ends``; the
    string that ends at position p may reach back ``reach[p]`` words, itself included.

    ``levels[d]``: (a position where each state of d words ends, its endpos count, the
    number of the state of d - 1 words that its suffix link names)."""

    def __init__(self, symbols: np.ndarray, reach: np.ndarray, depth: int, low: int = 1):
        n = int(symbols.max()) + 1 if len(symbols) else 1
        reach = np.minimum(reach, depth)
        longest = reach.copy()  # of the strings that go on from a position
        for _ in range(depth - 1):
            longest[:-1] = np.maximum(longest[:-1], np.where(reach[1:] > 1, longest[1:], 0))
        # the number of the string of d words that ends at a position, by its first d - 1 words and the last
        number = [np.zeros(0, dtype=np.int32), symbols.astype(np.int32)]
        for d in range(2, depth + 1):
            pair = np.full(len(symbols), -1, dtype=np.int32)
            at = np.flatnonzero((reach >= d) & (longest >= low))
            pair[at] = np.unique(number[d - 1][at - 1].astype(np.int64) * n + symbols[at], return_inverse=True)[1]
            number.append(pair)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        ends, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for d in range(depth, low - 1, -1):
            own = np.flatnonzero(reach == d)  # nothing longer ends here
            ends = np.concatenate((ends, own))
            counts = np.concatenate((counts, np.ones(len(own), dtype=np.int64)))
            _, first, state = np.unique(number[d][ends], return_index=True, return_inverse=True)
            if d < depth:  # the links of the level above lead here
                at, count, _ = self.levels[d + 1]
                self.levels[d + 1] = at, count, state[: len(at)]
            ends, counts = ends[first], np.bincount(state, weights=counts, minlength=len(first)).astype(np.int64)
            self.levels[d] = ends, counts, np.zeros(len(ends), dtype=np.int64)


class Shard:
    """The words of a run of texts as symbols, with the pieces that they stand in."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, langs: np.ndarray):
        words = Words(lowered(buf), bounds, range(len(bounds) - 1), keyed=False, table=_IN_PIECE)
        self.buf, self.starts, self.ends = words.buf, words.starts, words.ends
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(words.first))
        breaks = np.searchsorted(np.flatnonzero(_BREAK[words.buf]), self.starts)
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1])
        self.new, self.lang = new, langs[row] if len(row) else np.empty(0, dtype=np.int64)
        plain = self.buf[_IN_PIECE[self.buf]]
        ends = np.concatenate(([0], np.cumsum(self.ends - self.starts)))
        coded = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(plain)]).dictionary_encode()
        word = coded.indices.to_numpy().astype(np.int64)
        _, self.first, self.symbols = np.unique(self.lang * max(1, len(coded.dictionary)) + word, return_index=True, return_inverse=True)

    def keys(self, salts: np.ndarray) -> np.ndarray:
        """A 64-bit key of each symbol for the filter: its word and its language's salt."""
        out = np.empty(len(self.first), dtype=np.uint64)
        order = np.argsort(self.first)
        at = self.first[order]
        out[order] = mix(span_keys(self.buf, self.starts[at], self.ends[at]) + salts[self.lang[at]])
        return out

    def reach(self, joined: np.ndarray) -> np.ndarray:
        """How many words back a string may reach from each position, where ``joined``
        says whether a position's word may follow the one before."""
        at = np.arange(len(joined))
        return at - np.maximum.accumulate(np.where(joined, 0, at)) + 1 if len(at) else at

    def texts(self, ends: np.ndarray, size: int) -> pa.Array:
        """The strings of ``size`` words that end at the given words, joined by spaces."""
        firsts = ends - size + 1
        parts = np.stack([firsts + k for k in range(size)], axis=1).ravel()
        lengths = (self.ends - self.starts)[parts] + 1
        lengths[size - 1 :: size] -= 1
        stop = np.cumsum(lengths)
        start = stop - lengths
        out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, dtype=np.uint8)
        own = (self.ends - self.starts)[parts]
        inner = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        out[np.repeat(start, own) + inner] = self.buf[np.repeat(self.starts[parts], own) + inner]
        offsets = np.concatenate(([0], stop[size - 1 :: size])).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _salts(langs: pa.Array) -> np.ndarray:
    """A number of each language, from its name alone."""
    return np.array([int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") for name in langs.to_pylist()], dtype=np.uint64)


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key."""
    mask = np.uint64((1 << _BITS) - 1)
    return (keys & mask).astype(np.int64), ((keys >> np.uint64(32)) & mask).astype(np.int64)


def _holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), dtype=bool)
    for slot in _slots(keys):
        out &= (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
    return out


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def shards(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[Shard, pa.Array]]:
    """The shards of a batch of (lang, text), and the names of their languages."""
    coded = batch.column(0).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    for buf, bounds, rows in runs_of(batch.column(1), limit):
        yield Shard(buf, bounds, codes[rows.start : rows.stop]), coded.dictionary


def _filter(frequent: DataFrame) -> bytes:
    """The Bloom filter of a table of frequent words or pairs, summed on executors:
    2**_BITS bits whatever the table's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (_BITS - 6), dtype=np.uint64)
        for batch in batches:
            for shard, langs in shards(batch, 1 << 20):
                keys = shard.keys(_salts(langs))[shard.symbols]
                last = np.flatnonzero(~shard.new)
                at = np.flatnonzero(np.append(shard.new[1:], True) & shard.new)  # rows of one word
                keys = np.concatenate((keys[at], _pair(keys[last - 1], keys[last])))
                for slot in _slots(keys):
                    np.bitwise_or.at(bits, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
        on = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(bits[on].view(np.int64))], ["place", "bits"])

    got = frequent.select("lang", "phrase").mapInArrow(run, "place int, bits bigint").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (_BITS - 6), dtype=np.int64)
    out[got.column("place").to_numpy()] = got.column("bits").to_numpy()
    return out.tobytes()


def _round(docs: DataFrame, low: int, depth: int, known: bytes | None, limit: int) -> DataFrame:
    """Counts of the strings of ``low`` to ``depth`` words of each shard. ``known``
    filters what a string is made of: words for pairs, pairs for longer strings.
    Rows of size 0 have the number of all words of a language."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(known) if known else None  # 2**_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, dtype=np.uint8) if shared else None
        for batch in batches:
            for shard, langs in shards(batch, limit):
                joined = ~shard.new
                if low == 2:
                    good = _holds(bits, shard.keys(_salts(langs)))[shard.symbols]
                    joined[1:] &= good[1:] & good[:-1]
                elif low > 2:
                    keys = shard.keys(_salts(langs))
                    at = np.flatnonzero(joined)
                    joined[at] = _holds(bits, _pair(keys[shard.symbols[at - 1]], keys[shard.symbols[at]]))
                reach = shard.reach(joined)
                if low > 1:  # only words of strings that are long enough
                    inside = reach >= low
                    if not inside.any():
                        continue
                states = Automaton(shard.symbols, reach, depth, low)
                for size in range(low, depth + 1):
                    ends, counts, _ = states.levels[size]
                    for at in range(0, len(ends), 1 << 16):
                        part = ends[at : at + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([langs.take(pa.array(shard.lang[part])), pa.array(np.full(len(part), size, dtype=np.int32)), shard.texts(part, size), pa.array(counts[at : at + (1 << 16)])], ["lang", "size", "phrase", "a"])
                del states
                if low == 1:
                    total = np.bincount(shard.lang, minlength=len(langs))
                    yield pa.RecordBatch.from_arrays([langs, pa.array(np.zeros(len(langs), dtype=np.int32)), pa.array([""] * len(langs)), pa.array(total)], ["lang", "size", "phrase", "a"])

    return docs.mapInArrow(run, COUNTS).groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a"))


def counted(docs: DataFrame, least: int = 100, depth: int = 5, lang_col: str = "lang", text_col: str = "text", shard_bytes: int = 4 << 20) -> DataFrame:
    """(lang, size, phrase, a) of every phrase of up to ``depth`` words that occurs
    ``least`` times; the rows of size 0 have each language's number of words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    often = F.col("a") >= least
    words, _ = materialize(_round(rows, 1, 1, None, shard_bytes).where(often | (F.col("size") == 0)))
    found = words
    if depth > 1:
        pairs, _ = materialize(_round(rows, 2, 2, _filter(words.where("size = 1").where(often)), shard_bytes).where(often))
        found = found.unionAll(pairs)
    if depth > 2:
        longer, _ = materialize(_round(rows, 3, depth, _filter(pairs), shard_bytes).where(often))
        found = found.unionAll(longer)
    return found


def collocations(docs: DataFrame, least: int = 100, depth: int = 5, most: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``most`` best phrases."""
    found = counted(docs, least, depth, lang_col, text_col)
    grams = found.where("size > 0").select("lang", "phrase", "a")
    totals = found.where("size = 0").select("lang", F.col("a").alias("n"))
    candidates = found.where("size > 1")
    inner = candidates.where("size > 2").select("lang", F.explode(F.array(F.expr("substring(phrase, instr(phrase, ' ') + 1)"), F.expr("substring_index(phrase, ' ', size - 1)"))).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(inner, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
    cuts = cuts.join(grams.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"]).join(grams.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    whole = "decimal(19, 0)"
    score = F.expr(f"(cast(1000 * cast(a as {whole}) as decimal(19, 0)) * cast(n as {whole})) div (cast(l as {whole}) * cast(r as {whole}))")
    scored = cuts.join(totals, "lang").withColumn("cut", F.struct(score.alias("score"), "k", "l", "r"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # a language's first rows are among the first rows of its parts, so no task sorts a whole language
    parted = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    first = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

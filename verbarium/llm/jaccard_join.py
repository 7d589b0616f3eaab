"""N-gram Jaccard join: T-occurrence search with DivideSkip.

A text is the set of its distinct word n-grams (64-bit keys). Two texts link when
100 * |intersection| >= percent * |union|. The join finds the connected components of
all links between different texts, exactly:

1. Texts with equal sets are one class (a 128-bit key of the set).
2. Routing, by the pigeonhole: sets that link differ in at most k elements, k known
   from their size class. Cut into k + s segments of the key space, at least s segments
   of theirs are equal. At most 2 empty segments are allowed for (sets with more also
   route by their empty segments), so s - 2 = d + t equal ones are left. A segment that
   more than FREQUENT texts have is frequent; d frequent ones may be left out of each
   set. So either two sets share t rare segments, and become a pair for being counted
   often enough; or both have more than d frequent ones, and meet by those left over. A
   common line or passage gives a text few segments, which are left out. Map tasks keep
   FREQUENT + 1 rows a segment, so no task gets a frequent segment's rows.
3. Search groups are connected components of these pairs. In a group, each set
   asks the inverted index of the others: the short lists of its elements are merged,
   the longest ones only probed by binary search for candidates that can still reach
   the overlap T (DivideSkip); pairs already connected are skipped. Large groups are
   cut into blocks of bounded size, and every pair of blocks is searched, in rounds
   that send each set COPIES times on average, so that disk keeps to the sets' size.
4. The verified links give the components.

Defined results: null and empty texts (and texts without words) have no n-grams and
link with nothing; a text with fewer than n words is one n-gram; a row with a null id
gets its size and a null component; repeated rows are rows of one class; rows of one
id with different texts are judged each by its own text; an empty table gives an
empty result; other columns are ignored. Ids are whole numbers; others raise TypeError."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import PACKED, components, deal, drop, materialize, mix, packed_batches, per_partition, rolling, undeal, whole_numbers, width, words_of

_GRAM_BASE = 0xC2B2AE3D27D4EB4F
#: Texts of a segment that isn't frequent.
FREQUENT = 8
#: N-grams of the sets in one block of a large search group.
BLOCK = 300_000
#: How often a round of searches sends the sets on average.
COPIES = 3
#: Keys that a map task gathers before it combines and sends them; it holds some 15 numbers
#: of 8 bytes for each then.
GATHER = 1_000_000


def gram_sets(column: pa.Array, n: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram keys) of a text column."""
    for words in words_of(column, lower):
        grams = rolling(words.keys, n, _GRAM_BASE)
        for i, row in enumerate(words.rows):
            a, b = words.first[i], words.first[i + 1]
            if b - a >= n:
                yield row, np.unique(grams[a : b - n + 1])
            elif b > a:
                yield row, mix(rolling(words.keys[a:b], b - a, _GRAM_BASE) + np.uint64(b - a))
            else:
                yield row, np.empty(0, dtype=np.uint64)


def class_bounds(most: int, percent: int) -> np.ndarray:
    """Smallest sizes of the size classes: a link joins equal or neighbouring ones."""
    out = [1, 2]
    while out[-2] <= most:
        out.append(max(out[-1] + 1, (out[-1] - 1) * 100 // percent + 1))
    return np.array(out + [max(out[-1] + 1, (out[-1] - 1) * 100 // percent + 1)], dtype=np.int64)


def needed(tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(t, d) of the low bits of a key: rare segments that a pair must share, and
    frequent ones that a set may leave out."""
    tag = tag.astype(np.int64)
    return tag >> 1 & 3, tag >> 3 & 7


def cut(least: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, ...]:
    """(segments, e, d, t) for sets of at least so many n-grams that differ in at most k.
    Small sets, whose segments would get too small, have d = 0 and t = 1."""
    d, t = np.full(len(k), 4), np.full(len(k), 3)
    small = k + 12 > least / 2
    d[small], t[small] = 0, 1
    e = np.full(len(k), 2)
    for _ in range(4):
        m = k + e + d + t
        empty = m * np.exp(-least / m)
        e = np.where(small, 2, np.ceil(empty + 3 * np.sqrt(empty)).astype(np.int64) + 1)
    return k + e + d + t, e, d, t


def route_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the set) of the segments of each set. The low six bits of a key
    tell its group's parity, t and d."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not len(sizes) or not sizes.any():
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    bounds = class_bounds(int(sizes.max()), percent)
    of_class = np.searchsorted(bounds, sizes, side="right") - 1
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    high, mixed = flat >> np.uint64(32), mix(flat)
    keys, owners = [], []
    for lower_class in (of_class, of_class - 1):
        group = np.maximum(lower_class, 0)
        k = ((bounds[group + 1] - 1) + (bounds[np.minimum(group + 2, len(bounds) - 1)] - 1)) * (100 - percent) // (100 + percent)
        used = (lower_class >= 0) & (sizes > 0) & (k > 0)
        m, e, d, t = cut(bounds[group], k)
        tag = ((group & 1) | t << 1 | d << 3).astype(np.uint64)
        m = m.astype(np.uint64)
        on = used[owner]
        who = owner[on]
        if not len(who):
            continue
        segment = (high[on] * m[who]) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (segment[1:] != segment[:-1]))))
        sums = np.add.reduceat(mixed[on], starts)
        who, segment = who[starts], segment[starts]
        place = segment * np.uint64(0x9E3779B97F4A7C15) + group[who].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        keys.append(mix(mix(sums) + place) & ~np.uint64(63) | tag[who])
        owners.append(who)
        filled = np.bincount(who, minlength=len(sets))
        first = np.concatenate(([0], np.cumsum(filled)))
        for i in np.flatnonzero(used & (m.astype(np.int64) - filled > e)):
            rest = np.setdiff1d(np.arange(m[i], dtype=np.uint64), segment[first[i] : first[i + 1]])
            keys.append(mix(mix(rest * np.uint64(0x9E3779B97F4A7C15) + np.uint64(group[i])) ^ np.uint64(0x5851F42D4C957F2D)) & ~np.uint64(63) | tag[i])
            owners.append(np.full(len(rest), i))
    if not keys:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def by_key(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, id) rows in order; the place of each in its key's rows, and their
    number."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    if not len(keys):
        return keys, ids, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    own = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])))
    keys, ids = keys[own], ids[own]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    count = np.diff(np.append(first, len(keys)))
    return keys, ids, np.arange(len(keys)) - np.repeat(first, count), np.repeat(count, count)


def stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once with its smallest id, and the distinct (id, smallest id) pairs."""
    keys, ids, place, _ = by_key(keys, ids)
    least = ids[np.arange(len(ids)) - place]
    apart = place > 0
    edges = np.unique(np.column_stack((ids[apart], least[apart])), axis=0) if apart.any() else np.empty((0, 2), dtype=np.int64)
    return keys[~apart], ids[~apart], edges


def rare_pairs(keys: np.ndarray, ids: np.ndarray, place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rows (id, id, tag, number of rare keys) of the pairs that share rare keys."""
    found = []
    for back in range(1, FREQUENT):
        later = np.flatnonzero((place >= back) & (count <= FREQUENT))
        if len(later):
            found.append(np.column_stack((ids[later], ids[later - back], (keys[later] & np.uint64(63)).astype(np.int64))))
    if not found:
        return np.empty((0, 4), dtype=np.int64)
    pairs, times = np.unique(np.concatenate(found), axis=0, return_counts=True)
    return np.column_stack((pairs, times))


FOUND = "kind int, a bigint, n bigint, data binary"


def _found(kind: int, a: np.ndarray, n: np.ndarray, data: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Kind 0: a document, the size of its set and its key. Kinds 1 and 2: packed pairs
    that share rare segments (ids, tag and number), and packed frequent segments of
    documents (id and key), for partition ``n``."""
    for at in range(0, len(n), 50_000):
        part = slice(at, at + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n[part]), kind, dtype=np.int32)), pa.array(a[part]), pa.array(n[part]), pa.array(data[part], pa.binary())], ["kind", "a", "n", "data"])


def _packed(kind: int, blobs: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for pid, blob in blobs:
        yield from _found(kind, np.array([0]), np.array([pid]), [blob])


def routed(docs: DataFrame, n: int, percent: int, lower: bool, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Documents, pairs and frequent segments: _found."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def out(kind: bytes, owner: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
        return ((p, kind + blob) for p, blob in deal(owner, *columns))

    def send(keys: list, ids: list) -> Iterator[tuple[int, bytes]]:
        both = np.concatenate(keys), np.concatenate(ids)
        keys.clear()
        ids.clear()
        key, own, place, count = by_key(*both)
        del both
        sent = place <= FREQUENT
        yield from out(b"K", (key[sent] % np.uint64(parts)).astype(np.int64), key[sent], own[sent])
        often = count > FREQUENT
        yield from out(b"F", own[often] % parts, key[often], own[often])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            numbers: list[int] = []
            sets: list[np.ndarray] = []
            size = 0
            for row, grams in gram_sets(batch.column(1), n, lower):
                numbers.append(row)
                sets.append(grams)
                size += len(grams)
                if size > 400_000 or row == batch.num_rows - 1:
                    mine = own[numbers]
                    sigs = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                    yield from out(b"D", mine % parts, mine, np.array([len(s) for s in sets], dtype=np.int64), np.frombuffer(b"".join(sigs), dtype="V16"))
                    least: dict[bytes, int] = {}
                    for i, sig in enumerate(sigs):  # equal sets route once
                        if sig not in least or mine[i] < mine[least[sig]]:
                            least[sig] = i
                    chosen = sorted(least.values())
                    got, who = route_keys([sets[i] for i in chosen], percent)
                    keys.append(got)
                    ids.append(mine[chosen][who])
                    held += len(got)
                    numbers, sets, size = [], [], 0
                if held > GATHER:
                    yield from send(keys, ids)
                    held = 0
        if held:
            yield from send(keys, ids)

    def work(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        kinds = {k: [memoryview(b)[1:] for b in blobs if b[:1] == k] for k in (b"D", b"K", b"F")}
        ids, sizes, sig = undeal(kinds[b"D"], "i8", "i8", "V16")
        yield from _found(0, ids, sizes, [x.tobytes() for x in sig])
        key, own, place, count = by_key(*undeal(kinds[b"K"], "u8", "i8"))
        pairs = rare_pairs(key, own, place, count)
        yield from _packed(1, deal((pairs[:, 0] ^ pairs[:, 1]) % parts, *pairs.T))
        more_key, more_own = undeal(kinds[b"F"], "u8", "i8")
        often = count > FREQUENT
        key, own = np.concatenate((key[often], more_key)), np.concatenate((own[often], more_own))
        yield from _packed(2, deal(own % parts, own, key))

    packed = rows.mapInArrow(lambda batches: packed_batches(mapped(batches)), PACKED)
    return per_partition(packed, parts, work, FOUND)


def met(found: DataFrame, parts: int) -> DataFrame:
    """(a, b): pairs of documents that may link, or are connected by such pairs."""

    def tally(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        a, b, tag, times = undeal(blobs, "i8", "i8", "i8", "i8")
        order = np.lexsort((tag, b, a))
        a, b, tag, times = a[order], b[order], tag[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (tag[1:] != tag[:-1]))))
        enough = np.add.reduceat(times, first) >= needed(tag[first])[0]
        pairs = np.unique(np.column_stack((a[first], b[first]))[enough], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

    def left_over(blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """Of each set and group, the frequent keys but the d largest."""
        own, key = undeal(blobs, "i8", "u8")
        key, own, _, _ = by_key(key, own)
        side = (key & np.uint64(1)).astype(np.int64)
        order = np.lexsort((key, side, own))
        key, own, side = key[order], own[order], side[order]
        last = np.flatnonzero(np.concatenate(((own[1:] != own[:-1]) | (side[1:] != side[:-1]), [True])))
        behind = last[np.searchsorted(last, np.arange(len(key)))] - np.arange(len(key))
        kept = behind >= needed(key & np.uint64(63))[1]
        key, own, edges = stars(key[kept], own[kept])
        for p, blob in deal((key % np.uint64(parts)).astype(np.int64), key, own):
            yield p, b"K" + blob
        for p, blob in deal(edges[:, 0] % parts, edges[:, 0], edges[:, 1]):
            yield p, b"E" + blob

    def meet(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        _, _, edges = stars(*undeal([memoryview(b)[1:] for b in blobs if b[:1] == b"K"], "u8", "i8"))
        more = np.column_stack(undeal([memoryview(b)[1:] for b in blobs if b[:1] == b"E"], "i8", "i8"))
        edges = np.unique(np.concatenate((edges, more)), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, 0])), pa.array(np.ascontiguousarray(edges[:, 1]))], ["a", "b"])

    packed = {k: found.where(F.col("kind") == k).select(F.col("n").cast("int").alias("pid"), F.col("data").alias("blob")) for k in (1, 2)}
    often = per_partition(packed[2], parts, lambda blobs: packed_batches(left_over(blobs)), PACKED)
    return per_partition(packed[1], parts, tally, "a bigint, b bigint").unionByName(per_partition(often, parts, meet, "a bigint, b bigint"))


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


def t_occurrence(sets: list[np.ndarray], percent: int, queries: range | None = None) -> Iterator[tuple[int, int]]:
    """Links that connect what isn't connected yet. Without ``queries`` every set asks
    those before it; with them, these sets ask those before the range."""
    n = len(sets)
    queries_from = queries.start if queries is not None else 0
    indexed = sets[:queries_from] if queries is not None else sets
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(indexed)
    who = np.repeat(np.arange(len(indexed)), sizes[: len(indexed)])
    order = np.lexsort((who, flat))
    flat, who = flat[order], who[order]
    elements, starts = np.unique(flat, return_index=True)
    starts = np.append(starts, len(flat))
    # a posting is (number of its list, number of the set) in one integer: one binary search probes any list
    postings = (np.repeat(np.arange(len(elements)), np.diff(starts)) << 32) | who
    forest = Forest(n)
    for y in queries if queries is not None else range(1, n):
        own = sets[y]
        rank = np.searchsorted(elements, own)
        rank = np.minimum(rank, len(elements) - 1)
        rank = rank[elements[rank] == own]
        need = -(-percent * len(own) // 100)
        if len(rank) < need:
            continue
        lengths = starts[rank + 1] - starts[rank]
        order = np.argsort(lengths, kind="stable")
        rank, lengths = rank[order], lengths[order]
        skip = min(need - 1, int(need / (0.0085 * math.log2(max(2, lengths[-1])) + 1)))
        short, long = rank[: len(rank) - skip], rank[len(rank) - skip :]
        limit = y if queries is None else queries_from
        for x, count in _merged([who[starts[r] : starts[r + 1]] for r in short], limit):
            if count < need - skip or 100 * min(sizes[x], sizes[y]) < percent * max(sizes[x], sizes[y]) or forest.root(x) == forest.root(y):
                continue
            probe = (long << 32) | x
            at = np.minimum(np.searchsorted(postings, probe), len(postings) - 1)
            common = count + int((postings[at] == probe).sum())
            if 100 * common >= percent * (int(sizes[x]) + int(sizes[y]) - common):
                forest.join(x, y)
                yield x, y


def _merged(lists: list[np.ndarray], limit: int) -> Iterator[tuple[int, int]]:
    """(set, occurrences) over sorted lists, sets below the limit: a merge by a heap, or
    of many postings by numpy's stable sort, which merges the sorted runs that it finds."""
    if sum(map(len, lists)) > 512:
        sets = np.sort(np.concatenate(lists), kind="stable")
        first = np.flatnonzero(np.concatenate(([True], sets[1:] != sets[:-1])))
        counts = np.diff(np.append(first, len(sets)))
        first = first[: np.searchsorted(sets[first], limit)]
        yield from zip(sets[first].tolist(), counts[: len(first)].tolist(), strict=True)
        return
    current, count = -1, 0
    for x in heapq.merge(*[part.tolist() for part in lists]):
        if x >= limit:
            break
        if x != current:
            if count:
                yield current, count
            current, count = x, 0
        count += 1
    if count:
        yield current, count


def searched(docs: DataFrame, work: DataFrame, n: int, percent: int, lower: bool, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between the sets of each search group. ``work``: group, rep, size
    and sig of each distinct set."""
    totals = work.groupBy("group").agg(F.sum("size").alias("total"))
    work = work.join(totals, "group").withColumn("blocks", F.ceil(F.col("total") / BLOCK).cast("bigint"))
    work = work.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    # both sides grow with the input: a merge join at every size
    rows = docs.select(F.col(id_col).cast("bigint").alias("rep"), F.col(text_col).cast("string").alias("_text")).hint("merge").join(work.drop("total", "size"), "rep")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            expected, at = batch.column(names.index("sig")), []
            blobs = []
            for row, grams in gram_sets(batch.column(names.index("_text")), n, lower):
                if hashlib.blake2b(grams, digest_size=16).digest() == expected[row].as_py():
                    at.append(row)
                    blobs.append(grams.tobytes())
                if len(blobs) == 500 or (blobs and row == batch.num_rows - 1):
                    kept = batch.select(["rep", "group", "blocks", "block"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(blobs, pa.binary())], [*kept.schema.names, "grams"])
                    at, blobs = [], []

    rows, path = materialize(rows.mapInArrow(sets, "rep bigint, group bigint, blocks bigint, block bigint, grams binary").dropDuplicates(["rep", "group"]))
    sent = rows.agg(F.sum(F.length("grams").cast("double")), F.sum(F.length("grams").cast("double") * F.col("blocks"))).first()
    rounds = math.ceil(sent[1] / (COPIES * sent[0])) if sent[0] else 1

    def pairs(number: int) -> DataFrame:
        """The sets of the pairs of blocks of a round."""
        of = lambda o: F.pmod(F.xxhash64("group", F.least("block", o), F.greatest("block", o)), F.lit(rounds)) == number
        every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
        out = rows.withColumn("other", F.explode(F.filter(every, of) if rounds > 1 else every))
        return out.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "grams")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        current = None

        def of_pair() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: x[:2])
            reps, grams = [x[1] for x in held], [x[2] for x in held]
            i, j = current[1:]
            first = sum(x[0] == i for x in held)
            if len(held) > 1 and (i == j or 0 < first < len(held)):
                found = list(t_occurrence(grams, percent, None if i == j else range(first, len(held))))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([reps[x] for x, _ in found], pa.int64()), pa.array([reps[y] for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:5]]
            for g, i, j, block, rep, grams in zip(*columns, batch.column(5), strict=True):
                if (g, i, j) != current and held:
                    yield from of_pair()
                    held = []
                current = (g, i, j)
                held.append((block, rep, np.frombuffer(grams.as_py(), dtype=np.uint64)))
        if held:
            yield from of_pair()

    parts, found = max(width(work, 8), width(rows, 8)), None
    for number in range(rounds):
        links, _ = materialize(pairs(number).repartition(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(search, "a bigint, b bigint"))
        found = links if found is None else found.unionByName(links)
    drop(docs.sparkSession, path)
    return found


def similar(docs: DataFrame, n: int = 5, percent: int = 80, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles (size of its set) and component_id (smallest id that links reach,
    itself included) of every row."""
    whole_numbers(docs, id_col, "jaccard_join")
    spark = docs.sparkSession
    parts = width(docs.select(id_col, text_col), 8)
    found, _ = materialize(routed(docs, n, percent, lower, id_col, text_col, parts))
    whole = found.where("kind = 0").select(F.col("a").alias("id"), F.col("n").alias("size"), F.col("data").alias("sig"))
    sets = whole.where("size > 0")
    classes, _ = materialize(sets.groupBy("sig").agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.count("*").alias("copies")))
    groups = components(met(found, parts))
    work = classes.join(groups, classes["rep"] == groups["node"]).select(F.col("component").alias("group"), "rep", "size", "sig")
    several = work.groupBy("group").agg(F.count("*").alias("_sets")).where("_sets > 1").select("group")
    work, work_path = materialize(work.join(several, "group"))
    links = components(searched(docs, work, n, percent, lower, id_col, text_col))
    drop(spark, work_path)
    ranked = classes.where("copies > 1").select("sig", "rep")
    # most classes have one row and need no look-up; rows of large classes are what AQE splits
    rows = sets.join(ranked, "sig", "left").select("id", "size", F.coalesce("rep", "id").alias("rep"))
    rows = rows.join(links, rows["rep"] == links["node"], "left").select("id", "size", F.coalesce("component", "rep").alias("component_id"))
    empty = whole.where("size = 0").select("id", "size", F.col("id").alias("component_id"))
    return rows.unionByName(empty).unionByName(_without_id(docs, n, lower, id_col, text_col)).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def _without_id(docs: DataFrame, n: int, lower: bool, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(s) for _, s in gram_sets(batch.column(0), n, lower)]
            nulls = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([nulls, pa.array(sizes, pa.int64()), nulls], ["id", "size", "component_id"])

    return docs.where(F.col(id_col).isNull()).select(F.col(text_col).cast("string")).mapInArrow(run, "id bigint, size bigint, component_id bigint")

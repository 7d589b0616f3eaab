"""Tokens, vocabularies, co-occurrence and PPMI (survey M01-M09, A10-A14, W03-W06)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verbarium.functions import text as T
from verbarium.functions import vector as V
from verbarium.operators import accumulate
from verbarium.session import shared_folder, shuffles_released


def sentence_table(docs: DataFrame, text: str = "content", key: str = "doc_id", lowercase: bool = True, remove_accents: bool = True) -> DataFrame:
    """(key, sid, tokens) of every sentence, empty ones too."""
    whole, tokens = T.preprocess(F.col(text), lowercase, remove_accents), T.folded_tokens if remove_accents else T.tokens
    return docs.select(key, F.posexplode(T.sentences(whole)).alias("sid", "sentence")).select(key, "sid", tokens(F.col("sentence")).alias("tokens"))


def vocabulary_of(docs: DataFrame, text: str = "content", min_count: int = 1, max_count: int | None = None, lowercase: bool = True, remove_accents: bool = True, least_tokens: int = 1) -> DataFrame:
    """M07, M02 of whole texts; folded words are counted inside tasks first."""
    if remove_accents:
        return _most_frequent(accumulate.word_counts(docs, text, lowercase, least_tokens), min_count, max_count)
    return vocabulary(sentence_table(docs.withColumn("_row", F.monotonically_increasing_id()), text, "_row", lowercase, remove_accents), min_count, max_count, least_tokens)


def words(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sid, pos, w)."""
    return sentences.select(key, "sid", F.posexplode("tokens").alias("pos", "w"))


def vocabulary(sentences: DataFrame, min_count: int = 1, max_count: int | None = None, least_tokens: int = 1) -> DataFrame:
    """Words and counts, most frequent first, ties in alphabetical order. The
    cap on the number of words comes before the least count. ``least_tokens``: 2 leaves
    out sentences of one word, as the SVD model does."""
    return _most_frequent(accumulate.word_counts(sentences.where(F.size("tokens") >= least_tokens), "tokens"), min_count, max_count)


def _most_frequent(counts: DataFrame, min_count: int, max_count: int | None) -> DataFrame:
    if max_count is not None:
        counts = counts.orderBy(F.desc("count"), "word").limit(max_count)
    return counts.where(F.col("count") >= min_count)


def with_ids(vocab: DataFrame, order: str = "frequency") -> DataFrame:
    """1-based rank by frequency, or W06: 0-based alphabetical rank. Words are ranked
    among those of one count and beginning, after the sums of what comes before."""
    by = ["count"] if order == "frequency" else []
    rows = vocab.withColumn("_p", F.substring("word", 1, 2))
    sums = rows.groupBy(*by, "_p").agg(F.count("*").alias("_n"))
    before = (F.sum("_n").over(Window.partitionBy(*by).orderBy("_p")) - F.col("_n")).alias("_before")
    parts = sums.select(*by, "_p", before)
    if by:
        counts = sums.groupBy("count").agg(F.sum("_n").alias("_n"))
        above = counts.select("count", (F.sum("_n").over(Window.orderBy(F.desc("count"))) - F.col("_n")).alias("_above"))
        parts = parts.join(above, "count").select("count", "_p", (F.col("_before") + F.col("_above")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_p").orderBy("word"))
    rank = rows.withColumn("_r", own).join(parts, [*by, "_p"]).withColumn("id", (F.col("_before") + F.col("_r") - (0 if by else 1)).cast("int"))
    return rank.select(*vocab.columns, "id")


def placed(sentences: DataFrame, vocab: DataFrame, key: str = "doc_id", subsample: float = 0.0, seed: int = 1, numbered: bool = True) -> DataFrame:
    """(key, sid, pos, id) of the words of the vocabulary; positions count what
    is left, or with ``numbered`` off are those in the sentence. ``subsample`` drops frequent words first (C45), by a hash in place of
    chance."""
    rows = words(sentences, key).join(vocab.select(F.col("word").alias("w"), "id", "count"), "w")
    if subsample > 0:
        total = vocab.agg(F.sum("count").cast("double").alias("n"))
        rows = rows.crossJoin(F.broadcast(total))
        rows = rows.where(V.coin(seed, F.col(key), F.col("sid"), F.col("pos")) >= V.drop_chance(F.col("count"), subsample, F.col("n")))
    if not numbered:
        return rows.select(key, "sid", "id", "pos")
    along = Window.partitionBy(key, "sid").orderBy("pos")
    return rows.select(key, "sid", "id", F.row_number().over(along).alias("pos"))


def pairs(rows: DataFrame, window: int, key: str = "doc_id", dynamic: bool = False, seed: int = 1) -> DataFrame:
    """Ordered (w, c, d) of words at most ``window`` places apart in a sentence, of
    rows as ``placed`` gives them (places without gaps). Each word looks ahead within
    its sentence and gives a pair either way. ``dynamic`` (W04): each centre has its own
    width of 1 to ``window``."""
    along = Window.partitionBy(key, "sid").orderBy("pos")
    rows = rows.where(F.col(key).isNotNull())
    ahead = [F.lead("id", d).over(along).alias(f"_{d}") for d in range(1, window + 1)]
    if dynamic:
        rows = rows.withColumn("_w0", 1 + F.pmod(V.draw(seed, F.col(key), F.col("sid"), F.col("pos")), F.lit(window)))
        ahead += ["_w0", *[F.lead("_w0", d).over(along).alias(f"_w{d}") for d in range(1, window + 1)]]
    both = []
    for d in range(1, window + 1):
        for w, c, width in (("id", f"_{d}", "_w0"), (f"_{d}", "id", f"_w{d}")):
            near = F.col(f"_{d}").isNotNull() & (F.col(width) >= d if dynamic else F.lit(True))
            both.append(F.when(near, F.struct(F.col(w).alias("w"), F.col(c).alias("c"), F.lit(d).alias("d"))))
    return rows.select("id", *ahead).select(F.explode(F.array_compact(F.array(*both))).alias("p")).select("p.w", "p.c", "p.d")


def cooccurrence(pairs_: DataFrame, weighting: str = "count", window: int | None = None) -> DataFrame:
    """A11 (count), A12 (sum of 1/distance), or the expected weight under dynamic
    windows, (window - d + 1) / window."""
    weight = {"count": F.count("*").cast("double"), "inverse": F.sum(1.0 / F.col("d"))}
    weight["expected"] = F.sum((F.lit(window or 1) - F.col("d") + 1) / F.lit(float(window or 1)))
    return pairs_.groupBy("w", "c").agg(weight[weighting].alias("x"))


def counted(rows: DataFrame, window: int, weighting: str = "count", key: str = "doc_id") -> DataFrame:
    """What ``cooccurrence(pairs(...))`` gives for fixed windows, at half the work: pairs
    are counted one way, and the sums mirrored. Positions may have gaps."""
    along = Window.partitionBy(key, "sid").orderBy("pos")
    ahead = rows.where(F.col(key).isNotNull()).select("id", *[F.lead("id", d).over(along).alias(f"_{d}") for d in range(1, window + 1)])
    each = [F.when(F.col(f"_{d}").isNotNull(), F.struct(F.least("id", f"_{d}").alias("w"), F.greatest("id", f"_{d}").alias("c"), F.lit(d).alias("d"))) for d in range(1, window + 1)]
    half = cooccurrence(ahead.select(F.explode(F.array_compact(F.array(*each))).alias("p")).select("p.*"), weighting, window)
    both = F.when(F.col("w") == F.col("c"), F.array(F.struct("w", "c", (F.col("x") * 2).alias("x")))).otherwise(F.array(F.struct("w", "c", "x"), F.struct(F.col("c").alias("w"), F.col("w").alias("c"), "x")))
    return half.select(F.explode(both).alias("p")).select("p.*")


def cells_of(docs: DataFrame, vocab: DataFrame, window: int, weighting: str = "count", text: str = "text", mirror: bool = True) -> DataFrame:
    """M03, M04, M08 of whole texts: pairs are summed inside tasks; a vocabulary too large
    to be broadcast is joined, word by word. Not ``mirror``: one way of each pair alone."""
    summed = accumulate.cells(docs, vocab, window, weighting, text, mirror=mirror)
    if summed is not None:
        return summed
    rows = sentence_table(docs.withColumn("_row", F.monotonically_increasing_id()), text, "_row")
    both = counted(placed(rows, vocab, "_row", numbered=False), window, weighting, "_row")
    return both if mirror else both.where("w <= c")


def dynamic_cells(rows: DataFrame, vocab: DataFrame, window: int, column: str = "text", key: str = "doc_id", subsample: float = 0.0, seed: int = 1) -> DataFrame:
    """(w, c, x) counts under a width of its own for each centre, of texts or of token
    lists (key, sid, tokens); summed inside tasks, or joined as in ``cells_of``."""
    summed = accumulate.cells(rows, vocab, window, "count", column, dynamic=True, key=key, subsample=subsample, seed=seed)
    if summed is not None:
        return summed
    sentences = rows if column == "tokens" else sentence_table(rows, column, key)
    return cooccurrence(pairs(placed(sentences, vocab, key, subsample, seed), window, key, dynamic=True, seed=seed))


def subsampled_counts(docs: DataFrame, vocab: DataFrame, subsample: float, text: str = "text", key: str = "doc_id", seed: int = 1) -> DataFrame:
    """(id, kept), the uses of each word that are left."""
    summed = accumulate.kept_counts(docs, vocab, subsample, text, key, seed)
    if summed is not None:
        return summed
    rows = placed(sentence_table(docs, text, key), vocab, key, subsample, seed, numbered=False)
    return rows.groupBy(F.col("id").cast("bigint").alias("id")).agg(F.count("*").alias("kept"))


def marginals(cells: DataFrame) -> DataFrame:
    """Row and column sums by word; every word of either side."""
    rows = cells.groupBy(F.col("w").alias("id")).agg(F.sum("x").alias("row_sum"))
    cols = cells.groupBy(F.col("c").alias("id")).agg(F.sum("x").alias("col_sum"))
    return rows.join(cols, "id", "full").select("id", F.coalesce("row_sum", F.lit(0.0)).alias("row_sum"), F.coalesce("col_sum", F.lit(0.0)).alias("col_sum"))


def ppmi(cells: DataFrame, smoothing: float = 0.75, mirrored: bool = True) -> DataFrame:
    """The positive cells of the smoothed PPMI matrix. Not ``mirrored``: the cells are
    one way of each pair, and the other has the same sum."""
    path = shared_folder(cells.sparkSession)
    with shuffles_released(cells.sparkSession):
        cells.write.option("compression", "zstd").parquet(path)  # read twice, or three times
    cells = cells.sparkSession.read.schema(cells.schema).parquet(path)
    if {kind for _, kind in cells.dtypes[:2]} == {"int"}:
        weighed = _weighed(cells, smoothing, mirrored)
        if weighed is not None:
            return weighed
    if not mirrored:
        cells = cells.unionByName(cells.where("w <> c").select(F.col("c").alias("w"), F.col("w").alias("c"), "x"))
    rows = cells.groupBy("w").agg(F.sum("x").alias("rw"))
    cols = cells.groupBy("c").agg(F.sum("x").alias("cc"))
    total = cols.agg(F.sum(F.pow("cc", F.lit(smoothing))).alias("total"))
    value = V.ppmi(F.col("x"), F.col("rw"), F.col("cc"), F.col("total"), smoothing)
    return cells.join(rows, "w").join(cols, "c").crossJoin(F.broadcast(total)).select("w", "c", value.alias("x")).where("x > 0")


def _weighed(cells: DataFrame, smoothing: float, mirrored: bool) -> DataFrame | None:
    """The positive PPMI cells: tasks sum what they read by word, the sums of all words are
    broadcast, and no cell is shuffled. None beyond accumulate.MOST_WORDS ids."""
    spark = cells.sparkSession

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2))
        for batch in batches:
            w, c, x = (column.to_numpy() for column in batch.columns)
            if len(x):
                most = int(max(w.max(), c.max())) + 1
                if most > len(held):
                    held = np.vstack((held, np.zeros((max(most, len(held) * 3 // 2) - len(held), 2))))
                other = w != c
                sides = ((w, 0, x), (c, 1, x)) if mirrored else ((w, 0, x), (c, 1, x), (c[other], 0, x[other]), (w[other], 1, x[other]))
                for ids, side, values in sides:
                    part = np.bincount(ids, values)
                    held[: len(part), side] += part
        at = np.flatnonzero(held.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at, 0]), pa.array(held[at, 1])], ["id", "rw", "cc"])

    words = cells.select("w", "c", "x").mapInArrow(sums, "id int, rw double, cc double").groupBy("id").agg(F.sum("rw").alias("rw"), F.sum("cc").alias("cc"))
    got = words.limit(accumulate.MOST_WORDS + 1).toArrow()  # at most MOST_WORDS words
    ids = got.column("id").to_numpy()
    if len(ids) > accumulate.MOST_WORDS or ids.max(initial=0) > 4 * accumulate.MOST_WORDS:
        return None
    rw, cc = np.ones(ids.max(initial=0) + 1), np.ones(ids.max(initial=0) + 1)
    rw[ids] = got.column("rw").to_numpy()
    cc[ids] = got.column("cc").to_numpy() ** smoothing
    known = spark.sparkContext.broadcast((rw, cc, float(np.sum(cc[np.sort(ids)]))))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rw, cc, total = known.value
        for batch in batches:
            w, c, x = (column.to_numpy() for column in batch.columns)
            if not mirrored:
                other = w != c
                w, c, x = np.concatenate((w, c[other])), np.concatenate((c, w[other])), np.concatenate((x, x[other]))
            ratio = x * total / (rw[w] * cc[c])
            on = np.flatnonzero(ratio > 1)
            yield pa.RecordBatch.from_arrays([pa.array(w[on]), pa.array(c[on]), pa.array(np.log(ratio[on]))], ["w", "c", "x"])

    return cells.select("w", "c", "x").mapInArrow(weigh, "w int, c int, x double").where("x > 0")


#: Rows that a task holds to pack those of one partition together.
PACKED_ROWS = 1 << 19


def packed_rows(rows: DataFrame, part: str) -> DataFrame:
    """(part, blob): the rows of a partition that a task has at a time, without its number,
    as one compressed table; a fraction of what they take in a shuffle one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            owner = table.column(part).to_numpy()
            order, table = np.argsort(owner, kind="stable"), table.drop_columns([part])
            table, own = table.take(order), owner[order]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table.slice(a, b - a).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([own[a]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], [part, "blob"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= PACKED_ROWS:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    return rows.mapInArrow(run, f"{part} int, blob binary")


def unpacked_rows(sent: DataFrame, schema: StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                yield from pa.ipc.open_stream(pa.py_buffer(blob.as_py()))

    return sent.mapInArrow(run, schema)


def shuffled(rows: DataFrame, seed: int = 1) -> DataFrame:
    """The same random order on every run. Hashes are spread evenly, so each
    partition gets a range of them by reckoning: no rows are made twice, as they are where
    the bounds of the ranges are sampled."""
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, size >> 25) if size < 1 << 50 else 0)  # a plan of unknown size says more
    high = F.shiftright("_hash", 32) + F.lit(1 << 31)  # 0 to 2 ** 32 - 1, in the hash's order
    dealt = rows.withColumn("_hash", F.xxhash64(F.lit(seed), *rows.columns)).withColumn("_part", F.shiftright(high * parts, 32).cast("int"))
    sent = packed_rows(dealt.drop("_hash"), "_part").repartitionById(parts, F.col("_part"))
    return unpacked_rows(sent, rows.schema).withColumn("_hash", F.xxhash64(F.lit(seed), *rows.columns)).sortWithinPartitions("_hash", *rows.columns).select(*rows.columns)

"""Ranked search over a stored inverted index (survey T01, P02, A08).

Documents lie in blocks of at most BLOCK rows. The index has one row a term and block: the
places of the term's documents in the block, their term frequencies, and ``peak``, the
highest share of a score that the term has there before its inverse document frequency
weighs it. Rows are sorted by term and block over all files, so a search reads the row
groups and pages of its own terms; an index grows by segments (one a source, or a batch),
each a folder of its own, and counts are summed over segments when a search asks.

A page of the best documents is found in two steps. The sum of its terms' weighted peaks
bounds every score of a block. First the blocks with the highest bounds are scored; the
last score that the page needs from them is a threshold, and of the other blocks only
those whose bound reaches it are scored, too. No other block can hold a document of the
page. What passes the driver is one row a term, the first blocks' numbers, the threshold,
and the second step's blocks up to MOST_LISTED of them (beyond that they are joined).

Scores are those of ``querydsl.relevance``, bit by bit: terms are added in the query's
order. Ties go to the smaller key. Null and empty texts have no terms but count as
documents; keys should be unique over all segments; writing a segment again replaces it."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbarium.functions import text as T
from verbarium.operators import querydsl
from verbarium.session import shared_base

BLOCK = 4096
#: A block ends early at so many tokens.
BLOCK_TOKENS = 1 << 19
#: Documents that a task is handed at a time; a block gathers them, so more would be held besides it.
HANDED = 256
#: Blocks of the first step, and how many of the second are listed in its filter.
FIRST, MOST_LISTED = 16, 2000
_PLACE = "term string, block bigint, n int, peak double, at array<int>, tf array<int>"


class NotIndexed(querydsl.BadQuery):
    """A query that the index can't answer; ``corpus.search`` can."""


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole blocks, from batches of any size: one batch a block."""
    held, rows, tokens = [], 0, 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            to = min(batch.num_rows, at + BLOCK - rows, max(at + 1, int(np.searchsorted(sizes, before + BLOCK_TOKENS - tokens, side="right"))))
            held.append(batch.slice(at, to - at))
            rows, tokens, at = rows + to - at, tokens + int(sizes[to - 1]) - before, to
            if rows >= BLOCK or tokens >= BLOCK_TOKENS:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows, tokens = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def postings_of(tokens: pa.ListArray) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, first place of each, places, frequencies, peaks) of one block."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
    coded = pc.list_flatten(tokens).dictionary_encode()
    if not len(coded):
        return
    row = np.repeat(np.arange(len(sizes)), sizes)
    both, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(sizes) + row, return_counts=True)
    code, at = both // len(sizes), both % len(sizes)
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    peak = np.maximum.reduceat(np.sqrt(tf) / np.sqrt(sizes[at]), first)
    yield coded.dictionary.take(pa.array(code[first])), np.append(first, len(code)).astype(np.int32), at.astype(np.int32), tf.astype(np.int32), peak


@contextmanager
def _handed(spark: SparkSession):
    """Python is handed HANDED rows at a time here, whatever the length of their texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name, None)
    spark.conf.set(name, str(HANDED))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def write_segment(docs: DataFrame, path: str, segment: str, key: str = "_id", field: str = "content") -> None:
    """Add documents (key, data_source, word_count, field) to the index at ``path``. Texts
    are analysed once; a task makes whole blocks of its own documents, so only postings
    are shuffled, into the order of terms."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), "data_source", "word_count", F.coalesce(T.analyzed(F.col(field)), F.array().cast("array<string>")).alias("_t"))
    kinds = dict(rows.dtypes)
    schema = f"key {kinds['key']}, data_source string, word_count bigint, size int, place int, {_PLACE}"
    names = ["key", "data_source", "word_count", "size", "place", "term", "block", "n", "peak", "at", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for number, block in enumerate(_blocks(batches)):
            n, tokens = block.num_rows, block.column(3)
            own = pa.array(np.full(n, base + number))
            size = pc.fill_null(pc.list_value_length(tokens), 0).cast(pa.int32())
            none = [pa.nulls(n, t) for t in (pa.string(), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*block.columns[:3], size, pa.array(np.arange(n, dtype=np.int32)), none[0], own, *none[1:]], names)
            for terms, offsets, at, tf, peak in postings_of(tokens):
                m = len(terms)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (at, tf)]
                empty = [pa.nulls(m, block.column(0).type), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32())]
                yield pa.RecordBatch.from_arrays([*empty, terms.cast(pa.string()), pa.array(np.full(m, base + number)), pa.array(np.diff(offsets).astype(np.int32)), pa.array(peak), *lists], names)

    folder = f"{path}/staging/{segment}"
    with _handed(spark):
        rows.mapInArrow(run, schema).write.mode("overwrite").option("compression", "zstd").parquet(folder)
    staged = spark.read.schema(schema).parquet(folder)
    staged.where("term is null").select("block", "place", "key", "data_source", "word_count", "size").sortWithinPartitions("block", "place").write.mode("overwrite").parquet(f"{path}/docs/segment={segment}")
    order = ("term", "block")
    placed = staged.where("term is not null").select("term", "block", "n", "peak", "at", "tf").repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 16 << 20).option("parquet.page.row.count.limit", 256).parquet(f"{path}/postings/segment={segment}")
    _delete(spark, folder)


def stored(table: DataFrame, docs: DataFrame, key: str = "_id") -> SearchIndex:
    """The index of the documents of a table of files, in the shared folder. It is built
    by the first call and found by later ones, until a file of the table changes."""
    spark = table.sparkSession
    conf, seen = spark._jsc.hadoopConfiguration(), []
    for name in sorted(table.inputFiles()):
        place = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = place.getFileSystem(conf).getFileStatus(place)
        seen.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    path = f"{shared_base(spark)}/search-index/{hashlib.sha256(chr(10).join([key, *seen]).encode()).hexdigest()}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_built")
    files = done.getFileSystem(conf)
    if not files.exists(done):
        write_segment(docs, path, "all", key)
        files.create(done).close()
    return SearchIndex(spark, path)


def drop_segment(spark: SparkSession, path: str, segment: str) -> None:
    for part in ("docs", "postings"):
        _delete(spark, f"{path}/{part}/segment={segment}")


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def understood(query) -> tuple[list[str], bool, Column]:
    """(words, whether all must be there, condition on data_source) of a query: a match on
    the content, alone or filtered by sources. Raises NotIndexed otherwise."""
    query = json.loads(query) if isinstance(query, str) else query
    query = query.get("query", query) if isinstance(query, dict) and set(query) == {"query"} else query
    kind, body = querydsl._one(query)
    if kind == "filtered" and set(body) == {"query", "filter"}:
        words, every, _ = understood(body["query"])
        kind, inner = querydsl._one(body["filter"])
        if kind in ("term", "terms") and set(inner) == {"data_source"}:
            return words, every, querydsl.predicate(body["filter"])
    if kind == "match" and set(body) == {"content"}:
        wanted = body["content"]
        every = isinstance(wanted, dict) and str(wanted.get("operator", "or")).lower() == "and"
        return querydsl.wanted_words(query), every, F.lit(True)
    raise NotIndexed(f"not by the index: {query}")


class SearchIndex:
    """An index as stored at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.docs = spark.read.parquet(f"{path}/docs")
        self.postings = spark.read.parquet(f"{path}/postings")

    def weights(self, words: list[str]) -> dict[str, float]:
        """(1 + ln(n / (df + 1)))^2 of each word that some document has."""
        n = float(self.docs.count())
        rows = self.postings.where(F.col("term").isin(words)).groupBy("term").agg(F.sum("n").alias("df")).collect()  # a row a word
        return {r["term"]: math.pow(1 + math.log(n / (r["df"] + 1.0)), 2.0) for r in rows}

    def _scored(self, words: list[str], weights: dict[str, float], every: bool, only: Column, postings: DataFrame, docs: DataFrame) -> DataFrame:
        """segment, block, key, data_source, word_count and score of the documents that
        these postings name."""
        pairs = postings.where(F.col("term").isin(words)).select("term", "segment", "block", F.explode(F.arrays_zip("at", "tf")).alias("p")).select("term", "segment", "block", F.col("p.at").alias("place"), F.col("p.tf").alias("tf"))
        parts = [F.coalesce(F.sqrt(F.max(F.when(F.col("term") == w, F.col("tf")))) * F.lit(weights[w]), F.lit(0.0)).alias(f"_s{i}") for i, w in enumerate(words)]
        sums = pairs.groupBy("segment", "block", "place").agg(F.count(F.lit(1)).alias("_n"), *parts)
        if every:
            sums = sums.where(F.col("_n") == len(words))
        total = F.lit(0.0)
        for i in range(len(words)):
            total += F.col(f"_s{i}")
        found = sums.join(docs, ["segment", "block", "place"]).where(only)
        return found.select("segment", "block", "key", "data_source", "word_count", (total / F.sqrt("size")).alias("score"))

    def scores(self, query) -> DataFrame:
        """key, data_source, word_count and score of every document that a query finds."""
        words, every, only = understood(query)
        weights = self.weights(words) if words else {}
        if not words or every and len(weights) < len(words):
            return self.docs.select("key", "data_source", "word_count", F.lit(0.0).alias("score")).limit(0)
        known = [w for w in words if w in weights]
        return self._scored(known, weights, every, only, self.postings, self.docs).drop("segment", "block")

    def page(self, query, offset: int = 0, page: int = 25) -> DataFrame:
        """rank, key, data_source and score of a page, best first."""
        words, every, only = understood(query)
        weights = self.weights(words) if words else {}
        known = [w for w in words if w in weights]
        empty = self.docs.select(F.lit(0).alias("rank"), "key", "data_source", F.lit(0.0).alias("score")).limit(0)
        if not known or every and len(known) < len(words):
            return empty
        weight = F.lit(0.0)
        for w in known:
            weight = F.when(F.col("term") == w, F.lit(weights[w])).otherwise(weight)
        # what rounding may add to a bound is far below a millionth of it
        bounds = self.postings.where(F.col("term").isin(known)).groupBy("segment", "block").agg((F.sum(F.col("peak") * weight) * (1 + 1e-9)).alias("bound"), F.count(F.lit(1)).alias("_terms"))
        if every:
            bounds = bounds.where(F.col("_terms") == len(known))
        need = offset + page
        first = [(r["segment"], r["block"]) for r in bounds.orderBy(F.desc("bound"), "segment", "block").limit(FIRST).collect()]
        if not first:
            return empty
        order = (F.desc("score"), F.asc("key"))
        best = self._scored(known, weights, every, only, _among(self.postings, first), _among(self.docs, first)).orderBy(*order).limit(need).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        least = best["least"] if best["n"] == need else 0.0
        others = bounds.where((F.col("bound") >= least) & ~_listed(first))
        more = [(r["segment"], r["block"]) for r in others.select("segment", "block").limit(MOST_LISTED + 1).collect()]
        if len(more) <= MOST_LISTED:
            postings, docs = _among(self.postings, first + more), _among(self.docs, first + more)
        else:
            wanted = bounds.where((F.col("bound") >= least) | _listed(first)).select("segment", "block")
            postings, docs = self.postings.join(wanted, ["segment", "block"], "left_semi"), self.docs
        top = self._scored(known, weights, every, only, postings, docs).orderBy(*order).offset(offset).limit(page)
        rank = F.row_number().over(Window.orderBy(*order)) + offset  # of a page
        return top.select(rank.alias("rank"), "key", "data_source", "score")

    def totals(self, query) -> DataFrame:
        """count and words: how many documents a query finds, and their words."""
        return self.scores(query).agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))


def _listed(blocks: list[tuple[str, int]]) -> Column:
    by: dict[str, list[int]] = {}
    for segment, block in blocks:
        by.setdefault(segment, []).append(block)
    out = F.lit(False)
    for segment, own in by.items():
        out |= (F.col("segment") == segment) & F.col("block").isin(own)
    return out


def _among(rows: DataFrame, blocks: list[tuple[str, int]]) -> DataFrame:
    """Rows of these blocks; the plain list of numbers reaches the files' statistics."""
    return rows.where(F.col("block").isin(sorted({b for _, b in blocks}))).where(_listed(blocks))


def search(index: SearchIndex, docs: DataFrame, query, offset: int = 0, page: int = 25, key: str = "_id") -> DataFrame:
    """``corpus.search`` of a query that the index understands: its rows, from the index.
    Of ``docs`` only the page's rows are read, by key."""
    words = understood(query)[0]
    top = index.page(query, offset, page)
    held = top.collect()  # a page
    shown = docs.where(F.col(key).isin([r["key"] for r in held])).select(F.col(key).alias("_key"), T.highlighted(F.col("content"), words).alias("snippet"))
    top = docs.sparkSession.createDataFrame(held, top.schema)
    rows = top.join(shown, top["key"] == shown["_key"]).crossJoin(F.broadcast(index.totals(query)))  # one row
    return rows.select("rank", F.col("key").alias(key), F.col("data_source").alias("source"), "score", "snippet", "count", "words").orderBy("rank")

"""The corpus: its document view, statistics and search pages (survey A01-A09, S01-S04, T01)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbarium.functions import dates as D
from verbarium.functions import text as T
from verbarium.operators import querydsl

MIN_WORDS = 10
PAGE = 25


def documents(raw: DataFrame) -> DataFrame:
    """The document view of a table (doc_id, text, lang, source)."""
    return raw.select(
        T.document_id(F.col("source"), F.col("doc_id")).alias("_id"),
        F.col("doc_id"),
        F.col("text").alias("content"),
        T.title_line(F.col("text")).alias("title"),
        F.lit("clean").alias("content_type"),
        F.array("lang").alias("tags"),
        T.word_count(F.col("text")).alias("word_count"),
        F.col("source").alias("data_source"),
    )


def size(docs: DataFrame, query=None) -> DataFrame:
    """Words of the corpus, or of a query's part of it."""
    return docs.where(querydsl.predicate(query)).agg(F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))


def size_by_source(docs: DataFrame) -> DataFrame:
    """A03, largest number of documents first."""
    return docs.groupBy("data_source").agg(F.count("*").alias("docs"), F.sum("word_count").alias("words")).orderBy(F.desc("docs"), "data_source")


def hits(docs: DataFrame, query=None) -> DataFrame:
    """Documents and words of a query."""
    return docs.where(querydsl.predicate(query)).agg(F.count("*").alias("total"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))


def growth(log: DataFrame, now: Column, days: int = 10, source: str = "data_source", at: str = "date_scraped", words: str = "word_count") -> DataFrame:
    """Words a source and day of the last days; a source without any stays, with a
    null day."""
    recent = log.where(F.col(at) >= D.day(now) - F.expr(f"interval {days} days")).groupBy(source, D.day(F.col(at)).alias("day")).agg(F.sum(words).alias("words"))
    return log.select(source).distinct().join(recent, source, "left")


def growth_dense(log: DataFrame, now: Column, days: int = 10, source: str = "data_source", at: str = "date_scraped", words: str = "word_count") -> DataFrame:
    """One array a source over all days seen, gaps as zeros; arrays are as long as
    the number of days."""
    part = growth(log, now, days, source, at, words)
    seen = part.where("day is not null").select("day").distinct()
    full = part.select(source).distinct().crossJoin(F.broadcast(seen)).join(part, [source, "day"], "left")
    pairs = F.array_sort(F.collect_list(F.struct("day", F.coalesce("words", F.lit(0.0)).alias("words"))))
    return full.groupBy(source).agg(F.transform(pairs, lambda x: x["words"]).alias("series"))


def day_counts(log: DataFrame, first: Column, last: Column, at: str = "ts") -> DataFrame:
    """Documents a day between two days, both included, empty ones too."""
    grid = log.sparkSession.range(1).select(F.explode(D.grid(first, last)).alias("day"))
    counts = log.groupBy(F.col(at).cast("date").alias("day")).agg(F.count("*").alias("docs"))
    return grid.join(counts, "day", "left").select("day", F.coalesce("docs", F.lit(0)).alias("docs"))


def missing_days(log: DataFrame, first: Column, last: Column, start: Column | None = None, at: str = "ts") -> DataFrame:
    """Days without documents; if there are none at all, every day from
    ``start`` on."""
    counts = day_counts(log, first, last, at)
    empty = counts.where("docs = 0").select("day")
    if start is None:
        return empty
    none = counts.agg(F.sum("docs").alias("n")).where("n = 0").select(F.explode(D.grid(start, last)).alias("day"))
    return empty.unionByName(none).distinct()


def search(docs: DataFrame, query=None, offset: int = 0, page: int = PAGE, key: str = "_id") -> DataFrame:
    """A page of a query's documents, best score first, ties by key: rank,
    key, source, score and a highlighted fragment, and next to each the number of all hits
    and of their words. Without words to score by, all scores are 1."""
    found = docs.where(querydsl.predicate(query))
    words = querydsl.wanted_words(query)
    totals = found.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))
    if words:
        scores = querydsl.relevance(docs, words, key=key)
        found = found.join(scores, key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    else:
        found = found.withColumn("score", F.lit(1.0))
    top = found.select(key, "score").orderBy(F.desc("score"), key).offset(offset).limit(page)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), key)) + offset  # of a page
    top = top.withColumn("rank", rank)
    rows = docs.join(F.broadcast(top), key).crossJoin(F.broadcast(totals))
    return rows.select("rank", key, F.col("data_source").alias("source"), "score", T.highlighted(F.col("content"), words).alias("snippet"), "count", "words").orderBy("rank")


def stats(docs: DataFrame, log: DataFrame, now: Column, days: int = 10) -> DataFrame:
    """Size and daily growth of every source that has either, largest first."""
    size_of = docs.groupBy("data_source").agg(F.sum("word_count").alias("size"))
    return size_of.join(growth_dense(log, now, days), "data_source", "full").orderBy(F.desc_nulls_last("size"), "data_source")


def metadata(wanted: list[str], **columns: Column) -> Column:
    """A map of those wanted fields that a document has."""
    have = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in columns]), F.array(*[v.cast("string") for v in columns.values()])), lambda k, v: v.isNotNull())
    keys = F.array_intersect(F.array(*[F.lit(w) for w in wanted]), F.map_keys(have))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: have[k]))


def document(docs: DataFrame, doc_id: str, source: str | None = None) -> DataFrame:
    """P03, S04. With the source, only its rows are hashed (a table partitioned by source
    reads one folder)."""
    rows = docs if source is None else docs.where(F.col("data_source") == source)
    return rows.where(F.col("_id") == doc_id).limit(1)


def downloads(docs: DataFrame, query=None, key: str = "_id") -> DataFrame:
    """(name, content) of a query's documents, one file each."""
    return docs.where(querydsl.predicate(query)).select(F.concat(F.col(key).cast("string"), F.lit(".txt")).alias("name"), F.coalesce("content", F.lit("")).alias("content"))


def zipped(files: DataFrame) -> Iterator[bytes]:
    """A zip archive of (name, content) rows in pieces, as rows arrive: one
    partition at a time is on the driver."""
    sink = _Pieces()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as archive:
        for row in files.toLocalIterator():
            archive.writestr(zipfile.ZipInfo(row["name"]), row["content"])
            yield from sink.take()
    yield from sink.take()


class _Pieces(io.RawIOBase):
    """A sink that can't be sought and gives away what it gets."""

    def __init__(self):
        self.held: list[bytes] = []

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.held.append(bytes(data))
        return len(data)

    def take(self) -> list[bytes]:
        out, self.held = [x for x in self.held if x], []
        return out


def long_enough(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """F12."""
    return docs.where(F.col("word_count") >= least)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key; new rows win ties. Map-side aggregation, so
    a key with many rows is no problem."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in {*keys, "_new"}]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.col("_new"))).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def reindexed(docs: DataFrame, tag: str, least: int = MIN_WORDS) -> DataFrame:
    """Add a tag where it's missing, rebuild ids, drop short documents."""
    tags = F.when(F.array_contains("tags", tag), F.col("tags")).otherwise(F.array_append("tags", F.lit(tag)))
    return long_enough(docs.withColumn("tags", tags).withColumn("_id", T.document_id(F.col("data_source"), F.col("doc_id"))), least)

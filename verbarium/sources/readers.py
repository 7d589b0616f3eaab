"""Readers of the file formats of corpora, test sets and models (survey S08-S18)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbarium.functions import text as T
from verbarium.sources.sinks import TRIPLE


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their numbers in reading order; header lines start with a colon (Q9)."""
    rows = spark.read.text(path).where(~F.col("value").startswith(":") & (F.trim("value") != ""))
    return rows.select(F.monotonically_increasing_id().alias("item"), F.split(F.trim("value"), r"\s+").alias("w"))


def read_analogies(spark: SparkSession, path: str) -> DataFrame:
    """Four words a line; other lines are left out (Q8)."""
    return _lines(spark, path).where(F.size("w") == 4).select("item", *[F.col("w")[i].alias(f"w{i + 1}") for i in range(4)])


def read_odd_one_out(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).where(F.size("w") > 1).select("item", F.col("w")[0].alias("odd"), F.slice("w", 2, F.size("w") - 1).alias("rest"))


def read_similarities(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).where(F.size("w") == 3)
    return rows.select("item", F.col("w")[0].alias("w1"), F.col("w")[1].alias("w2"), F.col("w")[2].try_cast("double").alias("score")).where("score is not null")


def read_rejects(spark: SparkSession, path: str, arity: int) -> DataFrame:
    """Q8: lines of another number of words."""
    return _lines(spark, path).where(F.size("w") != arity)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Text vectors, a word and its numbers a line."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("w")).where(F.size("w") > 1)
    return rows.select(F.col("w")[0].alias("word"), F.transform(F.slice("w", 2, F.size("w") - 1), lambda x: x.cast("float")).alias("vec"))


def read_pseudo_xml(spark: SparkSession, path: str) -> DataFrame:
    """Files of ``<doc id url title>`` elements, plain or compressed."""
    pattern = r'(?s)<doc id="([^"]*)" url="([^"]*)" title="([^"]*)"[^>]*>(.*?)</doc>'
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("d"))
    return rows.select(*[F.regexp_extract("d", pattern, i).alias(n) for i, n in ((1, "id"), (2, "url"), (3, "title"))], F.regexp_replace(T.drop_refs(F.regexp_extract("d", pattern, 4)), r"\A\s+|\s+\z", "").alias("content"))


def read_xml_texts(spark: SparkSession, path: str) -> DataFrame:
    """XML files, plain or gzipped: all text nodes joined by one space."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    text = T.unescape(F.trim(F.regexp_replace(F.regexp_replace("value", r"(?s)<[^>]*>", " "), r"\s+", " ")))
    return rows.select(F.col("_metadata.file_path").alias("path"), text.alias("content")).withColumn("name", T.basename(F.col("path"))).withColumn("year", T.path_year(F.col("path")))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Latin-1 HTML files, the text of the body."""
    raw = spark.read.format("binaryFile").load(path)
    html = F.decode("content", "ISO-8859-1")
    body = F.regexp_replace(F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1), r"(?s)<[^>]*>", " ")
    return raw.select("path", F.trim(F.regexp_replace(T.unescape(body), r"\s+", " ")).alias("content")).withColumn("kind", T.document_type(T.basename(F.col("path"))))


def read_wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a dump, without redirects and other namespaces."""
    rows = spark.read.format("xml").option("rowTag", "page").load(path)
    rows = rows.where("ns = 0") if "ns" in rows.columns else rows
    rows = rows.where("redirect is null") if "redirect" in rows.columns else rows
    return _wiki(rows)


def _wiki(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.get_json_object(F.to_json("revision"), "$.text._VALUE"), F.get_json_object(F.to_json("revision"), "$.text"))
    return rows.select(F.col("id").cast("bigint").alias("id"), F.col("title").cast("string").alias("title"), text.alias("text"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """One word a line, distinct."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """A model as write_model leaves it. Raises where words repeat, or vectors have
    several lengths or values that aren't finite."""
    model = spark.read.parquet(path)
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    n, words, least, most, wrong = model.agg(F.count(F.lit(1)), F.count_distinct("word"), F.min(F.size("vec")), F.max(F.size("vec")), F.count(F.when(bad, 1))).first()
    if n != words or least != most or wrong:
        raise ValueError(f"{n} rows, {words} words, vectors of {least} to {most} numbers, {wrong} of them not finite")
    return model


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """What write_cells wrote."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for blob in frame["data"]:
                got = np.frombuffer(blob, dtype=TRIPLE)
                yield pd.DataFrame({"w": got["w"], "c": got["c"], "x": got["x"]})

    return spark.read.parquet(path).mapInPandas(unpack, "w int, c int, x double")


def read_verb_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A form and its verb a line."""
    return _lines(spark, path).where(F.size("w") == 2).select(F.col("w")[0].alias("b"), F.col("w")[1].alias("a"))


def read_conjugations(spark: SparkSession, path: str) -> DataFrame:
    """A line of JSON a verb: forms by group and tense."""
    return spark.read.schema("verb string, forms map<string, map<string, string>>").json(path)


def read_templates(spark: SparkSession, path: str, prefix: str = "Template:") -> DataFrame:
    """Titles and texts of a dump's templates, the pass before cleaning. Texts without
    what a definition leaves out."""
    rows = spark.read.format("xml").option("rowTag", "page").load(path)
    return _wiki(rows).where(F.col("title").startswith(prefix)).select("title", "text")

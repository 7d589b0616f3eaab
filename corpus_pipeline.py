"""A pipeline from raw documents to token files: quality, near duplicates, benchmark
leaks, mixture, tokens. Each stage is one of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbarium.llm import decontaminate, jaccard_join, mixing, quality, token_store
from verbarium.llm.common import materialize
from verbarium.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Scores below this are rejected: the classifier is sure of label 0.
LEAST_QUALITY = 0.3


def _keep(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id ``chosen`` has; both sides grow with the input."""
    ids = chosen.select(F.col("doc_id").alias("_id")).distinct()
    return docs.hint("merge").join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi").select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out())
    model = quality.fit(docs, labels)
    return quality.score(docs, model, keep=COLUMNS[1:]).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8), the document
    with the smallest id; texts without words and rows without an id stay."""
    groups = jaccard_join.similar(docs.select("doc_id", "text"), n=5, percent=80)
    return _keep(docs, groups.where("doc_id <=> component_id"))


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontaminate.leaks(docs, benchmark, keep=COLUMNS[1:])
    return judged.where("contaminated = 0").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them: one row for each
    epoch in which any of a document's words are taken; whole documents, so that the
    row at a source's cut is taken whole. Documents without words are taken once."""
    taken = mixing.mix(docs).select("doc_id", F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(1).cast("int").alias("times"))
    taken = taken.where("times > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.max("times").alias("times"))
    rows = docs.hint("merge").join(taken, docs["doc_id"].eqNullSafe(taken["_id"]))
    return rows.withColumn("_time", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of the mix, by document as read from its files."""
    return token_store.token_digests(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", no_leaks),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokens),
]

#: Learned scores, edit distances and subword tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

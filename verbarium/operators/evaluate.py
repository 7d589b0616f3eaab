"""Scoring models against test sets (survey V07-V10, A15-A19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.functions import text as T
from verbarium.functions import vector as V
from verbarium.operators import catalog
from verbarium.operators import embeddings as E


def analogies(model: DataFrame, items: DataFrame) -> DataFrame:
    """V07 item by item: (item, w1..w4) to (item, missing, and a hit at 1, 5 and 10 for
    both methods). An item with an unknown word has six misses."""
    known = model.select("word")
    words = E.signed(items, ["w1", "w2", "w3", "w4"], []).join(known.withColumn("k", F.lit(1)), "word", "left")
    missing = words.groupBy("item").agg(F.max(F.col("k").isNull()).alias("missing"))
    good = items.join(missing.where("not missing"), "item", "left_semi")
    asked = E.signed(good, ["w2", "w3"], ["w1"])
    place = {}
    for name, method in (("mul", E.nearest_mul), ("add", E.nearest_add)):
        top = method(model, asked, 10)
        place[name] = top.join(good.select("item", F.col("w4").alias("word")), ["item", "word"]).select("item", F.col("rank").alias(name))
    out = items.select("item").join(missing, "item", "left").join(place["mul"], "item", "left").join(place["add"], "item", "left")
    flags = [F.coalesce(F.col(m) <= k, F.lit(False)).alias(f"top{k}_{m}") for m in ("mul", "add") for k in (1, 5, 10)]
    return out.select("item", F.coalesce("missing", F.lit(False)).alias("missing"), *flags)


def analogy_scores(flags: DataFrame) -> DataFrame:
    """Hit ratios over all items (0 without items), and what failed."""
    names = [f"top{k}_{m}" for m in ("mul", "add") for k in (1, 5, 10)]
    wrong = ~F.greatest(*[F.col(n).cast("int") for n in names]).cast("boolean") & ~F.col("missing")
    return flags.agg(
        *[F.coalesce(F.avg(F.col(n).cast("double")), F.lit(0.0)).alias(n) for n in names],
        F.array_sort(F.collect_list(F.when(F.col("missing"), F.col("item")))).alias("missing"),
        F.array_sort(F.collect_list(F.when(wrong, F.col("item")))).alias("wrong"),
        F.count("*").alias("total"),
    ).withColumn("accuracy", F.col("top1_mul"))


def similarities(model: DataFrame, items: DataFrame) -> DataFrame:
    """(item, w1, w2, score) to (item, score, similarity); 0.0 with an unknown word."""
    a, b = (model.select(F.col("word").alias(w), F.col("vec").alias(v)) for w, v in (("w1", "v1"), ("w2", "v2")))
    rows = items.join(a, "w1", "left").join(b, "w2", "left")
    return rows.select("item", "score", F.coalesce(V.dot(F.col("v1"), F.col("v2")), F.lit(0.0)).alias("similarity"))


def averaged(rows: DataFrame, value: str, name: str) -> DataFrame:
    """The average rank of equal values; null ranks last, among nulls."""
    return catalog.ranks(rows, [], value).withColumn(name, F.col("_rank") + (F.col("_ties") - 1) / 2.0).drop("_rank", "_ties")


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row, 0 where it isn't defined."""
    ranked = averaged(averaged(rows.select(F.col(a).alias("_a"), F.col(b).alias("_b")), "_a", "ra"), "_b", "rb")
    rho = F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb"))
    return ranked.agg(F.coalesce(rho, F.lit(0.0)).alias("accuracy"), F.count("*").alias("total"))


def odd_one_outs(model: DataFrame, items: DataFrame) -> DataFrame:
    """(item, odd, rest) to (item, result, missing): true where the odd word is found;
    missing where no word is known."""
    words = items.select("item", F.explode(F.array_append("rest", F.col("odd"))).alias("word"))
    found = E.odd_one_out(model, words)
    return items.select("item", F.col("odd").alias("wanted")).join(found, "item", "left").select("item", F.coalesce(F.col("odd") == F.col("wanted"), F.lit(False)).alias("result"), F.col("odd").isNull().alias("missing"))


def odd_scores(results: DataFrame) -> DataFrame:
    """0 without items."""
    return results.agg(F.coalesce(F.avg(F.col("result").cast("double")), F.lit(0.0)).alias("accuracy"), F.array_sort(F.collect_list(F.when(F.col("missing"), F.col("item")))).alias("missing"), F.count("*").alias("total"))


def missing_words(model: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct unknown words, folded."""
    return words.join(model.select("word"), "word", "left_anti").select(T.fold(F.col("word").cast("string")).alias("word")).distinct()


def evaluate(model: DataFrame, items: DataFrame, kind: str) -> DataFrame:
    """The score row of a test set of a kind."""
    if kind == "analogies":
        return analogy_scores(analogies(model, items))
    if kind == "similarity":
        return spearman(similarities(model, items), "similarity", "score")
    if kind == "odd-one-out":
        return odd_scores(odd_one_outs(model, items))
    raise ValueError(f"no test of kind {kind}")

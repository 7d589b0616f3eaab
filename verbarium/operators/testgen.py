"""Test-set generators (survey G01-G04, G06), with hashes in place of chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbarium.functions import vector as V

#: Parts of a group that is numbered.
BUCKETS = 1024


def _numbered(rows: DataFrame, key: str, within: list[str], weight: str | None = None) -> DataFrame:
    """``_at``: the weight (1 by default) of the rows that come before a row in a random
    order of its group, and ``_n``: the weight of the group. Rows are ranked in buckets,
    and buckets by their sums, so no task has to hold a group."""
    own = F.lit(1) if weight is None else F.col(weight)
    rows = rows.withColumn("_b", F.pmod(V.draw("bucket", F.col(key)), F.lit(BUCKETS)))
    sums = rows.groupBy(*within, "_b").agg(F.sum(own).alias("_own"))
    sums = sums.select(*within, "_b", (F.sum("_own").over(Window.partitionBy(*within).orderBy("_b")) - F.col("_own")).alias("_first"), F.sum("_own").over(Window.partitionBy(*within)).alias("_n"))
    along = Window.partitionBy(*within, "_b").orderBy(V.draw("order", F.col(key)), key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_at", F.sum(own).over(along) - own).join(sums, [*within, "_b"]).withColumn("_at", F.col("_at") + F.col("_first")).drop("_b", "_first")


def _draws(n: str, most: int, seed: int, *keys: str) -> Column:
    """``most`` different places of ``n`` by chance (all, if there are no more): one in
    each of ``most`` equal stretches, from a random start."""
    size = F.col(n)
    edge = lambda k: F.floor(k * size / F.lit(most))
    by = [F.col(k) for k in keys]
    start = F.pmod(V.draw(seed, F.lit("start"), *by), size)
    some = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.pmod(start + edge(k) + F.pmod(V.draw(seed, k, *by), edge(k + 1) - edge(k)), size))
    return F.when(size > most, some).otherwise(F.sequence(F.lit(0).cast("bigint"), size - 1))


def odd_from_categories(words: DataFrame, seed: int = 1) -> DataFrame:
    """Each (category, word) is the odd one among three words of one other category.
    The category and its words are drawn by their numbers and met by equal keys."""
    words = words.where("category is not null and word is not null").distinct()
    cats = _numbered(words.select("category").distinct(), "category", []).select("category", F.col("_at").alias("_c"), F.col("_n").alias("_cats")).where("_cats > 1")
    pool = _numbered(words, "word", ["category"])
    sizes = pool.groupBy("category").agg(F.first("_n").alias("_n"))
    drawn = F.pmod(V.draw(seed, F.col("category"), F.col("word")), F.col("_cats") - 1)
    asked = words.join(cats, "category").withColumn("_c", drawn + (drawn >= F.col("_c")).cast("bigint")).drop("_cats")
    asked = asked.join(cats.join(sizes, "category").select(F.col("category").alias("other"), "_c", "_n"), "_c")
    asked = asked.select("category", "word", "other", F.explode(_draws("_n", 3, seed + 1, "category", "word")).alias("_at"))
    rows = asked.join(pool.select(F.col("category").alias("other"), F.col("word").alias("w"), "_at"), ["other", "_at"])
    return rows.groupBy("category", "word", "other").agg(F.sort_array(F.collect_list("w")).alias("rest")).withColumnRenamed("word", "odd")


def analogies(forms: DataFrame, each: int = 10, seed: int = 1) -> DataFrame:
    """(a, b) pairs against ``each`` other pairs with another a, in an order by
    chance. Pairs of one a are numbered in a row; the others are drawn by number from
    what comes after them, round the end, and met by equal keys."""
    forms = forms.select("a", "b").where("a is not null").distinct()
    firsts = _numbered(forms.groupBy("a").agg(F.count("*").alias("_own")), "a", [], "_own").select("a", "_own", F.col("_at").alias("_first"), F.col("_n").alias("_all"))
    table = _numbered(forms, "b", ["a"]).drop("_n").join(firsts, "a").withColumn("_at", F.col("_at") + F.col("_first"))
    asked = table.withColumn("_n", F.col("_all") - F.col("_own")).where("_n > 0")
    asked = asked.withColumn("_j", F.explode(_draws("_n", each, seed, "a", "b")))
    asked = asked.select("a", "b", F.pmod(F.col("_first") + F.col("_own") + F.col("_j"), F.col("_all")).alias("_at"))
    rows = asked.join(table.select(F.col("a").alias("c"), F.col("b").alias("d"), "_at"), "_at")
    turn = F.pmod(V.draw(seed, *[F.col(c) for c in "abcd"]), F.lit(2)) == 1
    pick = lambda x, y: F.when(turn, F.col(x)).otherwise(F.col(y))
    return rows.select(pick("b", "a").alias("w1"), pick("a", "b").alias("w2"), pick("d", "c").alias("w3"), pick("c", "d").alias("w4"))


def verb_odd(forms: DataFrame, odd: str, rest: str, seed: int = 1) -> DataFrame:
    """Forms (verb, tense, form): each form of the odd tense twice, with four forms of
    the other tense, drawn by number and met by equal keys."""
    base = forms.where(F.col("tense") == odd).select("verb", F.col("form").alias("odd"), F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    pool = _numbered(forms.where(F.col("tense") == rest).select(F.col("form").alias("w")).distinct(), "w", [])
    size = pool.agg(F.count(F.lit(1)).alias("_n"))
    asked = base.crossJoin(F.broadcast(size)).where("_n > 0").withColumn("_at", F.explode(_draws("_n", 4, seed, "verb", "odd", "copy")))  # one row
    rows = asked.drop("_n").join(pool.select("w", "_at"), "_at")
    return rows.groupBy("verb", "odd", "copy").agg(F.sort_array(F.collect_list("w")).alias("rest")).drop("copy")


def inverted(forms: DataFrame) -> DataFrame:
    """The forms of every group and tense, as one sorted list under ``group.tense``."""
    return forms.groupBy(F.concat_ws(".", "group", "tense").alias("name")).agg(F.sort_array(F.collect_set("form")).alias("forms"))


def flattened(nested: DataFrame) -> DataFrame:
    """(verb, map of maps) to (verb, group, tense, form)."""
    outer = nested.select("verb", F.explode("forms").alias("group", "inner"))
    return outer.select("verb", "group", F.explode("inner").alias("tense", "form"))

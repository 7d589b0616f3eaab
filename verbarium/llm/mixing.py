"""Mixing sources to target weights.

Each row gets a hash-random key. Within its source the rows are range-sorted by
that key; prefix sums of the sizes along it come from two levels: sums of key
ranges (buckets of about equal numbers of rows, as the key is uniform), summed along
the buckets of a source, and sums along the rows of one bucket. The mix takes whole
epochs of a source, then the rows of the key order up to the exact budget; the row
at the cut is taken in part.

Everything is DataFrame code; a hot source has more buckets, not larger ones.

Defined results: a null text has size 0; the null source is a source of its own,
last in the order; equal rows are interchangeable; an empty table, or one without
words, gives targets of 0. Nothing depends on partitioning or on a rerun."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbarium.llm.common import WORD_PATTERN, materialize

BUCKET_ROWS = 2000
#: Beyond so many sources their table isn't broadcast.
FEW_SOURCES = 200_000


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source and size in words of every row."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), size.alias("_size"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """One row a source: rows, size and target.

    Sources in code point order, null last, take the weights in turn. Targets share
    ``share`` times all sizes by weight; none goes above ``limit`` times its
    source's size and the excess goes to the others by weight. The fixed point is
    min(limit * size, weight * level): along ascending limit * size / weight the
    capped sources are a prefix, and the level follows from prefix sums."""
    per = sizes.groupBy("_source").agg(F.count("*").alias("_rows"), F.sum("_size").alias("_total"))
    order = Window.orderBy(F.col("_source").isNull(), F.col("_source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_weight", weight).withColumn("_cap", F.lit(float(limit)) * F.col("_total"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").isNull(), F.col("_source")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns(
        {
            "_pool": F.lit(float(share)) * F.sum("_total").over(everything),
            "_capped": F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0.0)),
            "_left": F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(by_ratio), F.lit(0.0)),
        }
    )
    # the level if all sources before this one are capped; the true level is the first that this source stays below
    per = per.withColumn("_try", (F.col("_pool") - F.col("_capped")) / F.col("_left"))
    fits = F.col("_try") <= F.col("_cap") / F.col("_weight")
    level = F.min(F.when(fits, F.struct(F.col("_cap") / F.col("_weight"), F.col("_try").alias("level")))).over(everything)["level"]
    per = per.withColumn("_level", level)
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_weight") * F.col("_level")))
    return per.select("_source", "_rows", "_total", target.alias("_target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: str = "mix") -> DataFrame:
    """id, source, size, source_size, target and taken (the words that the mix takes
    of the row, repeats counted) of every row. The texts are read once; the sizes
    are written to the shared folder."""
    sizes, _ = materialize(sized(docs, id_col, text_col, source_col))
    goal, _ = materialize(targets(sizes, weights, share, limit))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("_id").cast("string")).cast("binary")), 1, 13), 16, 10).cast("bigint")
    rows = _with_goal(sizes, goal).withColumn("_key", key)
    buckets = F.ceil(F.col("_rows") / BUCKET_ROWS)
    rows = rows.withColumn("_bucket", F.floor(F.col("_key").cast("double") / F.lit(float(1 << 52)) * buckets).cast("bigint"))
    sums = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"))
    along = Window.partitionBy("_source").orderBy("_bucket")
    sums = sums.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), (F.sum("_sum").over(along) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    rows = rows.join(sums, rows["_source"].eqNullSafe(sums["_s"]) & (rows["_bucket"] == sums["_b"]))
    budget = F.round("_target").cast("bigint")
    epochs = F.when(F.col("_total") > 0, F.floor(budget / F.col("_total"))).otherwise(0)
    rest = budget - epochs * F.col("_total") - F.col("_before") - F.col("_within")
    taken = epochs * F.col("_size") + F.greatest(F.lit(0), F.least(rest, F.col("_size")))
    return rows.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), taken.cast("bigint").alias("taken"))


def _with_goal(sizes: DataFrame, goal: DataFrame, salts: int = 64) -> DataFrame:
    """``sizes`` with its source's row of ``goal``. Few sources are broadcast, by their
    count; for more, a source's row is there once a salt, so that a hot source's rows are
    dealt to as many tasks."""
    if goal.count() <= FEW_SOURCES:
        return sizes.join(F.broadcast(goal), sizes["_source"].eqNullSafe(goal["_source"])).drop(goal["_source"])
    salted = goal.withColumn("_with", F.explode(F.array(*map(F.lit, range(salts)))))
    rows = sizes.withColumn("_salt", F.pmod(F.xxhash64("_id", "_size"), F.lit(salts)).cast("int"))
    return rows.join(salted, rows["_source"].eqNullSafe(salted["_source"]) & (rows["_salt"] == salted["_with"])).drop(salted["_source"]).drop("_salt", "_with")

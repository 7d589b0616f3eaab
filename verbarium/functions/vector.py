"""Vector and weight functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """C40, in double precision."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """C41; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v.cast("array<double>"), lambda x: x / n))


def shifted(s: Column) -> Column:
    """A cosine as a share of one."""
    return (F.lit(1.0) + s) / 2


def cosmul(pos: Column, neg: Column) -> Column:
    """C43 of arrays of shifted cosines; an empty product is 1."""
    product = lambda a: F.aggregate(a, F.lit(1.0), lambda s, x: s * x)
    return product(pos) / (product(neg) + F.lit(0.0001))


def ppmi(x: Column, row: Column, col: Column, total: Column, smoothing: float = 0.75) -> Column:
    """Row sums are raw; ``total`` is the sum of the smoothed column sums."""
    return F.greatest(F.lit(0.0), F.log(x * total / (row * F.pow(col, F.lit(smoothing)))))


def drop_chance(count: Column, threshold: float, size: Column) -> Column:
    """Chance to drop a frequent word."""
    limit = F.lit(threshold) * size
    return F.when(count > limit, 1 - F.sqrt(limit / count)).otherwise(F.lit(0.0))


def draw(seed: int | str, *keys: Column) -> Column:
    """A number below 2 ** 52 that only the seed and the keys decide: the first 13 digits
    of the MD5 of ``seed|key|key``, which any SQL can give, too."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def coin(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that only the keys and the seed decide."""
    return draw(seed, *keys) / F.lit(float(1 << 52))


def glove_weight(x: Column, x_max: float = 100.0, alpha: float = 0.75) -> Column:
    """C46."""
    return F.least(F.lit(1.0), F.pow(x / F.lit(x_max), F.lit(alpha)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x + y)

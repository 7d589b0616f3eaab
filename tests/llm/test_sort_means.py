"""Sort-means against plain Lloyd rounds in Python's integers."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from verbarium.llm import sort_means

LONGEST = (1 << 63) - 1


def lloyd(rows, k, rounds, dim, scale=64):
    kept = [(i, [int(Fraction(x) * scale // 1) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    wide = lambda v: any(abs(x) >= (1 << 27) - 1 for x in v)
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), wide(v), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, _, v in seeds]
    if not centres:
        return []
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda: [min((far(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, v), (_, j) in zip(kept, near(), strict=True):
            groups[j].append(v)
        for j, vs in groups.items():
            centres[j] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    last = near()
    own = defaultdict(int)
    for d, j in last:
        own[j] += min(d, LONGEST)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, j, min(d, LONGEST), min(own[j], LONGEST), min(sum(own.values()), LONGEST), names[j]) for (i, _), (d, j) in zip(kept, last, strict=True)]


def vectors(seed, n, dim, spread):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(middles)]) for i in range(n)]


ODD = [(900, None), (901, []), (902, [1.0]), (903, [float("nan")] * 4), (904, [1.0, None, 1.0, 1.0]), (905, [float("inf")] * 4), (906, [0.0] * 4), (None, [0.5] * 4), (None, [0.5] * 4), (3, [9.0, 9.0, 9.0, -9.0]), (3, [9.0, 9.0, 9.0, -9.0])]


@pytest.mark.parametrize("case", range(6))
def test_against_lloyd(spark, case):
    dim, k = 4, [16, 5, 1, 40, 7, 16][case]
    rows = vectors(case, 150, dim, [0.1, 1.0, 0.3, 0.5, 0.0, 0.2][case]) + ODD
    if case == 4:  # all in one place
        rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(50)]
    if case == 5:  # numbers beyond 64 bits
        rows += [(1000, [1e300, -1e300, 0.0, 1.0]), (1001, [1e9] * 4), (1002, [-1e9, 1e9, 2.5, 0.0])]
    table = spark.createDataFrame([(i, v, "c", 0, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cluster string, distance int, v string").repartition(3)
    got = sort_means.clusters(table, k=k, dim=dim)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, lloyd(rows, k, 3, dim)))


def test_empty(spark):
    table = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert sort_means.clusters(table).collect() == []
    assert sort_means.clusters(spark.createDataFrame([(1, None), (2, [1.0])], "vec_id bigint, embedding array<float>")).collect() == []


def test_scan_stops_only_strictly_beyond():
    """Every vector gets what a full scan gives, ties to the smaller number included."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        centres = rng.integers(-3, 4, (6, 2))
        x = rng.integers(-4, 5, (200, 2))
        full = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        for before in (np.zeros(200, dtype=np.int64), rng.integers(0, 6, 200)):
            cluster, distance = sort_means.assign(x, before, centres, *sort_means.neighbours(centres))
            assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()

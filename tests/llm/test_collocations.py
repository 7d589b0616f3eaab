"""Phrases against plain counting in Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from verbarium.llm import collocations


def brute(rows, least, depth, most):
    f, n = Counter(), Counter()
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(words)
            for d in range(1, depth + 1):
                for i in range(len(words) - d + 1):
                    f["und" if lang is None else lang, tuple(words[i : i + d])] += 1
    often = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in often.items():
        longer = [q for (o, q), b in often.items() if o == lang and len(q) > len(w) and b >= a and any(q[i : i + len(w)] == w for i in range(len(q)))]
        if not longer:
            cut = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((cut[0], a, " ".join(w), f[lang, w[: cut[1]]], f[lang, w[cut[1] :]]))
    got = []
    for lang, found in out.items():
        found.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        got += [(lang, i, p, a, left, right, n[lang], score) for i, (score, a, p, left, right) in enumerate(found[:most], 1)]
    return sorted(got)


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "b", "B", "cc", "É", "x\x00y", "-", "d" * 40]
    marks = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", " ", " ", " "]
    text = lambda n: "".join(rng.choice(words) + rng.choice(marks) for _ in range(n))
    rows = [(text(rng.randrange(40)), rng.choice(["en", "de", None, "und", ""])) for _ in range(200)]
    return rows + [(None, "en"), ("", None), ("?!", "en"), ("a b cc " * 3000, "en"), ("copy of a text", "de"), ("copy of a text", "de"), (" ".join(["z"] * 500), "fr")]


@pytest.mark.parametrize("seed, least, most, shard", [(1, 5, 2000, 1 << 23), (2, 3, 7, 200), (3, 20, 2000, 1)])
def test_against_counting(spark, monkeypatch, seed, least, most, shard):
    real = collocations.counted
    monkeypatch.setattr(collocations, "counted", lambda docs, least, depth, lang, text: real(docs, least, depth, lang, text, shard_bytes=shard))
    rows = corpus(seed)
    docs = spark.createDataFrame([(t, lang, 1, "p") for t, lang in rows], "text string, lang string, a int, phrase string").repartition(3)
    got = collocations.collocations(docs, least=least, most=most)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, 5, most)


def test_full_filter(spark, monkeypatch):
    """A filter that lets everything through costs work, not results."""
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(collocations, "_filter", lambda frequent: b"\xff" * (1 << (collocations._BITS - 3)))
    assert sorted(map(tuple, collocations.collocations(docs, least=4).collect())) == brute(rows, 4, 5, 2000)


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []


def test_states_and_links():
    """Endpos counts of a b a b c, and what the links drop."""
    symbols = np.array([0, 1, 0, 1, 2])
    levels = collocations.Automaton(symbols, np.array([1, 2, 3, 4, 5]), 3).levels
    named = {d: {tuple(symbols[e - d + 1 : e + 1].tolist()): (int(c), int(k)) for e, c, k in zip(*levels[d], strict=True)} for d in (1, 2, 3)}
    assert {w: c for w, (c, _) in named[1].items()} == {(0,): 2, (1,): 2, (2,): 1}
    assert {w: c for w, (c, _) in named[2].items()} == {(0, 1): 2, (1, 0): 1, (1, 2): 1}
    assert {w: c for w, (c, _) in named[3].items()} == {(0, 1, 0): 1, (1, 0, 1): 1, (0, 1, 2): 1}
    for d in (2, 3):
        ends = levels[d - 1][0]
        for w, (_, link) in named[d].items():
            assert tuple(symbols[ends[link] - d + 2 : ends[link] + 1].tolist()) == w[1:]


@pytest.mark.parametrize("low", [2, 3, 5])
def test_states_from_a_size_on(low):
    """Shorter states aren't built; the others are the same."""
    rng = np.random.default_rng(low)
    symbols, new = rng.integers(0, 4, 500), rng.random(500) < 0.3
    at = np.arange(500)
    reach = at - np.maximum.accumulate(np.where(new | (at == 0), at, 0)) + 1
    whole, part = collocations.Automaton(symbols, reach, 5).levels, collocations.Automaton(symbols, reach, 5, low).levels
    assert sorted(part) == list(range(low, 6))
    for d in part:
        named = [{tuple(symbols[e - d + 1 : e + 1].tolist()): int(c) for e, c, _ in zip(*levels[d], strict=True)} for levels in (whole, part)]
        assert named[0] == named[1]

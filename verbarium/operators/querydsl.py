"""The corpus query language (survey F01-F07): JSON to a predicate and a score."""

from __future__ import annotations

import json
import re
import unicodedata
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.functions import text as T
from verbarium.session import shared_folder

ARRAYS = {"tags"}


class BadQuery(ValueError):
    """A query that the language doesn't have."""


def moment(value, now: datetime) -> datetime | int | float | str:
    """A range bound: a number, a date, or date math such as ``now/d-8d``."""
    if not isinstance(value, str) or not value.startswith("now"):
        if isinstance(value, str):
            try:
                return datetime.fromisoformat(value)
            except ValueError:
                return value
        return value
    at, rest = now, value[3:]
    for part in re.findall(r"/[smhd]|[+-]\d+[smhdw]|.", rest):
        if part[0] == "/":
            at = at.replace(microsecond=0, **dict.fromkeys(("second", "minute", "hour")[: "smhd".index(part[1])], 0))
        elif re.fullmatch(r"[+-]\d+[smhdw]", part):
            unit = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}[part[-1]]
            at += timedelta(**{unit: int(part[:-1])})
        else:
            raise BadQuery(f"date math: {value}")
    return at


def _one(body) -> tuple:
    if not isinstance(body, dict) or len(body) != 1:
        raise BadQuery("one field expected")
    return next(iter(body.items()))


def analyse(query: str) -> list[str]:
    """The analysed tokens of a query text, on the driver."""
    kept = [w for w in re.findall(r"[^\W]+", query.lower()) if w not in T.STOP_WORDS]
    return [unicodedata.normalize("NFKD", w).encode("ascii", "ignore").decode() for w in kept]


def maybe(text: Column, words: list[str], every: bool = False) -> Column:
    """What any text that holds the analysed words fulfils, cheaply: a text in ASCII has
    them as they are."""
    lower = F.lower(text)
    tests = [F.contains(lower, F.lit(w)) for w in words]
    out = tests[0]
    for test in tests[1:]:
        out = out & test if every else out | test
    return out | text.rlike(r"[^\x00-\x7F]")


def predicate(query: str | dict | None, now: datetime | None = None) -> Column:
    """A condition on documents; an empty query matches all. Raises BadQuery."""
    if isinstance(query, str):
        try:
            query = json.loads(query) if query.strip() else None
        except ValueError as e:
            raise BadQuery(str(e)) from e
    if not query:
        return F.lit(True)
    query = query.get("query", query) if set(query) == {"query"} else query
    now = now or datetime.now()
    kind, body = _one(query)
    if kind == "match_all":
        return F.lit(True)
    if kind in ("term", "terms"):
        field, values = _one(body)
        values = values if isinstance(values, list) else [values]
        if kind == "term" and len(values) != 1:
            raise BadQuery("term takes one value")
        if field in ARRAYS:
            return F.arrays_overlap(F.col(field), F.array(*[F.lit(v) for v in values]))
        return F.col(field).isin(values)
    if kind == "match":
        field, wanted = _one(body)
        operator = "or"
        if isinstance(wanted, dict):
            operator, wanted = str(wanted.get("operator", "or")).lower(), wanted.get("query", "")
        words = analyse(str(wanted))
        if not words:
            return F.lit(False)
        words = list(dict.fromkeys(words))
        near = maybe(F.col(field), words, operator == "and")
        have, wanted = T.analyzed(F.col(field)), F.array(*[F.lit(w) for w in words])
        return near & (F.size(F.array_except(wanted, have)) == 0 if operator == "and" else F.arrays_overlap(have, wanted))
    if kind == "range":
        field, bounds = _one(body)
        out = F.lit(True)
        tests = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}
        for name, value in bounds.items():
            if name not in tests:
                raise BadQuery(f"range: {name}")
            value = moment(value, now)
            value = F.lit(value).cast("timestamp_ntz") if isinstance(value, datetime) else F.lit(value)
            out &= tests[name](F.col(field), value)
        return out
    if kind == "filtered":
        if not set(body) <= {"query", "filter"}:
            raise BadQuery("filtered takes query and filter")
        return predicate(body.get("filter"), now) & predicate(body.get("query"), now)
    if kind == "bool":
        if not set(body) <= {"must", "should", "must_not"}:
            raise BadQuery("bool takes must, should and must_not")
        parts = {k: v if isinstance(v, list) else [v] for k, v in body.items()}
        out = F.lit(True)
        for q in parts.get("must", []):
            out &= predicate(q, now)
        for q in parts.get("must_not", []):
            out &= ~predicate(q, now)
        if parts.get("should") and not parts.get("must"):
            some = F.lit(False)
            for q in parts["should"]:
                some |= predicate(q, now)
            out &= some
        return out
    raise BadQuery(f"unknown query: {kind}")


def wanted_words(query: str | dict | None) -> list[str]:
    """The analysed words that a query's documents are scored by: those of its match
    parts, but for negated ones."""
    if isinstance(query, str):
        query = json.loads(query) if query.strip() else None
    out: list[str] = []
    if isinstance(query, dict):
        for kind, body in query.items():
            if kind == "match":
                _, wanted = _one(body)
                out += analyse(str(wanted.get("query", "") if isinstance(wanted, dict) else wanted))
            elif kind in ("query", "filtered", "bool", "must", "should"):
                out += wanted_words(body)
    elif isinstance(query, list):
        for q in query:
            out += wanted_words(q)
    return list(dict.fromkeys(out))


def relevance(docs: DataFrame, words: str | list[str], field: str = "content", key: str = "_id") -> DataFrame:
    """(key, score) of the documents that hold any of the words (of a query text, or
    analysed ones): the sum over the words of
    sqrt(tf) * (1 + ln(n / (df + 1)))^2 / sqrt(length).

    Texts are analysed once, and only those that may hold a word; what is kept of each is
    its key, its length and a count a word. Keys should be unique."""
    words = list(dict.fromkeys(analyse(words) if isinstance(words, str) else words))
    if not words:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    wanted = F.array(*[F.lit(w) for w in words])
    held = docs.where(maybe(F.col(field), words)).select(key, T.analyzed(F.col(field)).alias("_t"))
    held = held.select(key, F.size("_t").alias("_size"), F.filter("_t", lambda x: x.isin(words)).alias("_own"))
    path = shared_folder(docs.sparkSession)
    held.write.parquet(path)  # read twice: for the counts and for the scores; a filter here would analyse anew
    held = docs.sparkSession.read.schema(held.schema).parquet(path).where(F.size("_own") > 0)
    held = held.select(key, "_size", F.transform(wanted, lambda w: F.size(F.filter("_own", lambda x: x == w))).alias("_tf"))
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("_n"))
    df = held.agg(*[F.count(F.when(F.col("_tf")[i] > 0, 1)).alias(f"_d{i}") for i in range(len(words))])
    score = F.lit(0.0)
    for i in range(len(words)):
        score += F.sqrt(F.col("_tf")[i]) * F.pow(1 + F.log(F.col("_n") / (F.col(f"_d{i}") + 1.0)), F.lit(2.0))
    # two one-row sums
    return held.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(df)).select(key, (score / F.sqrt("_size")).alias("score"))

"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression, an action and a rank. From the literal tokens that
every match must contain, the one that the fewest urls of the table have becomes its
index key. The tokens of a url fetch candidate rules, and only those run their
expression; rules without a literal token are candidates everywhere.

The tokens of a rule are read off its expression (``literal_tokens``). Rules are sent
out in slices of at most SLICE_RULES, each a broadcast of its own; a url goes through all
slices, so their number isn't bounded.

Defined results: a null url, or one without ``://``, has an empty host and path and
gets the default verdict; urls of any length are judged whole. Repeated rows are judged
alike; of rules with one rank the larger name wins; an empty table gives an empty result,
no rules give the default verdict; other columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbarium.llm.common import buffered, opened, shared

#: Literal tokens are runs of these characters, in urls whose A-Z are lower-cased.
TOKEN = "[0-9a-z]+"
SLICE_RULES = 200_000
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in ``host + "\\n" + path``; of all rules that match, the
    one with the highest rank decides, ties by name."""

    name: str | None
    pattern: str
    tokens: tuple[str, ...]
    action: str
    rank: int


#: Parts of an expression: a character that every match has, a place or character that
#: no token goes over, or anything.
_EDGE, _ANY = "edge", "any"
_PARTS = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?:|\(\?|.", re.S)
#: What may come after a part, and whether the part may then be missing.
_REPEAT = re.compile(r"[*?]|\+|\{(\d*)(?:,\d*)?\}")


def _parts(pattern: str, at: int = 0) -> tuple[list[list], int]:
    """(alternatives, where they end) of a pattern or of a group's inside."""
    out: list[list] = [[]]
    while at < len(pattern):
        got = _PARTS.match(pattern, at)[0]
        at += len(got)
        if got == ")":
            break
        if got == "|":
            out.append([])
            continue
        if got in ("(", "(?:"):
            inside, at = _parts(pattern, at)
            if all(x == [_EDGE] or (len(x) == 1 and x[0] not in (_EDGE, _ANY) and x[0] not in _ALNUM) for x in inside):
                own = [_EDGE]
            else:
                own = inside[0] if len(inside) == 1 else [_ANY]
        elif got.startswith("["):
            own = [_ANY if any(re.fullmatch(got, c) for c in _ALNUM) else _EDGE]
        elif got in ("^", "$", r"\A", r"\Z", r"\b", r"\s", r"\W"):
            own = [_EDGE]
        elif got == ".":
            own = [_ANY]
        elif got.startswith("\\"):
            own = [{"n": "\n", "t": "\t", "r": "\r"}.get(got[1], _ANY) if got[1].isalnum() else got[1]]
        else:
            own = [got]
        again = _REPEAT.match(pattern, at)
        if again and again[0] != "{}":  # that one, like other braces, is plain text
            at = again.end()
            if at < len(pattern) and pattern[at] in "?+":
                at += 1
            # what is there at least once still parts tokens; what a token is made of may go on
            parts = len(own) == 1 and own != [_ANY] and (own == [_EDGE] or own[0] not in _ALNUM)
            sure = again[0] == "+" or int(again[1] or 0) > 0
            own = [_EDGE] if sure and parts else [_ANY]
        out[-1] += own
    return out, at


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """Whole tokens that every match of an expression contains. Expressions with
    alternatives at their top, or with flags or look-around, give none."""
    if "(?" in pattern.replace("(?:", ""):
        return ()
    ways, _ = _parts(pattern)
    if len(ways) > 1:
        return ()
    out, run, whole = [], "", False
    for part in [*ways[0], _ANY]:
        if part not in (_EDGE, _ANY) and part in _ALNUM:
            run += part
            continue
        if run and whole and part != _ANY:
            out.append(run.translate(_FOLD))
        run, whole = "", part != _ANY
    return tuple(dict.fromkeys(out))


def host_rule(action: str, rule: str) -> Rule:
    """A rule (host, path prefix), such as ``example.org/en/``: it fits the host and
    all its subdomains; a longer rule wins."""
    host, slash, path = rule.partition("/")
    pattern = rf"(?:\A|\.){re.escape(host)}\n{re.escape(slash + path)}"
    return Rule(rule, pattern, literal_tokens(pattern), action, 1000 + len(rule))


def pattern_rule(action: str, pattern: str, name: str | None = None) -> Rule:
    """A rule by an expression, below all host rules."""
    return Rule(name, pattern, literal_tokens(pattern), action, 0)


def read_rules(spark: SparkSession, path: str) -> Iterator[Rule]:
    """Rules of a text file: on each line ``allow`` or ``block``, white space, and a host
    with a path, or an expression between slashes. Empty lines and those that begin with
    ``#`` are skipped; a line of another kind raises."""
    for row in spark.read.text(path).toLocalIterator():
        line = row[0].strip()
        if not line or line.startswith("#"):
            continue
        action, _, rule = line.partition(" ")
        rule = rule.strip()
        if action not in ("allow", "block") or not rule:
            raise ValueError(f"not a rule: {line!r}")
        if len(rule) > 1 and rule.startswith("/") and rule.endswith("/"):
            yield pattern_rule(action, rule[1:-1], rule)
        else:
            yield host_rule(action, rule)


#: The method's own list: shapes of advertising, tracking and session urls.
OWN_RULES = (
    pattern_rule("block", r"(?:\A|\.)(?:ads?|adserver|banner|tracker|doubleclick)\."),
    *(pattern_rule("block", rf"\n[^?#]*/{word}(?:/|\Z)") for word in ("ads", "adserver", "banners", "track", "tracking", "pixel", "popup", "casino", "porn", "xxx", "viagra", "login", "signin", "cart", "checkout")),
    *(pattern_rule("block", rf"\.{end}\Z") for end in ("exe", "zip", "jpg", "jpeg", "png", "gif", "mp3", "mp4", "avi", "css", "js")),
)

PARTS = "host string, path string, rule string, verdict string"


def tokens_of(text: str) -> set[str]:
    return set(re.findall(TOKEN, text))


def host_and_path():
    """(host, path) Column expressions of a column ``url``."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    host = F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def token_counts(urls: DataFrame, wanted: list[str]) -> dict[str, int]:
    """How many urls have each of a slice's tokens; no more rows reach the driver."""
    if not wanted:
        return {}
    folded = F.translate(F.concat_ws("\n", "host", "path"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0)))).alias("token"))
    if len(wanted) <= 500:
        found = found.where(F.col("token").isin(wanted))
    else:  # at most as many rows as a slice's rules have tokens
        found = found.join(F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")), "token")
    return {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}


def index_rules(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Rules by their rarest token, and those without one."""
    by_token: dict[str, list[Rule]] = {}
    rest = []
    for rule in rules:
        if rule.tokens:
            by_token.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
        else:
            rest.append(rule)
    return by_token, rest


def judge(pages: DataFrame, rules: Iterable[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (the name of the deciding rule, else null) and verdict
    of every row."""
    host, path = host_and_path()
    urls = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("url")).select("_id", host.alias("host"), path.alias("path"))
    id_type, rules, held = dict(pages.dtypes)[id_col], iter(rules), []
    while part := tuple(islice(rules, SLICE_RULES)):
        wanted = sorted({t for r in part for t in r.tokens})
        held.append(shared(pages.sparkSession, index_rules(part, token_counts(urls, wanted))))

    def decide(texts: list[str], decided: list[Rule | None], index: tuple, compiled: dict[str, re.Pattern]) -> None:
        by_token, rest = index
        for i, text in enumerate(texts):
            best = decided[i]
            candidates = [r for t in tokens_of(text.translate(_FOLD)) for r in by_token.get(t, ())]
            for rule in (*candidates, *rest):
                if best is not None and (rule.rank, rule.name or "") <= (best.rank, best.name or ""):
                    continue
                if rule.pattern not in compiled:
                    compiled[rule.pattern] = re.compile(rule.pattern)
                if compiled[rule.pattern].search(text):
                    best = rule
            decided[i] = best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, compiled = opened(held[0]) if len(held) == 1 else None, {}
        for group in buffered(batches):
            texts = [[f"{h}\n{p}" for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)] for batch in group]
            decided: list[list[Rule | None]] = [[None] * len(x) for x in texts]
            for value in held:  # each slice is opened once for a group of batches
                index = one or opened(value)
                if not one:
                    compiled.clear()
                for own, best in zip(texts, decided, strict=True):
                    decide(own, best, index, compiled)
                del index
            for batch, best in zip(group, decided, strict=True):
                names, verdicts = [r.name if r else None for r in best], [r.action if r else default for r in best]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())], ["_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(run, f"_id {id_type}, {PARTS}").withColumnRenamed("_id", id_col)

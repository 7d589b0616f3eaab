"""Personal data: candidates of high recall, boosted trees, calibrated thresholds.

Four kinds are looked for: email, ip, card, phone. Base spans follow from fixed patterns
and checks and always stay. Besides, generators propose overlapping spans in the looser
forms that people use: addresses with ``at`` and ``dot`` in words or brackets, addresses
of hosts with defanged dots and of version 6, cards with other separators or next to other
numbers, telephone numbers without a plus sign. Gradient boosted trees score a candidate
by its format (digits, groups, check digit, ranges, separators) and its context (the
characters next to it, digits near by, words that point to a kind or away from it).
Candidates above their kind's threshold are taken by score, none that overlaps a base span
(unless it holds one of its own kind whole) or a better candidate.

There are no labels of spans. The trees learn from base spans of the corpus in their own
contexts, from the same data written in looser forms, and from look-alikes (dates,
versions, prices, ISBNs, ids, digests, prose) put in the same contexts; of the candidates
that the generators propose there, those that are exactly what was put there are positive.
A quarter of the contexts is held out: it fits the calibration (a logistic curve) and each
kind's threshold, the lowest with the asked precision.

Defined results: null and empty texts have no spans; a text's spans depend on the text and
the model alone, so repeated rows have equal ones; ties of scores go to the kind listed
first, then the earlier start, then the longer span; other columns are ignored; an empty
table gives an empty result; a corpus without any base span gives contexts of nothing, and
the model is trained on those. Numbers of any length are read in linear time. Positions are
code points, ends exclusive."""

from __future__ import annotations

import bisect
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import materialize, runs_of

KINDS = ("email", "ip", "card", "phone")
#: Characters of context on either side that features see.
CONTEXT = 48
SPANS = "array<struct<kind: string, start: int, end: int, base: boolean, score: double>>"

Span = tuple[int, int, int]  # number of the kind, start, end


# ------------------------------------------------------------------ base spans

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    """At most 255, however many zeros lead."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def base_spans(text: str) -> list[Span]:
    """The spans that the fixed patterns find, by kind and start. The patterns are
    followed from what they can't do without, so that a text costs time in proportion."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        piece = text[last:at]
        local = len(piece) - len(piece.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if local else None
        if found:
            out.append((0, at - local, found.end()))
        last = max(at + 1, found.end() if found else 0)
        at = text.find("@", last)
    for chain in _DOTTED.finditer(text):
        if chain.end() - chain.start() >= 7:
            parts = list(_DIGITS.finditer(text, *chain.span()))
            for k in range(0, len(parts) - 3, 4):
                if all(_small(p[0]) for p in parts[k : k + 4]):
                    out.append((1, parts[k].start(), parts[k + 3].end()))
    for found in _CARD.finditer(text):
        if 16 <= found.end() - found.start() <= 37 and 16 <= len(digits := _digits(found[0])) <= 19 and luhn(digits):
            out.append((2, *found.span()))
    at = text.find("+")
    while at >= 0:
        found = _PHONE.match(text, at)
        if found and 8 <= len(_digits(found[0])) <= 15:
            out.append((3, *found.span()))
        at = text.find("+", found.end() if found else at + 1)
    return sorted(out)


# ----------------------------------------------------------------- generators

_AT_SIGN = re.compile("[@＠]")
_AT_WORDS = tuple(re.compile(rf"{word}(?=[\s\])}}>])") for word in ("at", "At", "AT"))
_OPEN, _CLOSE = re.compile(r"\s?[\[({<]?\s?\Z"), re.compile(r"\s?[\])}>]?\s?")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_DOT = r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s|\.)"
_LOOSE_DOMAIN = re.compile(rf"[\w-]{{1,63}}(?:{_DOT}[\w-]{{1,63}}){{1,8}}", re.IGNORECASE)
_LOOSE_LOCAL = re.compile(r"[\w.%+'-]+\Z")
_LOOSE_IP = re.compile(rf"[0-9]{{1,4}}(?:{_DOT}[0-9]{{1,4}}){{3}}", re.IGNORECASE)
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_CHAIN = re.compile(r"[0-9]+(?:[\x20   ().‐-―·/_-]{1,3}[0-9]+)*")
_LEAD = re.compile(r"(?:\+ ?|\(\+?|\+\()\Z")


def loose_spans(text: str) -> list[Span]:
    """Overlapping spans that may be personal data."""
    out: list[Span] = []
    for sign, at in (*((True, m) for m in _AT_SIGN.finditer(text)), *((False, m) for word in _AT_WORDS for m in word.finditer(text))):
        before = at.start() - 1
        if not sign and (before < 0 or text[before].isalnum() or text[before] in "._-'"):
            continue
        left = _OPEN.search(text, max(0, before - 2), at.start()).start()
        found = _LOOSE_DOMAIN.match(text, _CLOSE.match(text, at.end()).end())
        local = _LOOSE_LOCAL.search(text, max(0, left - 64), left) if found else None
        if local:
            out.append((0, local.start(), found.end()))
    for found in _LOOSE_IP.finditer(text):
        out.append((1, *found.span()))
    if _COLONS.search(text):
        out += [(1, *found.span()) for found in _IP6.finditer(text)]
    for chain in _CHAIN.finditer(text):
        if chain.end() - chain.start() < 7:
            continue
        groups = [g.span() for g in _DIGITS.finditer(text, *chain.span())]
        for i, (start, _) in enumerate(groups):
            lead = _LEAD.search(text, max(0, start - 2), start)
            count = 0
            for k, (a, b) in enumerate(groups[i : i + 7]):
                count += b - a
                if count > 19:
                    break
                if 13 <= count and k < 6 and luhn(_digits(text[start:b])):
                    out.append((2, start, b))
                if 7 <= count <= 15:
                    out.append((3, start, b))
                    if lead:
                        out.append((3, lead.start(), b))
    return out


# ------------------------------------------------------------------- features

#: Words before a span that point to a kind, or away from all.
CUES = (
    ("mail", "email", "e-mail", "contact", "write", "reach", "correo", "courriel", "schreiben", "address"),
    ("ip", "host", "server", "addr", "address", "ping", "login", "client", "gateway", "dns"),
    ("card", "visa", "amex", "mastercard", "credit", "debit", "karte", "carte", "tarjeta", "payment"),
    ("tel", "phone", "call", "fax", "mobile", "cell", "whatsapp", "sms", "telefon", "handy", "movil", "dial"),
    ("version", "ver", "v", "release", "build", "isbn", "issn", "order", "invoice", "ref", "id", "no", "serial", "sku", "page", "section", "chapter", "date", "on", "doi", "from", "since", "costs", "total", "lot", "code"),
)
#: Frequent last labels of domains.
LAST_LABELS = frozenset("com org net edu gov int info io co de fr es uk eu it nl ch at us ca au jp cn br ru in dev app me tv biz".split())
_SHAPES = {(4, 4, 4, 4): 1, (3, 3, 4): 2, (1, 3, 3, 4): 3, (4, 6, 5): 4, (4, 2, 2): 5, (2, 2, 4): 6, (2, 2, 2): 7, (3, 4): 8, (2, 3, 3, 4): 9, (16,): 10, (10,): 11, (4, 6, 4): 12, (2, 2, 2, 2, 2): 13, (3, 1, 2, 6, 1): 14, (5, 6): 15, (3, 7): 16, (8,): 17}
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def _next_to(text: str, at: int) -> int:
    """The class of a character next to a span."""
    if not 0 <= at < len(text):
        return 0
    c = text[at]
    return 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:!?)\"'(" else 5 if c in "-/_=#@+$%&" else 6


def _issued(digits: str) -> bool:
    """Number ranges and lengths of the large card issuers."""
    n, head = len(digits), int(digits[:4] or 0)
    return digits[:1] == "4" and n in (13, 16, 19) or n == 16 and (51 <= head // 100 <= 55 or 2221 <= head <= 2720 or head == 6011 or head // 100 == 65) or n == 15 and head // 100 in (34, 37)


def features(kind: int, left: str, span: str, right: str) -> list[float]:
    """Format and context of a candidate, in numbers; contexts have CONTEXT characters."""
    groups = _DIGITS.findall(span)
    digits = "".join(groups)
    rest = _DIGITS.sub("", span)
    near = [w.lower() for w in _WORDS.findall(left[-28:])[-3:]]
    labels = re.split(r"[^\w]+|_", span.lower())
    spelled = span.lower()
    at_style = 0 if kind else 3 if re.search(r"\sat\s", spelled) else 2 if re.search(r"\s[@＠]|[@＠]\s", spelled) else 1 if re.search(r"[\[({<]\s?(?:at|@)", spelled) else 0
    dot_style = 2 if re.search(r"\sdot\s", spelled) else 1 if re.search(r"[\[({<]\s?(?:dot|\.)", spelled) else 0
    local = re.split(r"\sat\s|[@＠]|[\[({<]", span, maxsplit=1, flags=re.IGNORECASE)[0] if not kind else ""
    beyond = right[1:2] if right[:1] in (".", ",", ":", "-", "/") else ""
    return [
        kind, len(digits), len(groups), len(span), len(set(rest)), float(luhn(digits)) if digits else -1, float(span[:1] == "+"), float(any(c in "([{" for c in span)),
        max(int(g[-4:]) if len(g) < 5 else 9999 for g in groups) if groups else -1, _SHAPES.get(tuple(map(len, groups)), 0), int(digits[0]) if digits else -1,
        _next_to(left, len(left) - 1), _next_to(right, 0), float(beyond.isalnum()), *(float(any(w in cues for w in near)) for cues in CUES),
        float(labels[-1] in LAST_LABELS), float(any(c in "._+-" or c.isdigit() for c in local)), at_style, dot_style,
        sum(c.isdigit() for c in left[-12:]), sum(c.isdigit() for c in right[:12]), sum(bool(x) for x in labels), float(_issued(digits)), float(any(c in "abcdefABCDEF" for c in rest)) if kind == 1 else -1.0,
        float("::" in span), float("." in rest), float("-" in rest), float("/" in rest), float(" " in rest), float(span.startswith("00")), len(local), max(map(len, groups), default=0), min(map(len, groups), default=0),
    ]


# ---------------------------------------------------------------- boosted trees


@dataclass(frozen=True)
class Settings:
    """``contexts`` bounds the sample: at most so many distinct base spans of each kind,
    with CONTEXT characters on either side, those with the smallest hash of both.
    ``precision``: what a kind's threshold must reach on the held-out quarter."""

    contexts: int = 600
    trees: int = 80
    depth: int = 4
    rate: float = 0.2
    ridge: float = 1.0
    bins: int = 32
    precision: float = 0.99
    seed: int = 5


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)))
    return (values[1:] + values[:-1]) / 2


def grow(x: np.ndarray, y: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Newton boosting of complete binary trees on histograms: (feature of each inner
    node, threshold of each, value of each leaf) by tree, and the first logit."""
    n, width = x.shape
    edges = [_edges(x[:, f], settings.bins) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    bins, inner = settings.bins + 2, (1 << settings.depth) - 1
    share = (y.sum() + 1) / (n + 2)
    first = float(np.log(share / (1 - share)))
    logit = np.full(n, first)
    which, cut, leaf = np.zeros((settings.trees, inner), dtype=np.int64), np.full((settings.trees, inner), np.inf), np.zeros((settings.trees, inner + 1))
    for t in range(settings.trees):
        p = 1 / (1 + np.exp(-logit))
        slope, bend = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, dtype=np.int64)
        for level in range(settings.depth):
            nodes = 1 << level
            best = np.full(nodes, 1e-6)
            own_feature, own_bin = np.zeros(nodes, dtype=np.int64), np.full(nodes, bins)
            whole_g, whole_h = np.bincount(node, slope, nodes), np.bincount(node, bend, nodes)
            whole = whole_g**2 / (whole_h + settings.ridge)
            for f in range(width):
                if not len(edges[f]):
                    continue
                place = node * bins + binned[:, f]
                g = np.bincount(place, slope, nodes * bins).reshape(nodes, bins).cumsum(axis=1)
                h = np.bincount(place, bend, nodes * bins).reshape(nodes, bins).cumsum(axis=1)
                gain = g**2 / (h + settings.ridge) + (whole_g[:, None] - g) ** 2 / (whole_h[:, None] - h + settings.ridge) - whole[:, None]
                gain[(h < 0.5) | (whole_h[:, None] - h < 0.5)] = 0
                k = gain[:, : len(edges[f])].argmax(axis=1)
                won = gain[np.arange(nodes), k] > best
                best[won], own_feature[won], own_bin[won] = gain[np.arange(nodes), k][won], f, k[won]
            for c in range(nodes):
                if own_bin[c] < bins:
                    which[t, nodes - 1 + c], cut[t, nodes - 1 + c] = own_feature[c], edges[own_feature[c]][own_bin[c]]
            node = 2 * node + (binned[np.arange(n), own_feature[node]] > own_bin[node])
        leaf[t] = -settings.rate * np.bincount(node, slope, inner + 1) / (np.bincount(node, bend, inner + 1) + settings.ridge)
        logit += leaf[t][node]
    return which, cut, leaf, first


def logits(x: np.ndarray, trees: tuple[np.ndarray, np.ndarray, np.ndarray, float]) -> np.ndarray:
    which, cut, leaf, first = trees
    out, rows = np.full(len(x), first), np.arange(len(x))
    depth = int(leaf.shape[1]).bit_length() - 1
    for t in range(len(leaf)):
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            at = (1 << level) - 1 + node
            node = 2 * node + (x[rows, which[t, at]] > cut[t, at])
        out += leaf[t][node]
    return out


def curve(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits the held-out logits (Newton steps
    towards slightly softened labels)."""
    a, b = 1.0, 0.0
    soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        ga, gb = ((p - soft) * logit).sum() + 1e-3 * (a - 1), (p - soft).sum() + 1e-3 * b
        haa, hab, hbb = (w * logit**2).sum() + 1e-3, (w * logit).sum(), w.sum() + 1e-3
        det = haa * hbb - hab**2
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    return float(a), float(b)


@dataclass(frozen=True)
class Model:
    trees: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    slope: float
    shift: float
    thresholds: tuple[float, ...]

    def plain(self) -> tuple:
        """As values that need no class to be read."""
        return self.trees, self.slope, self.shift, self.thresholds


def scores(x: np.ndarray, plain: tuple) -> np.ndarray:
    trees, slope, shift, _ = plain
    return 1 / (1 + np.exp(-np.clip(slope * logits(x, trees) + shift, -40, 40)))


# ------------------------------------------------------------- training examples


class _Draw:
    """Numbers and choices for one context, from its hash alone."""

    def __init__(self, key: str):
        self.rng = np.random.default_rng(int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "little"))

    def of(self, items):
        return items[int(self.rng.integers(len(items)))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def below(self, n: int) -> int:
        return int(self.rng.integers(n))

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)


def _card_number(draw: _Draw) -> str:
    head, n = draw.of([("4", 16), ("4", 16), ("51", 16), ("55", 16), ("37", 15), ("6011", 16), ("4", 13), ("2300", 16)])
    body = head + draw.digits(n - len(head) - 1)
    return next(body + c for c in "0123456789" if luhn(body + c))


def _looser(kind: int, span: str, draw: _Draw) -> str:
    """Personal data of a base span, or drawn, in a form that people write."""
    if kind == 0:
        local, _, domain = (span or f"{draw.of(['jane', 'm.lopez', 'k_weber', 'info', 'paul'])}{draw.of(['', '.', '7', '88'])}@{draw.of(['mail', 'example', 'post-box'])}.{draw.of(['com', 'org', 'de', 'fr', 'co.uk'])}".replace(".@", "@")).partition("@")
        at, dot = draw.of([(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" @ ", "."), (" AT ", " DOT "), ("@", "[.]"), ("{at}", "{dot}"), ("＠", "."), (" at ", "."), ("@", ".")])
        return local + at + domain.replace(".", dot)
    if kind == 1:
        if draw.chance(0.25):
            parts = [f"{draw.below(1 << 16):x}" for _ in range(8)]
            return ":".join(parts) if draw.chance(0.6) else ":".join(parts[:3]) + "::" + parts[-1]
        return (span or ".".join(str(draw.below(256)) for _ in range(4))).replace(".", draw.of(["[.]", "(.)", "[dot]", " dot ", ".", "(dot)"]))
    if kind == 2:
        digits = _digits(span) if span and draw.chance(0.4) else _card_number(draw)
        groups = [digits[:4], digits[4:10], digits[10:]] if len(digits) == 15 and draw.chance(0.6) else [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return draw.of([" ", "-", ".", " ", "/", "", " - ", "–", "  "]).join(groups)
    area, head, tail = str(2 + draw.below(8)) + draw.digits(2), draw.digits(3), draw.digits(4)
    return draw.of([f"({area}) {head}-{tail}", f"{area}-{head}-{tail}", f"{area}.{head}.{tail}", f"001 {area} {head} {tail}", f"+1/{area}/{head}-{tail}", f"{area} {head} {tail}", f"1-{area}-{head}-{tail}", f"({area}){head}-{tail}", f"0{area[:2]} {head} {tail}", f"0{draw.digits(1)} {' '.join(draw.digits(2) for _ in range(4))}", f"+1 {area}–{head}–{tail}", f"+{draw.digits(2)} (0) {area} {head}{tail}", f"{area}/{head}{tail}", f"00{draw.digits(2)} {area} {head}{tail}"])


def _look_alike(draw: _Draw) -> str:
    """What isn't personal data but looks like it."""
    year, month, day = str(1900 + draw.below(150)), f"{1 + draw.below(12):02d}", f"{1 + draw.below(28):02d}"
    number = str(1 + draw.below(9)) + draw.digits(6 + draw.below(14))
    bad = next(n for n in (draw.digits(16) for _ in range(99)) if not luhn(n))
    return draw.of([
        f"{year}-{month}-{day}", f"{day}/{month}/{year}", f"{day}.{month}.{year}", f"{year}.{month}.{day}", f"{day}-{month}-{year}", f"{year}{month}{day}", f"{year}-{month}-{day} {day}:{month}:{draw.digits(2)}", f"{year}-{int(year) + 9}",
        f"v{draw.below(20)}.{draw.below(20)}.{draw.below(300)}.{draw.below(20)}", f"{draw.below(20)}.{draw.below(20)}.{256 + draw.below(9000)}.{draw.below(2000)}", f"{draw.below(9)}.{draw.below(20)}.{draw.below(20)}", f"{draw.below(9)}.{draw.below(9)}.{draw.below(9)}.{draw.below(9)}.{draw.below(9)}",
        f"{draw.digits(1)}.{draw.digits(9)}", f"{draw.below(900)},{draw.digits(3)},{draw.digits(3)}", f"{1 + draw.below(900)} {draw.digits(3)} {draw.digits(3)}", f"{1 + draw.below(900)}.{draw.digits(3)}.{draw.digits(3)}", f"{draw.digits(2)}.{draw.digits(4)}, {draw.digits(2)}.{draw.digits(4)}",
        f"978-{draw.digits(1)}-{draw.digits(2)}-{draw.digits(6)}-{draw.digits(1)}", f"978{draw.digits(10)}", number, f"#{number}", f"{number}{draw.of(['px', 'kB', 'k', 'th'])}", f"{draw.of(['A', 'ID', 'x', 'ref'])}{number}", f"{draw.digits(3)}-{draw.digits(2)}", " ".join(draw.digits(1 + draw.below(3)) for _ in range(3 + draw.below(9))),
        " ".join(bad[i : i + 4] for i in range(0, 16, 4)), bad, "-".join(bad[i : i + 4] for i in range(0, 16, 4)), f"{draw.digits(8)}-{draw.digits(4)}-{draw.digits(4)}-{draw.digits(4)}-{draw.digits(12)}",
        hashlib.sha1(number.encode()).hexdigest(), f"{draw.below(24)}:{draw.digits(2)}:{draw.digits(2)}", f"{draw.digits(2)}:{draw.digits(2)}:{draw.digits(2)}:{draw.digits(3)}", f"std::{draw.of(['map', 'add', 'face'])}::{draw.of(['be', 'cafe', 'a'])}",
        f"{draw.below(99)} @ {draw.below(9)}.{draw.digits(2)}", f"@{draw.of(['jane', 'news', 'team'])} is here.", f"look at the dot {draw.of(['on', 'in', 'there'])} it", f"was at {draw.of(['noon', 'home', 'school'])}. {draw.of(['It', 'He', 'Then'])} went", f"sold at {draw.below(99)}.{draw.digits(2)} each", f"points at node.{draw.of(['left', 'next', 'value', 'id'])} now", f"user@{draw.of(['host', 'localhost', 'server'])}", f"meet at {draw.of(['one', 'the'])} dot{draw.of(['s', 'ted', ''])} line", f"{draw.digits(4)}-{draw.digits(4)}", f"{draw.digits(2)}-{draw.digits(2)}-{draw.digits(2)}", f"1:{draw.digits(4)}-{draw.digits(5)}", f"{draw.digits(3)}/{draw.digits(3)}",
    ])


def examples(contexts: list[tuple[int, str, str, str]], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, whether held out) of the candidates that the generators propose
    in each context: (kind, left, span, right)."""
    x, y, held = [], [], []

    def add(left: str, payload: str, right: str, kind: int | None, aside: bool) -> None:
        text, a, b = left + payload + right, len(left), len(left) + len(payload)
        for k, s, e in {*loose_spans(text), *base_spans(text)}:
            if s < b and e > a:
                x.append(features(k, text[max(0, s - CONTEXT) : s], text[s:e], text[e : e + CONTEXT]))
                y.append(float((k, s, e) == (kind, a, b)))
                held.append(aside)

    for i, (kind, left, span, right) in enumerate(contexts):
        draw = _Draw(f"{seed}|{i}|{left}|{span}|{right}")
        aside = draw.chance(0.25)
        add(left, span, right, kind if span else None, aside)
        for other in range(len(KINDS)):
            cue = draw.of(CUES[other]) + draw.of([" ", ": ", "  ", "="]) if draw.chance(0.3) else ""
            if other and draw.chance(0.2):  # another number before
                cue += draw.of([_card_number(draw), draw.digits(1 + draw.below(5)), draw.digits(16)]) + draw.of([" ", ", "])
            add(left + cue, _looser(other, span if other == kind else "", draw), right, other, aside)
        for _ in range(5):
            cue = draw.of(CUES[-1]) + draw.of([" ", ": ", " "]) if draw.chance(0.3) else ""
            add(left + cue, _look_alike(draw), right, None, aside)
    return np.array(x), np.array(y), np.array(held)


def learn(contexts: list[tuple[int, str, str, str]], settings: Settings = Settings()) -> Model:
    if len(contexts) < 200:  # too few to tell: contexts of plain spaces besides
        contexts = contexts + [(0, " " * (i % 2), "", " " * (i % 3 > 0)) for i in range(200)]
    x, y, held = examples(contexts, settings.seed)
    trees = grow(x[~held], y[~held], settings)
    own, truth = logits(x[held], trees), y[held]
    slope, shift = curve(own, truth)
    p = 1 / (1 + np.exp(-np.clip(slope * own + shift, -40, 40)))
    thresholds = []
    for kind in range(len(KINDS)):
        mine = x[held][:, 0] == kind
        order = np.argsort(-p[mine], kind="stable")
        ranked, right = p[mine][order], truth[mine][order]
        good = np.flatnonzero(np.cumsum(right) >= settings.precision * np.arange(1, len(right) + 1))
        thresholds.append(max(0.5, float(ranked[good[-1]])) if len(good) else 2.0)
    return Model(trees, slope, shift, tuple(thresholds))


# ------------------------------------------------------------------- over tables


def _suspects(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts of a run have a character that candidates can't do without: a digit,
    an at sign, a colon pair, or a spelled dot or at in brackets or a dot inside a word."""
    if not len(buf):
        return np.zeros(len(bounds) - 1, dtype=bool)
    low = buf | 0x20
    mark = (buf >= 48) & (buf <= 57) | (buf == 64) | (buf == 0xEF)
    letter = (low >= 97) & (low <= 122) | (buf >= 128)
    inner = bounds[1:-1][bounds[1:-1] > 0]
    dot = buf == 46
    dot[inner - 1] = False  # the next letter is another text's
    mark[1:-1] |= dot[1:-1] & letter[:-2] & letter[2:]
    mark[:-2] |= (low[:-2] == 100) & (low[1:-1] == 111) & (low[2:] == 116)
    mark[1:] |= (buf[1:] == 58) & (buf[:-1] == 58)
    places = np.flatnonzero(mark)
    return np.searchsorted(places, bounds[1:]) > np.searchsorted(places, bounds[:-1])


def _texts(column: pa.Array) -> Iterator[tuple[int, str]]:
    """(row, text) of the texts that may hold something."""
    for buf, bounds, rows in runs_of(column):
        for i in np.flatnonzero(_suspects(buf, bounds)).tolist():
            yield rows.start + i, buf[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace")


def contexts(docs: DataFrame, most: int, text_col: str = "text") -> list[tuple[int, str, str, str]]:
    """At most ``most`` distinct base spans of each kind with their contexts, those with
    the smallest hash. Each task keeps as many at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[str, tuple]] = [{} for _ in KINDS]
        heaps: list[list[int]] = [[] for _ in KINDS]  # of the negated hashes of what is kept
        for batch in batches:
            for _, text in _texts(batch.column(0)):
                for kind, a, b in base_spans(text):
                    if b - a > 200:
                        continue
                    row = text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT]
                    key = int.from_bytes(hashlib.blake2b("\x00".join(row).encode(), digest_size=7).digest(), "big")
                    heap = heaps[kind]
                    if key in kept[kind] or len(heap) == most and key >= -heap[0]:
                        continue
                    if len(heap) == most:
                        del kept[kind][-heapq.heappop(heap)]
                    heapq.heappush(heap, -key)
                    kept[kind][key] = row
        found = [(kind, key, *row) for kind, rows in enumerate(kept) for key, row in rows.items()]
        columns = zip(*found, strict=True) if found else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["kind", "key", "left", "span", "right"])

    found, _ = materialize(docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").mapInArrow(run, "kind int, key bigint, left string, span string, right string").distinct())
    picked = None
    for kind in range(len(KINDS)):
        part = found.where(F.col("kind") == kind).orderBy("key", "left", "span", "right").limit(most)
        picked = part if picked is None else picked.unionAll(part)
    return sorted((r["kind"], r["left"], r["span"], r["right"]) for r in picked.collect())  # 4 * most rows


def fit(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> Model:
    return learn(contexts(docs, settings.contexts, text_col), settings)


def chosen(texts: list[str], plain: tuple) -> list[list[tuple[int, int, int, bool, float]]]:
    """The spans of each text: (kind, start, end, base, score), by kind and start."""
    base = [base_spans(t) for t in texts]
    owner, spans, rows = [], [], []
    for i, text in enumerate(texts):
        own = sorted((a, b, k) for k, a, b in base[i])
        starts = np.array([a for a, _, _ in own])
        ends = np.maximum.accumulate(np.array([b for _, b, _ in own])) if own else starts
        for kind, a, b in set(loose_spans(text)):
            if own:
                lo, hi = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(starts, b))
                if any(not (k == kind and a <= s and e <= b and (s, e) != (a, b)) for s, e, k in own[lo:hi] if e > a):
                    continue
            owner.append(i)
            spans.append((kind, a, b))
            rows.append(features(kind, text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT]))
    out = [[(k, a, b, True, 1.0) for k, a, b in found] for found in base]
    if rows:
        p = scores(np.array(rows), plain)
        cut = np.array(plain[3])[[k for k, _, _ in spans]]
        taken: dict[int, list[tuple[int, int]]] = {}  # apart from each other, in order
        for score, i, (kind, a, b) in sorted(((s, i, c) for s, t, i, c in zip(p.tolist(), cut.tolist(), owner, spans, strict=True) if s >= t), key=lambda r: (-r[0], r[2][0], r[2][1], -r[2][2])):
            own = taken.setdefault(i, [])
            at = bisect.bisect(own, (a, b))
            if (not at or own[at - 1][1] <= a) and (at == len(own) or b <= own[at][0]):
                own.insert(at, (a, b))
                out[i].append((kind, a, b, False, score))
    return [sorted(found, key=lambda s: s[:3]) for found in out]


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, the columns to keep and ``spans`` (SPANS, by kind as listed and start) of
    every row."""
    plain = docs.sparkSession.sparkContext.broadcast(model.plain())  # bounded by the settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            held: list[tuple[int, str]] = []
            size = 0

            def flush() -> None:
                for (i, _), found in zip(held, chosen([t for _, t in held], plain.value), strict=True):
                    out[i] = [{"kind": KINDS[k], "start": a, "end": b, "base": base, "score": score} for k, a, b, base, score in found]

            for i, text in _texts(batch.column(0)):
                held.append((i, text))
                size += len(text)
                if size > 1 << 22:
                    flush()
                    held, size = [], 0
            flush()
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, kind)], [*batch.schema.names[1:], "spans"])

    columns = [id_col, *[c for c in keep if c != id_col]]
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *columns)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[1:])
    return rows.mapInArrow(run, f"{schema}, spans {SPANS}")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with its spans replaced by their kinds in brackets, the earlier and longer
    span first where they overlap."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b > at:
            out += [text[at:a], f"[{kind.upper()}]"] if a >= at else [""]
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text with all spans replaced by [EMAIL], [IP], [CARD] or [PHONE]."""
    work: Callable = redacted
    found = find(docs.withColumn("_whole", F.col(text_col).cast("string")), model, id_col, "_whole", ("_whole",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not spans or t is None else work(t, [(s["kind"], s["start"], s["end"]) for s in spans]) for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return found.select(id_col, "_whole", "spans").mapInArrow(run, f"`{id_col}` {dict(found.dtypes)[id_col]}, text string")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base spans by kind, the SHA-256 of their list, and the list of all."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        id_col,
        *[F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )

"""Wikitext to plain text (survey I30-I45): one parser inside an Arrow function."""

from __future__ import annotations

import html
import operator
import re
import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH = 30
# Elements whose content goes, whose tags go, that close themselves, and
# that a numbered name stands for.
DISCARDED = "gallery timeline noinclude pre table tr td th caption div form input select option textarea ul li ol dl dt dd menu dir ref references img imagemap source small".split()
IGNORED = "a abbr b big blockquote center cite div em font h1 h2 h3 h4 hiero i kbd nowiki p plaintext s span strike strong sub sup tt u var".split()
CLOSED = "br hr nobr ref references nowiki".split()
PLACEHOLDERS = {"math": "formula", "code": "codice"}
ACCEPTED = {"w", "wiktionary", "wikt"}


def _find_close(text: str, at: int, opening: str, closing: str) -> int:
    """Where the delimiter opened at ``at`` closes (after it); -1 without a match."""
    depth, i = 0, at
    while i < len(text):
        if text.startswith(opening, i):
            depth += 1
            i += len(opening)
        elif text.startswith(closing, i):
            depth -= 1
            i += len(closing)
            if not depth:
                return i
        else:
            i += 1
    return -1


def without_nested(text: str, opening: str, closing: str) -> str:
    """Text without the stretches that two patterns delimit, with all that is nested
    in them. What never closes stays."""
    marks = sorted([(m.start(), m.end(), 1) for m in re.finditer(opening, text)] + [(m.start(), m.end(), -1) for m in re.finditer(closing, text)])
    opened: list[int] = []
    gone: list[tuple[int, int]] = []
    for start, end, step in marks:
        if step > 0:
            opened.append(start)
        elif opened:
            gone.append((opened.pop(), end))
    out, at = [], 0
    for start, end in sorted(gone):
        if start >= at:
            out.append(text[at:start])
        at = max(at, end)
    return "".join([*out, text[at:]])


def split_pipes(text: str) -> list[str]:
    """I32: pieces between pipes outside braces and brackets."""
    out, depth, last = [], 0, 0
    for m in re.finditer(r"\{\{|\}\}|\[\[|\]\]|\|", text):
        if m[0] == "|":
            if not depth:
                out.append(text[last : m.start()])
                last = m.end()
        else:
            depth += 1 if m[0] in ("{{", "[[") else -1
    return [*out, text[last:]]


def parameters(parts: list[str]) -> dict[str, str]:
    """Named and numbered values; the last one of a name counts."""
    out, number = {}, 0
    for part in parts:
        m = re.match(r"\s*([^=|\[\]{}]+?)\s*=(.*)", part, re.S)
        if m:
            out[m[1]] = m[2] if "]]" in m[2] else m[2].strip()
        else:
            number += 1
            out[str(number)] = part if "]]" in part else part.strip()
    return out


def definition(source: str) -> str:
    """What a template's source includes."""
    only = re.findall(r"(?s)<onlyinclude>(.*?)</onlyinclude>", source)
    if only:
        return "".join(only)
    source = re.sub(r"(?s)<noinclude>.*?(</noinclude>|\Z)", "", re.sub(r"(?s)<!--.*?-->", "", source))
    return re.sub(r"</?includeonly>", "", source)


_OPERATORS = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "div": operator.truediv, "mod": lambda a, b: int(a) % int(b), "^": operator.pow, "=": operator.eq, "!=": operator.ne, "<>": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "and": lambda a, b: bool(a) and bool(b), "or": lambda a, b: bool(a) or bool(b)}
_RANK = [{"or"}, {"and"}, {"=", "!=", "<>", "<", ">", "<=", ">="}, {"+", "-"}, {"*", "/", "div", "mod"}, {"^"}]


def expression(text: str) -> str:
    """#expr by precedence climbing; an error text where it doesn't parse."""
    items = re.findall(r"\d+\.?\d*|\.\d+|[a-z]+|<=|>=|<>|!=|[-+*/^()=<>]", text.lower())
    at = 0

    def level(k: int):
        nonlocal at
        if k == len(_RANK):
            return atom()
        value = level(k + 1)
        while at < len(items) and items[at] in _RANK[k]:
            sign = items[at]
            at += 1
            value = _OPERATORS[sign](value, level(k + 1))
        return value

    def atom():
        nonlocal at
        item = items[at]
        at += 1
        if item == "(":
            value = level(0)
            at += 1
            return value
        if item in ("-", "+"):
            return -atom() if item == "-" else atom()
        if item == "not":
            return not atom()
        return float(item)

    try:
        value = float(level(0))
        if at != len(items) or not items or abs(value) > 1e300:
            raise ValueError
    except (ValueError, IndexError, ZeroDivisionError, OverflowError, TypeError):
        return '<span class="error"></span>'
    return str(int(value)) if value == int(value) else str(value)


class Cleaner:
    """``templates``: definitions by title (broadcast with the function); ``words``: values
    of magic words such as the clock's, so that output doesn't depend on the day."""

    def __init__(self, templates: dict[str, str] | None = None, words: dict[str, str] | None = None):
        self.templates = {self.title(k): v for k, v in (templates or {}).items()}
        self.words = words or {}

    @staticmethod
    def title(name: str) -> str:
        """Spaces for underscores, the first letter in upper case."""
        name = " ".join(name.replace("_", " ").split())
        name = re.sub(r"^(?i:template|plantilla):\s*", "", name)
        return name[:1].upper() + name[1:]

    def function(self, name: str, args: list[str]) -> str | None:
        """None if there is no such function."""
        get = lambda i: args[i].strip() if len(args) > i else ""
        if name == "#if":
            return get(1) if get(0) else get(2)
        if name == "#ifeq":
            return get(2) if get(0) == get(1) else get(3)
        if name == "#iferror":
            bad = 'class="error"' in get(0)
            return get(1) if bad else (get(2) if len(args) > 2 else get(0))
        if name == "#expr":
            return expression(get(0))
        if name == "#switch":
            wanted, default, falling = get(0), "", False
            for part in args[1:]:
                key, has, value = part.partition("=")
                if not has:
                    falling = falling or key.strip() == wanted
                    default = key.strip()
                elif falling or key.strip() == wanted:
                    return value.strip()
                elif key.strip() == "#default":
                    default = value.strip()
            return default
        simple = {"lc": str.lower, "uc": str.upper, "ucfirst": lambda s: s[:1].upper() + s[1:], "lcfirst": lambda s: s[:1].lower() + s[1:], "urlencode": urllib.parse.quote_plus, "int": str}
        if name in simple:
            return simple[name](get(0))
        if name == "#invoke":
            return f"{get(2)} {get(3)}".strip() if get(0).lower() == "convert" else ""
        return "" if name in ("#ifexpr", "#ifexist", "#time", "#timel", "#titleparts", "#rel2abs", "#language", "formatnum") else None

    def expand(self, text: str, given: dict[str, str] | None = None, depth: int = 0) -> str:
        """Templates and parameters; an opening brace without an end stays."""
        if depth > DEPTH:
            return ""
        out, at = [], 0
        while True:
            start = text.find("{{", at)
            if start < 0:
                return "".join([*out, text[at:]])
            triple = text.startswith("{{{", start) and not text.startswith("{{{{", start)
            end = _find_close(text, start, "{{{", "}}}") if triple else _find_close(text, start, "{{", "}}")
            if triple and end < 0:
                triple, end = False, _find_close(text, start, "{{", "}}")
            if end < 0:
                return "".join([*out, text[at:]])
            out.append(text[at:start])
            if triple:
                name, *rest = split_pipes(text[start + 3 : end - 3])
                name = self.expand(name, given, depth + 1).strip()
                value = (given or {}).get(name)
                out.append(value if value is not None else self.expand(rest[0], given, depth + 1) if rest else "")
            else:
                out.append(self.template(text[start + 2 : end - 2], given, depth))
            at = end

    def template(self, body: str, given: dict[str, str] | None, depth: int) -> str:
        parts = [self.expand(p, given, depth + 1) for p in split_pipes(body)]
        name = parts[0].strip()
        if name in self.words or name == "!":
            return self.words.get(name, "|")
        head, colon, first = name.partition(":")
        if colon:
            got = self.function(head.strip().lower(), [first, *parts[1:]])
            if got is not None:
                return got
        source, hops = self.templates.get(self.title(name)), 0
        while source and hops < 5 and (m := re.match(r"(?i)\s*#redirect[^\[]*\[\[([^\]|]*)", source)):
            source, hops = self.templates.get(self.title(m[1])), hops + 1
        return "" if source is None else self.expand(definition(source), parameters(parts[1:]), depth + 1)

    def links(self, text: str) -> str:
        """Labels of accepted links, with the letters that follow."""
        out, at = [], 0
        for start in iter(lambda: text.find("[[", at), -1):
            end = _find_close(text, start, "[[", "]]")
            if end < 0:
                break
            out.append(text[at:start])
            target, *rest = split_pipes(text[start + 2 : end - 2])
            space, colon, _ = target.lstrip(":").partition(":")
            trail = re.match(r"\w*", text[end:])[0]
            if not colon or space.strip().lower() in ACCEPTED:
                label = rest[-1] if rest else target.lstrip(":")
                out.append(self.links(label.strip()) + trail)
            at = end + len(trail)
        return "".join([*out, text[at:]])

    def clean(self, text: str) -> str:
        """The stages in their order."""
        text = self.expand(text)
        text = without_nested(text, r"\{\|", r"\|\}")
        text = re.sub(r"\[(?:https?|ftp|irc|mailto):[^\]\s]*(?:\s[^\]]*)?\]", "", text)  # I37: the label goes too
        text = re.sub(r"\[//\S*\s?([^\]]*)\]", r"\1", text)
        text = self.links(text)
        text = re.sub(r"__[A-Z]+__", "", text)
        parts = re.split(r"(?s)(<syntaxhighlight.*?</syntaxhighlight>)", text)
        text = "".join(p if i % 2 else html.unescape(p) for i, p in enumerate(parts))
        text = re.sub(r"'{5}(.*?)'{5}|'{3}(.*?)'{3}", lambda m: m[1] if m[1] is not None else m[2], text)
        text = re.sub(r"''\"?([^\"']*)\"?''", r'"\1"', text)  # italics become quotations
        text = text.replace("'''", "").replace("''", '"')
        text = re.sub(r"(?s)<!--.*?-->", "", text)
        text = re.sub(rf"(?is)<\s*(?:{'|'.join(CLOSED)})\b[^>]*/\s*>", "", text)
        text = re.sub(rf"(?i)<(?:{'|'.join(IGNORED)})\b[^>/]*>|</\s*(?:{'|'.join(IGNORED)})>", "", text)
        for tag in DISCARDED:
            text = without_nested(text, rf"(?i)<\s*{tag}\b[^>/]*>", rf"(?i)<\s*/\s*{tag}>")
        text = html.unescape(text)
        for tag, name in PLACEHOLDERS.items():
            seen: dict[str, str] = {}
            text = re.sub(rf"(?is)<\s*{tag}(?:\s*| [^>]+?)>.*?<\s*/\s*{tag}\s*>", lambda m, seen=seen, name=name: seen.setdefault(m[0], f"{name}_{len(seen) + 1}"), text)
        text = text.replace("<<", "«").replace(">>", "»").replace("\t", " ")
        text = re.sub(r"\.{4,}", "...", text)
        text = re.sub(r" +([,:.)\]»])", r"\1", re.sub(r"([(\[«]) +", r"\1", text))
        text = re.sub(r"\(\s*[,;]*\s*\)", "", text)
        return re.sub(r"[ \t]{2,}", " ", text)

    def compact(self, text: str) -> str:
        """Headings only before content; lists, indents and table rests go."""
        out, headings = [], []
        for line in self.clean(text).split("\n"):
            line = line.strip()
            m = re.fullmatch(r"(={2,6})\s*(.*?)\s*\1", line)
            if m:
                level = len(m[1])
                headings = [h for h in headings if h[0] < level] + [(level, m[2].rstrip(".") + ".")]
            elif line and line[0] not in "*#:;{|!}" and not re.fullmatch(r"[\W_]+", line):
                out += [h for _, h in headings if h != "."] + [line]
                headings = []
        return "\n".join(out)


def clean(text: Column, templates: dict[str, str] | None = None, words: dict[str, str] | None = None) -> Column:
    tool = Cleaner(templates, words)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else tool.compact(t))

    return run(text)


def wrapped(doc_id: Column, url: Column, title: Column, text: Column) -> Column:
    """The title repeated as the first line."""
    return F.format_string('<doc id="%s" url="%s" title="%s">\n%s\n\n%s\n</doc>', doc_id.cast("string"), url, title, title, text)

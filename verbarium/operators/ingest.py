"""Ingest: ids to fetch, outcomes, extraction (survey I01-I28, J05-J06, C15-C21)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.functions import dates as D
from verbarium.functions import text as T

RETRIES = 5


def missing_sources(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """I01."""
    return wanted.join(known.select("domain"), "domain", "left_anti").dropDuplicates(["domain"])


def missing_ids(existing: DataFrame, last: int | None = None, key: str = "source_id") -> DataFrame:
    """The ids up to the last one that don't exist."""
    if last is None:
        last = existing.agg(F.max(F.col(key).cast("bigint"))).first()[0] or 0
    universe = existing.sparkSession.range(1, last + 1).withColumnRenamed("id", key)
    return universe.join(existing.select(F.col(key).cast("bigint").alias(key)).distinct(), key, "left_anti")


def dated_ids(existing: DataFrame, first: Column, last: Column, each: int, key: str = "source_id") -> DataFrame:
    """Day and number ids between two days that don't exist."""
    grid = existing.sparkSession.range(1).select(F.explode(D.grid(first, last)).alias("day"))
    ids = grid.select(F.explode(F.sequence(F.lit(1), F.lit(each))).alias("n"), "day").select(F.format_string("%s-%d", F.date_format("day", "yyyyMMdd"), F.col("n")).alias(key))
    return ids.join(existing.select(key), key, "left_anti")


def new_entries(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Ids of a source that have no entry there yet, as pending entries."""
    keys = ["data_source", "source_id"]
    return found.select(keys).distinct().join(entries.select(keys), keys, "left_anti").withColumn("outcome", F.lit("pending")).withColumn("number_of_tries", F.lit(0))


def retryable(entries: DataFrame, source: str | None = None) -> DataFrame:
    """F08, I03."""
    rows = entries.where(F.col("outcome").isin("failure", "pending") & (F.col("number_of_tries") < RETRIES))
    return rows.where(F.col("data_source") == source) if source else rows


def outcome(status: Column, content: Column, redirect: Column | None = None, missing_500: bool = False, blank_missing: bool = False, least: int = 10) -> Column:
    """What came of a fetch."""
    gone = (status == 404) | (status == 500 if missing_500 else F.lit(False))
    if redirect is not None:
        gone |= redirect
    out = F.when(gone, "notfound").when(status >= 400, "failure").when(content.isNull(), "unparseable")
    if blank_missing:
        out = out.when(F.trim(content) == "", "notfound")
    return out.when(T.word_count(content) < least, "unparseable").otherwise("success")


def after_try(entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Entries with the outcome of their last try, one more try counted."""
    new = outcomes.select("data_source", "source_id", F.col("outcome").alias("_new"))
    rows = entries.join(new, ["data_source", "source_id"], "left")
    return rows.withColumn("number_of_tries", F.col("number_of_tries") + F.col("_new").isNotNull().cast("int")).withColumn("outcome", F.coalesce("_new", "outcome")).drop("_new")


def resume_date(existing: DataFrame, key: str = "source_id") -> DataFrame:
    """The day of the latest date-coded id (yyyyMMdd...)."""
    return existing.agg(F.max(key).alias("_m")).select(F.try_to_date(F.substring("_m", 1, 8), "yyyyMMdd").alias("day"))


def known_ids(entries: DataFrame, source: str | None = None) -> DataFrame:
    """The ids of a source that have an entry; read them with chunks()."""
    return (entries if source is None else entries.where(F.col("data_source") == source)).select("data_source", "source_id")


def chunks(rows: DataFrame, size: int = 10_000) -> Iterator[list]:
    """Rows in lists of bounded size, one partition on the driver at a time."""
    held: list = []
    for row in rows.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def active(sources: DataFrame) -> DataFrame:
    """F09."""
    return sources.where("active")


def with_source(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries with their source's row."""
    return entries.join(sources, "data_source_id")


def paired(lists: DataFrame, docs: str = "documents", metadata: str = "metadata") -> DataFrame:
    """A page's documents and their metadata, by place; null where one list is
    shorter."""
    rest = [c for c in lists.columns if c not in (docs, metadata)]
    both = F.arrays_zip(F.col(docs).alias("document"), F.col(metadata).alias("metadata"))
    return lists.select(*rest, F.posexplode(both).alias("place", "b")).select(*rest, "place", "b.document", "b.metadata")


def more_entries(pages: DataFrame, links: str = "links", pattern: str = r"sid=(\d+).*?chapter=(\d+)") -> DataFrame:
    """An index page's links as new ids ``sid@@chapter=n``; a page without any
    is notfound."""
    rest = [c for c in pages.columns if c != links]
    ids = F.transform(F.filter(links, lambda x: x.rlike(pattern)), lambda x: F.concat(F.regexp_extract(x, pattern, 1), F.lit("@@chapter="), F.regexp_extract(x, pattern, 2)))
    rows = pages.withColumn("_ids", F.coalesce(ids, F.array().cast("array<string>")))
    return rows.select(*rest, F.when(F.size("_ids") > 0, "more_entries").otherwise("notfound").alias("outcome"), F.explode_outer("_ids").alias("source_id"))


def first_links(versions: DataFrame, language: str = "español", prefix: str = "/updated/") -> DataFrame:
    """Of each episode's versions (episode, place, language, link) the first in
    the language that has a link; its id from the link's three parts."""
    fit = versions.where(F.lower("language").contains(language) & F.col("link").isNotNull() & (F.col("link") != ""))
    first = fit.groupBy("episode").agg(F.min_by("link", "place").alias("link"))
    return first.select("episode", F.replace(F.replace("link", F.lit(prefix), F.lit("")), F.lit("/"), F.lit("@@")).alias("source_id"))


def unknown_only(found: DataFrame, known: DataFrame, key: str = "source_id") -> DataFrame:
    """What isn't known yet; null ids go."""
    return found.where(F.col(key).isNotNull()).join(known.select(key), key, "left_anti")


def gathered(lists: DataFrame, by: str, values: str) -> DataFrame:
    """A group's lists one after the other, in the order of their place."""
    parts = F.array_sort(F.collect_list(F.struct("place", values)))
    return lists.groupBy(by).agg(F.flatten(F.transform(parts, lambda x: x[values])).alias(values))


def archive_ids(links: Column) -> Column:
    """The number before ``.html`` of archive links; other links stay as they are."""
    return F.regexp_replace(links, r".*_(\d+)\.html", "$1")


class _Extract(HTMLParser):
    """Text of the elements that match selectors: tag, tag.class or tag#id, or several of
    these, each an ancestor of the next."""

    VOID = {"br", "img", "meta", "link", "hr", "input", "source", "area", "base", "col", "embed", "track", "wbr"}
    CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}

    def __init__(self, wanted: list[str], dropped: list[str]):
        super().__init__(convert_charrefs=True)
        self.wanted, self.dropped = [[self._split(p) for p in s.split()] for s in wanted], [self._split(s) for s in dropped]
        self.stack: list[tuple[str, list[int], bool, dict]] = []
        self.found: list[list[str]] = [[] for _ in wanted]

    @staticmethod
    def _split(selector: str) -> tuple[str, str, str]:
        tag, _, name = selector.partition("#")
        if name:
            return tag, "id", name
        tag, _, name = selector.partition(".")
        return tag, "class" if name else "", name

    @staticmethod
    def _fits(selector: tuple[str, str, str], tag: str, attrs: dict) -> bool:
        want, kind, name = selector
        if want and want != tag:
            return False
        have = attrs.get(kind) or ""
        return not kind or (name in have.split() if kind == "class" else name == have)

    def handle_starttag(self, tag, attrs):
        while self.stack and self.stack[-1][0] in self.CLOSES.get(tag, ()):
            self.stack.pop()
        attrs = dict(attrs)
        opened = [i for i, s in enumerate(self.wanted) if self._fits(s[-1], tag, attrs) and self._inside(s[:-1])]
        for i in opened:
            self.found[i].append("")
        if tag not in self.VOID:
            self.stack.append((tag, opened, tag in ("script", "style") or any(self._fits(s, tag, attrs) for s in self.dropped), attrs))

    def _inside(self, chain: list[tuple[str, str, str]]) -> bool:
        """Whether the open elements hold the chain's, in its order."""
        at = 0
        for tag, _, _, attrs in self.stack:
            at += at < len(chain) and self._fits(chain[at], tag, attrs)
        return at == len(chain)

    def handle_endtag(self, tag):
        if any(x[0] == tag for x in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(x[2] for x in self.stack):
            return
        for i in {i for x in self.stack for i in x[1]}:
            self.found[i][-1] += data


_REFERENCE = r"&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)?"


def select_text(html: Column, selectors: list[str], dropped: list[str] = (), references: tuple[str, ...] | None = None) -> Column:
    """For each selector the texts of its elements, in order; null for a null page. As
    with lxml, a reference without its semicolon stays as it is. ``references``: the names
    of those that are resolved, in place of all."""
    wanted, off = list(selectors), list(dropped)
    named = None if references is None else {f"{name};" for name in references}

    def resolved(found: re.Match) -> str:
        reference = found[1] or ""
        known = reference in named if named is not None else reference.startswith("#") or reference in html5
        return found[0] if known else f"&amp;{reference}"

    @F.pandas_udf("array<array<string>>")
    def run(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            if page is None:
                out.append(None)
                continue
            parser = _Extract(wanted, off)
            parser.feed(re.sub(_REFERENCE, resolved, page))
            parser.close()
            out.append([[" ".join(t.split()) for t in texts] for texts in parser.found])
        return pd.Series(out)

    return run(html)


@dataclass(frozen=True)
class Connector:
    """What a site module says. Extraction joins title, summary and body by line
    feeds; no body means unparseable. Each piece of metadata stands alone (I17)."""

    domain: str
    document_url: str
    title: str = "h1"
    summary: str | None = None
    body: str = "p"
    dropped: tuple[str, ...] = ()
    join: str = "\n"
    tags: tuple[str, ...] = ()
    id_pattern: str = r"/(\d+)"
    missing_500: bool = False
    blank_missing: bool = False
    keep_longer: int = 0
    markers: tuple[str, ...] = field(default=())
    fallbacks: tuple[str, ...] = ()  # bodies to try where the one before gives less than ``least`` characters
    least: int = 1
    over_title: str | None = None
    optional_heads: bool = False  # a head that isn't there is an empty line
    title_sep: str | None = None

    def extract(self, pages: DataFrame, url: str = "url", html: str = "html", references: tuple[str, ...] | None = None) -> DataFrame:
        none = "no-such-element"
        bodies = [self.body, *self.fallbacks]
        rows = pages.withColumn("_t", select_text(F.col(html), [self.over_title or none, self.title, self.summary or none, *bodies], list(self.dropped), references))
        first = lambda i: F.try_element_at(F.col("_t")[i], F.lit(1))

        def text(i: int) -> Column:
            kept = F.filter(F.col("_t")[i], lambda x: F.length(x) > self.keep_longer)
            if self.markers:
                kept = F.filter(kept, lambda x: ~x.rlike("|".join(self.markers)))
            return F.array_join(kept, self.join)

        body = F.lit(None).cast("string")
        for i in reversed(range(len(bodies))):
            body = F.when(F.length(text(3 + i)) >= self.least, text(3 + i)).otherwise(body)
        title = first(1) if self.title_sep is None else T.last_part(first(1), self.title_sep)
        heads = [first(0)] * (self.over_title is not None) + [title] + [first(2)] * (self.summary is not None)
        heads = [F.coalesce(h, F.lit("")) for h in heads] if self.optional_heads else heads
        whole = F.concat_ws("\n", *heads, body)
        content = F.when(body.isNotNull(), F.regexp_replace(whole, r"\A\s+|\s+\z", "") if self.optional_heads else whole)
        return rows.select(
            *[c for c in pages.columns if c != html],
            T.numeric_id(F.col(url), self.id_pattern).alias("source_id"),
            title.alias("title"),
            content.alias("content"),
            F.array(*[F.lit(t) for t in self.tags]).cast("array<string>").alias("tags"),
            F.lit(self.domain).alias("data_source"),
        )

    def judged(self, pages: DataFrame, status: Column, url: str = "url", html: str = "html") -> DataFrame:
        """Extraction with the outcome of each fetch; only what succeeded
        keeps its content."""
        state = outcome(status, F.col("content"), missing_500=self.missing_500, blank_missing=self.blank_missing)
        rows = self.extract(pages.withColumn("_status", status), url, html).withColumn("outcome", state).drop("_status")
        return rows.withColumn("content", F.when(F.col("outcome") == "success", F.col("content")))


REGISTRY: dict[str, Connector] = {}


def register(connector: Connector) -> Connector:
    """P14."""
    REGISTRY[connector.domain] = connector
    return connector


def dispatch(url: Column) -> Column:
    """The registered domain that a url's host belongs to."""
    host, out = T.host(url), None
    for domain in sorted(REGISTRY, key=len, reverse=True):
        fits = (host == domain) | host.endswith("." + domain)
        out = F.when(fits, domain) if out is None else out.when(fits, domain)
    return F.lit(None).cast("string") if out is None else out


#: Connectors of the kinds that sites need, for pages as the tests have them.
ARTICLES = register(Connector("example.org", "https://example.org/{}", title="h1", body="article p", dropped=("nav", "div.ad"), tags=("news",), fallbacks=("p",)))
STORIES = register(Connector("example.net", "https://example.net/{}", title="title", body="p", dropped=("nav", "div.ad"), join=" ", tags=("amateur_writing",), title_sep="/"))
OPINIONS = register(Connector("example.com", "https://example.com/{}", over_title="p.over", title="h1", summary="div.ad", body="p", optional_heads=True, keep_longer=3, markers=("READ MORE:",), blank_missing=True))


def extracted(pages: DataFrame, url: str = "url", html: str = "html", references: tuple[str, ...] | None = None) -> DataFrame:
    """Each page by the connector of its host; other pages are left out.
    ``references``: as for ``select_text``."""
    rows, out = pages.withColumn("_domain", dispatch(F.col(url))), None
    for domain, connector in sorted(REGISTRY.items()):
        part = connector.extract(rows.where(F.col("_domain") == domain).drop("_domain"), url, html, references)
        out = part if out is None else out.unionByName(part)
    return out


def thread_pages(posts: DataFrame, each: int = 2) -> DataFrame:
    """Posts (conv_id, turn, text) of a thread as pages ``thread@@page``."""
    page = F.floor(F.col("turn") / each).cast("bigint")
    rows = posts.groupBy("conv_id", page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return rows.select(T.join_ids(F.col("conv_id"), F.col("page") + 1).alias("source_id"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("content"))


def translate(lines: DataFrame, dictionary: DataFrame, key: str = "line") -> DataFrame:
    """(key, words) with every word translated; lines with an unknown word go."""
    rows = lines.select(key, F.posexplode("words").alias("pos", "word"), F.size("words").alias("n"))
    done = rows.join(dictionary.select("word", "translation"), "word").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "translation"))).alias("t"), F.max("n").alias("n"))
    return done.where(F.size("t") == F.col("n")).select(key, F.transform("t", lambda x: x["translation"]).alias("words"))

"""Named queries over the test tables, each with its survey ids, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbarium.functions import dates as D
from verbarium.functions import text as T
from verbarium.functions import vector as V
from verbarium.operators import catalog, cooccurrence, corpus, embeddings, evaluate, ingest, querydsl, searchindex, testgen

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query of (table reader) with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _docs(t) -> DataFrame:
    return corpus.documents(t("documents"))


def _index(t) -> searchindex.SearchIndex:
    return searchindex.stored(t("documents"), _docs(t), "doc_id")


def _log(t) -> DataFrame:
    return t("events").select(F.col("event_type").alias("data_source"), F.col("ts").alias("date_scraped"), F.col("value").alias("word_count"))


def _text_days(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _model(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vec"))


WC = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::bigint"
DOCS = f"(select doc_id, text as content, source as data_source, lang, {WC} as word_count from documents)"
_LATIN = [(a, b) for a, b in zip(T.FOLD_FROM, T.FOLD_TO, strict=True) if 0xC0 <= ord(a) < 0x180]
FOLD = lambda x: f"regexp_replace(translate({x}, '{''.join(a for a, _ in _LATIN)}', '{''.join(b for _, b in _LATIN)}'), '[^\\x00-\\x7F]', '', 'g')"
WORDS = lambda x: rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+')"
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
ANALYZED = f"list_transform(list_filter(list_transform({WORDS('content')}, lambda x: lower(x)), lambda x: x not in ({STOP})), lambda x: {FOLD('x')})"
SENTENCES = "select {key}, generate_subscripts(p, 1) - 1 as sid, unnest(p) as sentence from (select *, flatten(list_transform(string_split({text}, chr(10)), lambda l: string_split(l, '. '))) as p from ({table}))"

# ------------------------------------------------------------------- corpus


@query(f"select sum(word_count)::bigint as words from {DOCS}")
def corpus_size(t):
    """A01."""
    return corpus.size(_docs(t))


@query(f"select data_source, count(*) as docs, sum(word_count)::bigint as words from {DOCS} group by data_source")
def corpus_size_by_source(t):
    """A03, P01."""
    return corpus.size_by_source(_docs(t))


@query(f"select sum(word_count)::bigint as words from {DOCS} where data_source in ('src1', 'src2') and lang = 'en'")
def corpus_size_filtered(t):
    """A02."""
    return corpus.size(_docs(t), {"bool": {"must": [{"terms": {"data_source": ["src1", "src2"]}}, {"term": {"tags": "en"}}]}})


@query(f"select count(*) as total, sum(word_count)::bigint as words from {DOCS} where data_source = 'src3'")
def corpus_hits(t):
    """A08, A09."""
    return corpus.hits(_docs(t), {"filtered": {"query": {"match_all": {}}, "filter": {"terms": {"data_source": ["src3"]}}}})


_NOW = "(select max(ts) from events)"
_GROWTH = f"select event_type as data_source, date_trunc('day', ts) as day, sum(value) as words from events where ts >= date_trunc('day', {_NOW}) - interval 10 days group by all"


def _now(t):
    return t("events").agg(F.max("ts")).scalar()


@query(f"select s.data_source, day::timestamp as day, round(words, 4) as words from (select distinct event_type as data_source from events) s left join ({_GROWTH}) g on s.data_source = g.data_source")
def corpus_growth_10d(t):
    """A04, F06, R04."""
    return corpus.growth(_log(t), _now(t)).withColumn("words", F.round("words", 4))


@query(f"with g as ({_GROWTH}), d as (select distinct day from g), s as (select distinct event_type as data_source from events) select s.data_source, array_to_string(list(printf('%.3f', coalesce(words, 0.0)) order by d.day), ',') as series from s cross join d left join g on g.data_source = s.data_source and g.day = d.day group by s.data_source")
def corpus_growth_dense(t):
    """A05, X02."""
    return corpus.growth_dense(_log(t), _now(t)).withColumn("series", F.array_join(F.transform("series", lambda x: F.format_string("%.3f", x)), ","))


@query("select strftime(day, '%Y-%m-%d') as day, count(e.event_id) as docs from (select unnest(generate_series(timestamp '2024-01-25', timestamp '2024-02-05', interval 1 day)) as day) left join events e on date_trunc('day', e.ts) = day group by day")
def day_counts_bounded(t):
    """A06."""
    return _text_days(corpus.day_counts(t("events"), F.lit("2024-01-25"), F.lit("2024-02-05")))


@query("select strftime(day, '%Y-%m-%d') as day from (select unnest(generate_series(timestamp '2023-12-25', timestamp '2024-02-05', interval 1 day)) as day) where day not in (select date_trunc('day', ts) from events)")
def missing_days(t):
    """A07, R09."""
    return _text_days(corpus.missing_days(t("events"), F.lit("2023-12-25"), F.lit("2024-02-05")))


@query("select strftime(unnest(generate_series(timestamp '2030-01-01', timestamp '2030-01-09', interval 1 day)), '%Y-%m-%d') as day")
def missing_days_bootstrap(t):
    """Nothing there at all."""
    return _text_days(corpus.missing_days(t("events"), F.lit("2030-01-05"), F.lit("2030-01-09"), F.lit("2030-01-01")))


# ------------------------------------------------------------------- search


@query("select doc_id from documents")
def search_match_all(t):
    """F01, S02."""
    return _docs(t).where(querydsl.predicate(None)).select("doc_id")


@query("select doc_id from documents where source in ('src0', 'src7')")
def search_terms(t):
    """F02."""
    return _docs(t).where(querydsl.predicate({"terms": {"data_source": ["src0", "src7"]}})).select("doc_id")


@query(f"select doc_id, data_source from {DOCS} where list_has_any({ANALYZED}, ['thing', 'eneau'])")
def search_match(t):
    """F03, C07."""
    return _docs(t).where(querydsl.predicate({"match": {"content": "la Thing éneau"}})).select("doc_id", "data_source")


@query(f"select doc_id from {DOCS} where data_source in ('src1', 'src2', 'src3') and list_has_any({ANALYZED}, ['and'])")
def search_filtered_match(t):
    """F04, F05."""
    return _docs(t).where(querydsl.predicate({"filtered": {"filter": {"terms": {"data_source": ["src1", "src2", "src3"]}}, "query": {"match": {"content": "and"}}}})).select("doc_id")


@query(f"select doc_id from {DOCS} where list_has_all({ANALYZED}, ['the', 'of', 'and'])")
def search_match_all_words(t):
    """F05."""
    return _docs(t).where(querydsl.predicate({"match": {"content": {"query": "the of and", "operator": "and"}}})).select("doc_id")


@query("select event_id from events where ts > timestamp '2024-01-22' and ts < timestamp '2024-01-30' and event_type = (select min(event_type) from events)")
def search_range(t):
    """F07."""
    from datetime import datetime

    kind = t("events").agg(F.min("event_type")).first()[0]
    q = {"bool": {"must": [{"range": {"ts": {"gt": "now/d-8d", "lt": "now/d"}}}, {"term": {"event_type": kind}}]}}
    return t("events").where(querydsl.predicate(q, datetime(2024, 1, 30, 13, 5))).select("event_id")


@query(f"select doc_id, word_count from {DOCS} where data_source = 'src1' order by word_count desc, doc_id offset 10 limit 25")
def search_page2(t):
    """A page by rank."""
    return _docs(t).where("data_source = 'src1'").orderBy(F.desc("word_count"), "doc_id").offset(10).limit(25).select("doc_id", "word_count")


@query("select doc_id, case when length(substr(text, 1, 100)) = 100 then substr(text, 1, 100) || '...' else text end as snippet from documents")
def search_snippet(t):
    """C12, Q13."""
    return _docs(t).select("doc_id", T.snippet(F.col("content")).alias("snippet"))


_SCORED = f"""with a as (select doc_id, data_source, word_count, {ANALYZED} as t from {DOCS}),
h as (select *, [len(list_filter(t, lambda x: x = 'thing')), len(list_filter(t, lambda x: x = 'and')), len(list_filter(t, lambda x: x = 'ereau'))] as tf from a where list_has_any(t, ['thing', 'and', 'ereau'])),
d as (select [count(*) filter (tf[1] > 0), count(*) filter (tf[2] > 0), count(*) filter (tf[3] > 0)] as df from h),
n as (select count(*)::double as n from documents),
r as (select doc_id, data_source, word_count, (sqrt(tf[1]) * (1 + ln(n.n / (df[1] + 1.0))) ** 2 + sqrt(tf[2]) * (1 + ln(n.n / (df[2] + 1.0))) ** 2 + sqrt(tf[3]) * (1 + ln(n.n / (df[3] + 1.0))) ** 2) / sqrt(len(t)) as score from h, d, n)
"""


@query(_SCORED + "select doc_id, round(score, 6) as score from r")
def search_relevance(t):
    """F03 with scores: our own TF-IDF, of every document with a word of the query, from
    the stored index."""
    return _index(t).scores({"match": {"content": "thing and ereau"}}).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_SCORED + "select row_number() over (order by score desc, doc_id) as rank, doc_id, data_source as source, round(score, 6) as score, (select count(*) from r) as count, (select sum(word_count) from r)::bigint as words from r order by score desc, doc_id limit 25 offset 25")
def search_page(t):
    """The second page of a search, best first, with totals, from the
    stored index."""
    page = searchindex.search(_index(t), _docs(t), {"match": {"content": "thing and ereau"}}, offset=25, key="doc_id")
    return page.select(F.col("rank").cast("bigint").alias("rank"), "doc_id", "source", F.round("score", 6).alias("score"), "count", "words")


_BY_WORD = f"""with a as (select doc_id, data_source, word_count, {ANALYZED} as t from {DOCS}),
u as (select doc_id, data_source, len(t) as size, unnest(t) as term from a),
p as (select doc_id, data_source, size, term, count(*) as tf from u group by all),
w as (select term, (1 + ln((select count(*) from documents)::double / (count(*) + 1.0))) ** 2 as weight from p group by term)
"""


@query(_BY_WORD + "select row_number() over (order by score desc, doc_id)::int as rank, doc_id, round(score, 6) as score from (select doc_id, (max(case term when 'the' then sqrt(tf) * weight end) + max(case term when 'of' then sqrt(tf) * weight end) + max(case term when 'and' then sqrt(tf) * weight end)) / sqrt(any_value(size)) as score from p join w using (term) where term in ('the', 'of', 'and') group by doc_id having count(*) = 3) order by rank limit 40")
def search_scan_all_words(t):
    """The best documents that have all words, by a scan of the texts."""
    page = corpus.search(_docs(t), {"match": {"content": {"query": "the of and", "operator": "and"}}}, page=40, key="doc_id")
    return page.select("rank", "doc_id", F.round("score", 6).alias("score"))


@query(_BY_WORD + "select row_number() over (order by score desc, doc_id)::int as rank, doc_id, round(score, 6) as score from (select doc_id, (max(case term when 'the' then sqrt(tf) * weight end) + max(case term when 'of' then sqrt(tf) * weight end) + max(case term when 'and' then sqrt(tf) * weight end)) / sqrt(any_value(size)) as score from p join w using (term) where term in ('the', 'of', 'and') group by doc_id having count(*) = 3) order by rank limit 40")
def index_page_all_words(t):
    """The same documents from the stored index."""
    page = _index(t).page({"match": {"content": {"query": "the of and", "operator": "and"}}}, page=40)
    return page.select("rank", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_BY_WORD + "select row_number() over (order by score desc, doc_id)::int as rank, doc_id, data_source as source, round(score, 6) as score from (select doc_id, data_source, (coalesce(max(case term when 'and' then sqrt(tf) * weight end), 0) + coalesce(max(case term when 'heit' then sqrt(tf) * weight end), 0)) / sqrt(any_value(size)) as score from p join w using (term) where term in ('and', 'heit') and data_source in ('src1', 'src2', 'src3') group by doc_id, data_source) order by score desc, doc_id limit 30 offset 5")
def index_page_of_sources(t):
    """A page of some sources' documents from the stored index."""
    wanted = {"filtered": {"filter": {"terms": {"data_source": ["src1", "src2", "src3"]}}, "query": {"match": {"content": "AND heit"}}}}
    page = _index(t).page(wanted, offset=5, page=30)
    return page.select("rank", F.col("key").alias("doc_id"), F.col("data_source").alias("source"), F.round("score", 6).alias("score"))


@query(_BY_WORD + "select term, count(*)::bigint as docs, sum(tf)::bigint as uses, round(max(sqrt(tf) / sqrt(size)), 9) as peak from p group by term")
def index_terms(t):
    """The terms of the stored index: documents, uses and the highest share of a
    score that a term has anywhere."""
    uses = F.aggregate("tf", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return _index(t).postings.groupBy("term").agg(F.sum("n").alias("docs"), F.sum(uses).alias("uses"), F.round(F.max("peak"), 9).alias("peak"))


@query(f"select row_number() over (order by doc_id) as rank, doc_id, 1.0::double as score, case when length(substr(content, 1, 100)) = 100 then substr(content, 1, 100) || '...' else content end as snippet from {DOCS} where data_source = 'src1' order by doc_id limit 25")
def search_page_unscored(t):
    """A page of a query without words to score by."""
    return corpus.search(_docs(t), {"terms": {"data_source": ["src1"]}}, key="doc_id").select(F.col("rank").cast("bigint").alias("rank"), "doc_id", "score", "snippet")


@query(r"""select doc_id, case when h <> '' then substr(h, 1, 100) when length(substr(text, 1, 100)) = 100 then substr(text, 1, 100) || '...' else text end as snippet
from (select doc_id, text, regexp_extract(text, '(?is)(?:^|[^\p{L}\p{N}_])((?:thing|that)(?:[^\p{L}\p{N}_].{0,99}|$))', 1) as h from documents)""")
def search_highlight(t):
    """The fragment that begins with the first hit; its marks are tested elsewhere."""
    shown = T.highlighted(F.col("content"), ["thing", "that"])
    return _docs(t).select("doc_id", F.replace(F.replace(shown, F.lit("<em>"), F.lit("")), F.lit("</em>"), F.lit("")).alias("snippet"))


@query("select doc_id, text as content, source as data_source from documents where doc_id = 17")
def document_detail(t):
    """S04, P03, F20."""
    docs = _docs(t)
    wanted = docs.where("doc_id = 17").select("_id").scalar()
    return corpus.document(docs, wanted).select("doc_id", "content", "data_source")


@query(f"select doc_id, word_count from {DOCS} where word_count >= 10")
def min_words_filter(t):
    """F12."""
    return corpus.long_enough(_docs(t)).select("doc_id", "word_count")


@query(f"select doc_id, {WC} as word_count from documents")
def word_count(t):
    """C06."""
    return _docs(t).select("doc_id", "word_count")


@query()
def doc_id_hash(t):
    """C08, C09."""
    return t("documents").select("doc_id", T.document_id(F.col("source"), F.col("doc_id")).alias("_id"), T.document_id(None, F.col("doc_id")).alias("bare_id"))


@query("select distinct source as data_source from documents order by 1")
def source_choices(t):
    """T12."""
    return _docs(t).select("data_source").distinct().orderBy("data_source")


@query("select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1")
def doc_upsert_latest(t):
    """The latest event of each user."""
    e = t("events").select("user_id", "event_id", "ts").withColumn("at", F.struct("ts", "event_id"))
    return corpus.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "at").drop("at")


@query(f"select doc_id, array_to_string([lang, 'es-XX'], ',') as tags, word_count from {DOCS} where word_count >= 10")
def reindex_migration(t):
    """I21, S03, K03."""
    return corpus.reindexed(_docs(t), "es-XX").select("doc_id", F.array_join("tags", ",").alias("tags"), "word_count")


# --------------------------------------------------------------------- text


@query(f"select doc_id, {FOLD('lower(text)')} as folded from documents")
def preprocess_fold(t):
    """C01, C02, C05."""
    return t("documents").select("doc_id", T.preprocess(F.col("text")).alias("folded"))


@query(SENTENCES.format(key="doc_id", text="text", table="documents"))
def sentences(t):
    """C03."""
    return t("documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sid", "sentence")).withColumn("sid", F.col("sid").cast("bigint"))


@query(f"select doc_id, sid, array_to_string({WORDS('sentence')}, ' ') as tokens from (" + SENTENCES.format(key="doc_id", text="f", table=f"select doc_id, {FOLD('lower(text)')} as f from documents") + ")")
def tokens(t):
    """M01, C04, S01."""
    rows = cooccurrence.sentence_table(t("documents"), "text")
    return rows.select("doc_id", F.col("sid").cast("bigint").alias("sid"), F.array_join("tokens", " ").alias("tokens"))


@query(f"select doc_id, array_to_string({ANALYZED}, ' ') as tokens from {DOCS}")
def analyzed_tokens(t):
    """C07."""
    return _docs(t).select("doc_id", F.array_join(T.analyzed(F.col("content")), " ").alias("tokens"))


_VOCAB = "select word, count(*) as count from (select unnest({words}) as word, {words} as w from (" + SENTENCES.format(key="doc_id", text="f", table=f"select doc_id, {FOLD('lower(text)')} as f from documents") + ")) where len(w) >= {least} group by word"


def _sentences(t, where: str = "true") -> DataFrame:
    return cooccurrence.sentence_table(t("documents").where(where), "text")


@query("select * from (" + _VOCAB.format(words=WORDS("sentence"), least=2) + ") where count >= 5")
def vocab_svd(t):
    """M02, A10, F14, F15."""
    return cooccurrence.vocabulary_of(t("documents"), "text", min_count=5, least_tokens=2)


@query("select * from (" + _VOCAB.format(words=WORDS("sentence"), least=1) + ") where count >= 10")
def vocab_glove(t):
    """M07."""
    return cooccurrence.vocabulary_of(t("documents"), "text", min_count=10)


@query("select * from (select * from (" + _VOCAB.format(words=WORDS("sentence"), least=1) + ") order by count desc, word limit 100) where count >= 50")
def vocab_topn(t):
    """T04, T05."""
    return cooccurrence.vocabulary_of(t("documents"), "text", min_count=50, max_count=100)


@query("with v as (select * from (" + _VOCAB.format(words=WORDS("sentence"), least=1) + ")) select word, count, row_number() over (order by count desc, word) as by_count, row_number() over (order by word) - 1 as by_word from v")
def vocab_ids(t):
    """W05, W06."""
    v = cooccurrence.vocabulary_of(t("documents"), "text")
    both = cooccurrence.with_ids(v).withColumnRenamed("id", "by_count").join(cooccurrence.with_ids(v, "word").select("word", F.col("id").alias("by_word")), "word")
    return both.select("word", "count", F.col("by_count").cast("bigint").alias("by_count"), F.col("by_word").cast("bigint").alias("by_word"))


_ALL = f"(select doc_id, {FOLD('lower(text)')} as f from documents)"
_PLACED = f"""s as ({SENTENCES.format(key='doc_id', text='f', table='select * from ' + _ALL)}),
w as (select doc_id, sid, generate_subscripts(k, 1) as pos, unnest(k) as word from (select doc_id, sid, {WORDS('sentence')} as k from s)),
v as (select word, row_number() over (order by n desc, word) as id from (select word, count(*) as n from w group by word)),
p as (select doc_id, sid, id, row_number() over (partition by doc_id, sid order by pos) as pos from w join v using (word)),
pairs as (select a.id as w, b.id as c, abs(a.pos - b.pos) as d from p a join p b on a.doc_id = b.doc_id and a.sid = b.sid and a.pos <> b.pos and abs(a.pos - b.pos) <= 5)"""


def _counted(t, weighting: str = "count", mirror: bool = True):
    docs = t("documents")
    return cooccurrence.cells_of(docs, cooccurrence.with_ids(cooccurrence.vocabulary_of(docs, "text")), 5, weighting, mirror=mirror)


def _cells(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(F.col("w").cast("bigint").alias("w"), F.col("c").cast("bigint").alias("c"), F.round("x", digits).alias("x"))


@query(f"with {_PLACED} select w, c, round(sum(1.0::double / d), 4) as x from pairs group by w, c")
def cooc_glove(t):
    """M08, J08, J09, A12, A13, C47, F13, W03."""
    return _cells(_counted(t, "inverse"))


@query(f"with {_PLACED} select w, c, count(*)::double as x from pairs group by w, c")
def cooc_pairs_fixed(t):
    """M03, M04, A11."""
    return _cells(_counted(t))


@query(f"with {_PLACED} select w, c, round(sum((5 - d + 1) / 5.0::double), 4) as x from pairs group by w, c")
def cooc_dynamic_expected(t):
    """What shrinking windows weigh on average."""
    return _cells(_counted(t, "expected"))


@query(f"with {_PLACED}, x as (select w, c, count(*)::double as x from pairs group by w, c) select id, row_sum, col_sum from (select w as id, sum(x) as row_sum from x group by w) join (select c as id, sum(x) as col_sum from x group by c) using (id)")
def cooc_marginals(t):
    """A14."""
    return cooccurrence.marginals(_counted(t)).withColumn("id", F.col("id").cast("bigint"))


_HALVES = f"""{_PLACED.split("pairs as")[0]}ahead as (select id, {", ".join(f"lead(id, {d}) over s as n{d}" for d in range(1, 6))} from p window s as (partition by doc_id, sid order by pos)),
one_way as (select least(id, c) as w, greatest(id, c) as c, count(*) as n from (select id, unnest([n1, n2, n3, n4, n5]) as c from ahead) where c is not null group by all),
x as materialized (select w, c, (case when w = c then 2 * n else n end)::double as x from one_way union all select c, w, n::double from one_way where w <> c)"""


@query(f"with {_HALVES}, r as (select w, sum(x) as rw from x group by w), k as (select c, sum(x) as cc from x group by c), z as (select sum(cc ** 0.75) as total from k) select w, c, round(ln(x * total / (rw * cc ** 0.75)), 6) as x from x join r using (w) join k using (c), z where x * total / (rw * cc ** 0.75) > 1 and round(ln(x * total / (rw * cc ** 0.75)), 6) > 0")
def ppmi(t):
    """M05, M18, C44."""
    return _cells(cooccurrence.ppmi(_counted(t, mirror=False), mirrored=False), 6).where("x > 0")


#: What vector.draw gives, over 2 ** 52 for a chance.
_DRAWN = lambda *keys: f"('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 13))::bigint"


@query(f"with {_PLACED}, n as (select id, count(*) as n from w join v using (word) group by id having count(*) >= 5), z as (select sum(n)::double * 1e-3 as most from n) select id, count(*) as kept from w join v using (word) join n using (id), z where {_DRAWN("'1'", 'doc_id', 'sid', 'pos - 1')} / 4503599627370496.0::double >= case when n > most then 1 - sqrt(most / n) else 0.0 end group by id")
def subsample_hash(t):
    """Frequent words thinned out by a hash."""
    docs = t("documents")
    return cooccurrence.subsampled_counts(docs, cooccurrence.with_ids(cooccurrence.vocabulary_of(docs, "text", min_count=5)), 1e-3)


@query(f"with {_PLACED}, q as (select *, 1 + {_DRAWN("'1'", 'doc_id', 'sid', 'pos')} % 5 as width from p) select a.id as w, b.id as c, count(*)::double as x from q a join p b on a.doc_id = b.doc_id and a.sid = b.sid and a.pos <> b.pos and abs(a.pos - b.pos) <= a.width group by all")
def cooc_dynamic(t):
    """W04 with one width a centre."""
    docs = t("documents")
    return _cells(cooccurrence.dynamic_cells(docs, cooccurrence.with_ids(cooccurrence.vocabulary_of(docs, "text")), 5))


@query(f"with {_PLACED} select w, c, round(sum(1.0::double / d), 4) as x from pairs group by w, c")
def shuffle_records(t):
    """The records of all documents in an order by chance."""
    return cooccurrence.shuffled(_cells(_counted(t, "inverse")), 7)


# ------------------------------------------------------------------ vectors

_E = "(select vec_id as word, embedding::double[] as vec from embeddings)"
_WHOLE = "(select (vec_id // 4)::bigint as item from embeddings group by vec_id // 4 having count(distinct vec_id) = 4)"
_ITEM = f"(select item, item * 4 + k as word from {_WHOLE}, range(4) r(k))"


def _quads(t, unknown: bool = True) -> DataFrame:
    """Derived analogy items: four ids in a row, as many as the table has; the last word
    of every 25th is unknown."""
    groups = t("embeddings").groupBy(F.floor(F.col("vec_id") / 4).cast("bigint").alias("item")).agg(F.countDistinct("vec_id").alias("n")).where("n = 4")
    last = F.col("item") * 4 + 3
    last = F.when(F.col("item") % 25 == 24, F.lit(10**9)).otherwise(last) if unknown else last
    return groups.select("item", *[(F.col("item") * 4 + i).alias(f"w{i + 1}") for i in range(3)], last.alias("w4"))


_QUADS = f"(select item, item * 4 as w1, item * 4 + 1 as w2, item * 4 + 2 as w3, case when item % 25 = 24 then 1000000000 else item * 4 + 3 end as w4 from {_WHOLE})"
_RANKED = "select item, rank, word, round(score, 6) as score from (select *, row_number() over (partition by item order by score desc, word) as rank from ({scored})) where rank <= {n}"
_ADD = f"""select q.item, m.word, list_inner_product(m.vec, q.v) as score from {_E} m, (
  select i.item, i.w1, i.w2, i.w3, list_transform(u.s, lambda x: x / sqrt(list_inner_product(u.s, u.s))) as v
  from {{items}} i join {_E} a on a.word = i.w1 join {_E} b on b.word = i.w2 join {_E} c on c.word = i.w3,
  lateral (select list_transform(list_zip(a.vec, b.vec, c.vec), lambda z: (z[2] + z[3] - z[1]) / 3) as s) u) q
where m.word not in (q.w1, q.w2, q.w3)"""
_MUL = f"""select i.item, m.word, ((1 + list_inner_product(m.vec, b.vec)) / 2) * ((1 + list_inner_product(m.vec, c.vec)) / 2) / ((1 + list_inner_product(m.vec, a.vec)) / 2 + 0.0001) as score
from {_E} m, {{items}} i join {_E} a on a.word = i.w1 join {_E} b on b.word = i.w2 join {_E} c on c.word = i.w3
where m.word not in (i.w1, i.w2, i.w3)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("item", F.col("rank").cast("bigint").alias("rank"), "word", F.round("score", 6).alias("score"))


@query(_RANKED.format(scored=_ADD.format(items=_QUADS), n=10))
def knn_add(t):
    """V03, V05, J10, J11, C40, C41, T02, A20."""
    items = _quads(t)
    return _rounded(embeddings.nearest_add(_model(t), embeddings.signed(items, ["w2", "w3"], ["w1"])))


@query(_RANKED.format(scored=_MUL.format(items=_QUADS), n=10))
def knn_mul(t):
    """V04, A21, C42, C43, T03."""
    items = _quads(t)
    return _rounded(embeddings.nearest_mul(_model(t), embeddings.signed(items, ["w2", "w3"], ["w1"])))


@query(_RANKED.format(scored=f"select 0::bigint as item, m.word, list_inner_product(m.vec, q.vec) / sqrt(list_inner_product(q.vec, q.vec)) as score from {_E} m, {_E} q where q.word = 7 and m.word <> 7", n=10))
def knn_one_word(t):
    """V01, V03."""
    return _rounded(embeddings.most_similar(_model(t), [7]).withColumn("item", F.lit(0).cast("bigint")))


_ODD = f"""select item, word as odd, round(score, 6) as score from (
  select *, row_number() over (partition by item order by score, word) as r from (
    select i.item, i.word, list_inner_product(e.vec, q.m) / sqrt(list_inner_product(q.m, q.m)) as score
    from {{items}} i join {_E} e on e.word = i.word join (
      select item, list(x order by k) as m from (select item, k, avg(x) as x from (select i.item, generate_subscripts(e.vec, 1) as k, unnest(e.vec) as x from {{items}} i join {_E} e on e.word = i.word) group by item, k) group by item) q on q.item = i.item)) where r = 1"""


@query(_ODD.format(items=_ITEM))
def doesnt_match(t):
    """V06, T06."""
    items = embeddings.signed(_quads(t, False), ["w1", "w2", "w3", "w4"], []).select("item", "word")
    return embeddings.odd_one_out(_model(t), items).withColumn("score", F.round("score", 6))


_FLAGS = f"""with q as (select * from {_QUADS}), a as ({_RANKED.format(scored=_ADD.format(items=_QUADS), n=10)}), m as ({_RANKED.format(scored=_MUL.format(items=_QUADS), n=10)}),
f as (select q.item, q.w4 not in (select vec_id from embeddings) as missing, a.rank as ra, m.rank as rm from q left join a on a.item = q.item and a.word = q.w4 left join m on m.item = q.item and m.word = q.w4)
"""


@query(_FLAGS + "select round(avg(case when not missing and rm <= 1 then 1.0 else 0 end), 6) as top1_mul, round(avg(case when not missing and rm <= 5 then 1.0 else 0 end), 6) as top5_mul, round(avg(case when not missing and rm <= 10 then 1.0 else 0 end), 6) as top10_mul, round(avg(case when not missing and ra <= 1 then 1.0 else 0 end), 6) as top1_add, round(avg(case when not missing and ra <= 5 then 1.0 else 0 end), 6) as top5_add, round(avg(case when not missing and ra <= 10 then 1.0 else 0 end), 6) as top10_add, array_to_string(list(item order by item) filter (missing), ',') as missing, count(*) as total from f")
def eval_analogies(t):
    """V07, A15, A19."""
    out = evaluate.evaluate(_model(t), _quads(t), "analogies")
    names = [f"top{k}_{m}" for m in ("mul", "add") for k in (1, 5, 10)]
    return out.select(*[F.round(n, 6).alias(n) for n in names], F.array_join("missing", ",").alias("missing"), "total")


_SIMS = f"select i as item, coalesce(round(list_inner_product(a.vec, b.vec), 6), 0.0) as similarity, (i * 7 % 11)::double as score from (select vec_id as i from embeddings) left join {_E} a on a.word = i left join {_E} b on b.word = case when i % 10 = 9 then 1000000000 else i * 3 + 1 end"


def _sims(t):
    i = F.col("vec_id")
    rows = t("embeddings").select(i.alias("item"), i.alias("w1"), F.when(i % 10 == 9, F.lit(10**9)).otherwise(i * 3 + 1).alias("w2"), (i * 7 % 11).cast("double").alias("score"))
    return evaluate.similarities(_model(t), rows).withColumn("similarity", F.round("similarity", 6))


@query(f"with s as ({_SIMS}), r as (select rank() over (order by similarity) + (count(*) over (partition by similarity) - 1) / 2.0 as ra, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rb from s) select round(corr(ra, rb), 6) as accuracy, count(*) as total from r")
def eval_similarities(t):
    """V08, A17, Q17."""
    return evaluate.spearman(_sims(t), "similarity", "score").withColumn("accuracy", F.round("accuracy", 6))


@query(f"with o as ({_ODD.format(items=_ITEM)}) select round(avg(case when odd = item * 4 then 1.0 else 0 end), 6) as accuracy, '' as missing, count(*) as total from o")
def eval_odd_one_out(t):
    """V09, A16."""
    items = _quads(t, False).select("item", F.col("w1").alias("odd"), F.array("w2", "w3", "w4").alias("rest"))
    out = evaluate.evaluate(_model(t), items, "odd-one-out")
    return out.select(F.round("accuracy", 6).alias("accuracy"), F.array_join("missing", ",").alias("missing"), "total")


@query("select distinct w4::varchar as word from " + _QUADS + " where w4 not in (select vec_id from embeddings)")
def eval_missing_words(t):
    """A18, V02, X02."""
    return evaluate.missing_words(_model(t), _quads(t).select(F.col("w4").alias("word")))


# ---------------------------------------------------------------- catalogue

_RESULTS = "(select o_custkey as embedding_id, o_orderpriority as testset, o_totalprice as accuracy, o_orderkey from orders)"


def _results(t):
    return t("orders").select(F.col("o_custkey").alias("embedding_id"), F.col("o_orderpriority").alias("testset"), F.col("o_totalprice").alias("accuracy"), "o_orderkey")


@query(f"select o_orderkey, testset, rank() over (partition by testset order by accuracy desc) as rank from {_RESULTS}")
def result_rank(t):
    """W01, P09."""
    return catalog.ranked(_results(t), "testset").select("o_orderkey", "testset", F.col("rank").cast("bigint").alias("rank"))


@query(f"select * from (select o_orderkey, testset, embedding_id, rank() over (partition by testset order by accuracy desc) as rank from {_RESULTS}) where embedding_id = 370")
def result_rank_filtered(t):
    """Ranks among all, then the filter."""
    return catalog.filtered(catalog.ranked(_results(t), "testset"), embedding_id=370, testset=None).select("o_orderkey", "testset", "embedding_id", F.col("rank").cast("bigint").alias("rank"))


@query("select c_custkey, r.testset from customer, (select distinct o_orderpriority as testset from orders) r where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = r.testset)")
def missing_results_anti(t):
    """The test sets that each model has no result on."""
    wanted = t("customer").select("c_custkey").crossJoin(F.broadcast(t("orders").select(F.col("o_orderpriority").alias("testset")).distinct()))  # few test sets
    return catalog.lacking(wanted, t("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("testset")), ["c_custkey", "testset"])


@query("select c_name, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def results_chain(t):
    """J01, J07, J13."""
    results = t("nation").select(F.col("n_nationkey").alias("embedding_id"), F.col("n_regionkey").alias("testset_id"), "n_name")
    models = t("customer").select(F.col("c_nationkey").alias("embedding_id"), "c_name")
    return catalog.named(results, models, t("region").select(F.col("r_regionkey").alias("testset_id"), "r_name")).select("c_name", "n_name", "r_name")


_JOBS = "(select o_orderkey as job_id, o_custkey as embedding_id, (o_orderkey % 5)::bigint as testset_id, case when o_orderstatus = 'F' then (o_orderkey % 1000)::int end as elapsed_time, case when o_orderstatus = 'P' then 'task' end as task_id from orders)"


def _jobs(t):
    return t("orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("embedding_id"), (F.col("o_orderkey") % 5).alias("testset_id"), F.when(F.col("o_orderstatus") == "F", (F.col("o_orderkey") % 1000).cast("int")).alias("elapsed_time"), F.when(F.col("o_orderstatus") == "P", F.lit("task")).alias("task_id"))


@query(f"select job_id, case when task_id is not null then 'PROGRESS' when elapsed_time is not null then 'SUCCESS' else 'PENDING' end as status, case when task_id is null and elapsed_time is not null then 100.0::double else 0.0::double end as progress from {_JOBS}")
def job_status(t):
    """F22."""
    state, progress = catalog.status()
    return _jobs(t).select("job_id", state.alias("status"), progress.alias("progress"))


@query(f"select job_id from {_JOBS} where elapsed_time is null")
def queued_jobs(t):
    """F10."""
    return _jobs(t).where(F.col("elapsed_time").isNull()).select("job_id")


@query(f"select job_id, elapsed_time from {_JOBS} where elapsed_time is not null")
def finished_jobs(t):
    """F10."""
    return _jobs(t).where(F.col("elapsed_time").isNotNull()).select("job_id", "elapsed_time")


@query(f"select testset_id, count(*) as jobs, count(elapsed_time) as finished, max(case when task_id is null and elapsed_time is not null then 100.0 else 0.0 end)::double as progress, round(count(elapsed_time)::double / count(*), 6) as share from {_JOBS} group by testset_id")
def jobs_by_testset(t):
    """A25, C51, T10."""
    return catalog.jobs_by_testset(_jobs(t).withColumn("progress", catalog.status()[1])).withColumn("share", F.round("share", 6))


_MODELS = "(select n_nationkey as embedding_id, case when n_nationkey % 3 = 0 then 'UNTRAINED' else 'TRAINED' end as status from nation)"
_OLD = "(select (i % 25)::int as embedding_id, (i % 5)::int as testset_id, case when i % 4 = 0 then 'PENDING' when i % 4 = 1 then 'PROGRESS' else 'SUCCESS' end as status from range(60) t(i) where i % 7 <> 0 and i < 25)"


@query(f"select m.embedding_id, r.r_regionkey as testset_id, case when j.status is null then 'create' when j.status in ('PENDING', 'PROGRESS') then 'keep' else 'replace' end as action from {_MODELS} m cross join region r left join {_OLD} j on j.embedding_id = m.embedding_id and j.testset_id = r.r_regionkey where m.status = 'TRAINED'")
def jobs_plan(t):
    """J03, J04, P08."""
    models = t("nation").select(F.col("n_nationkey").alias("embedding_id"), F.when(F.col("n_nationkey") % 3 == 0, "UNTRAINED").otherwise("TRAINED").alias("status"))
    i = F.col("id")
    old = t("nation").sparkSession.range(25).where(i % 7 != 0).select((i % 25).cast("int").alias("embedding_id"), (i % 5).cast("int").alias("testset_id"), F.when(i % 4 == 0, "PENDING").when(i % 4 == 1, "PROGRESS").otherwise("SUCCESS").alias("status"))
    return catalog.plan_jobs(models, t("region").select(F.col("r_regionkey").alias("testset_id")), old)


@query("select o_orderkey from orders where o_custkey <> 370")
def cascade_delete(t):
    """K13."""
    return catalog.cascade(370, "o_custkey", t("orders"))[0].select("o_orderkey")


# ------------------------------------------------------------------- ingest


@query("select i::bigint as source_id from range(1, (select max(o_orderkey) + 1 from orders)) t(i) where i not in (select o_orderkey from orders where o_orderkey % 3 = 0)")
def missing_ids(t):
    """J05, I10, A22, X01."""
    last = t("orders").agg(F.max("o_orderkey")).first()[0]  # one number: the length of the range
    return ingest.missing_ids(t("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("source_id")), last)


@query("select strftime(d, '%Y%m%d') || '-' || n as source_id from (select unnest(generate_series(timestamp '2024-01-28', timestamp '2024-02-03', interval 1 day)) as d), range(1, 101) t(n)")
def date_grid_ids(t):
    """I11, C32, A23."""
    none = t("documents").select(F.col("source").alias("source_id"))
    return ingest.dated_ids(none, F.lit("2024-01-28"), F.lit("2024-02-03"), 100)


@query("select event_id from events where event_type in (select event_type from (select distinct event_type from events) order by 1 limit 2) and event_id % 7 < 5")
def pending_entries(t):
    """F08, I03."""
    kinds = t("events").select("event_type").distinct()
    place = kinds.withColumn("k", F.row_number().over(Window.orderBy("event_type")))  # a handful of types
    e = t("events").join(F.broadcast(place), "event_type").select("event_id", F.when(F.col("k") == 1, "failure").when(F.col("k") == 2, "pending").otherwise("success").alias("outcome"), (F.col("event_id") % 7).alias("number_of_tries"))
    return ingest.retryable(e).select("event_id")


@query(f"select page_id, case when page_id % 5 = 0 then 'notfound' when page_id % 5 = 1 then 'failure' when page_id % 5 = 2 then 'unparseable' when {WC.replace('text', 'title')} < 10 then 'unparseable' else 'success' end as outcome from (select page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title from pages)")
def outcome_state(t):
    """I05, I06, I13."""
    p = t("pages")
    status = F.element_at(F.array(F.lit(404), F.lit(503), F.lit(200), F.lit(200), F.lit(200)), (F.col("page_id") % 5 + 1).cast("int"))
    title = F.when(F.col("page_id") % 5 != 2, F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    return p.select("page_id", ingest.outcome(status, title).alias("outcome"))


@query("select page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title from pages")
def page_title(t):
    """I15 by pattern, C15."""
    return t("pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


@query(r"select page_id, url, coalesce(try_cast(nullif(regexp_extract(url, '/(\d+)', 1), '') as bigint), null) as source_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host from pages")
def page_domain(t):
    """C15, C21."""
    return t("pages").select("page_id", "url", T.numeric_id(F.col("url"), r"/(\d+)").alias("source_id"), T.host(F.col("url")).alias("host"))


@query()
def page_documents(t):
    """Pages through a connector."""
    connector = ingest.Connector("example", "http://example/{}", title="title", body="p", dropped=("nav", "div.ad"), tags=("news",))
    return connector.extract(t("pages")).drop("url")


@query("select conv_id::varchar || '@@' || (page + 1)::bigint as source_id, string_agg(text, chr(10) order by turn) as content from (select *, turn // 2 as page from conversations) group by conv_id, page")
def thread_pages(t):
    """I19, C10."""
    return ingest.thread_pages(t("conversations"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def nested_json_get(t):
    """C27."""
    return t("events").select("event_id", T.dotted(F.col("props"), "k").alias("k"))


@query("with w as (select p_partkey::bigint as line, string_split(p_type, ' ') as words from part) select line, array_to_string(list_transform(words, lambda x: lower(x) || length(x)), ' ') as words from w where not list_has_any(list_transform(words, lambda x: upper(x)), ['TIN', 'SMALL'])")
def translate_lines(t):
    """Every line of a file; lines with an unknown word go."""
    lines = t("part").select(F.col("p_partkey").cast("bigint").alias("line"), F.split("p_type", " ").alias("words"))
    words = lines.select(F.explode("words").alias("word")).distinct().where(~F.upper("word").isin("TIN", "SMALL"))
    return ingest.translate(lines, words.select("word", F.concat(F.lower("word"), F.length("word")).alias("translation"))).select("line", F.array_join("words", " ").alias("words"))


@query("select conv_id, turn, replace(array_to_string(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''), ' '), '-', '') as cleaned from conversations")
def srt_like_clean(t):
    """C17, F16."""
    return t("conversations").select("conv_id", "turn", T.clean_srt(F.col("text")).alias("cleaned"))


#: The order of numbered rows, and the places that are drawn among n of them.
_ORDER = lambda key: f"{_DRAWN(repr('bucket'), key)} % 1024, {_DRAWN(repr('order'), key)}, {key}"


def _PLACES(most: int, seed: str, *keys: str) -> str:  # noqa: N802
    some = f"({_DRAWN(seed, repr('start'), *keys)} % n + k * n // {most} + {_DRAWN(seed, 'k', *keys)} % ((k + 1) * n // {most} - k * n // {most})) % n"
    return f"unnest(case when n > {most} then list_transform(range({most}), lambda k: {some}) else range(n) end)"


_ODD = f"""with w as (select distinct label::varchar as category, vec_id::varchar as word from embeddings where label is not null and vec_id is not null),
c as (select category, row_number() over (order by {_ORDER('category')}) - 1 as c, count(*) over () as cats from (select distinct category from w)),
p as (select category, word, row_number() over (partition by category order by {_ORDER('word')}) - 1 as place, count(*) over (partition by category) as n from w),
d as (select w.*, c, {_DRAWN("'1'", 'category', 'word')} % (cats - 1) as drawn from w join c using (category) where cats > 1),
o as (select d.category, d.word, c.category as other from d join c on c.c = d.drawn + (d.drawn >= d.c)::bigint),
a as (select o.category, word, other, {_PLACES(3, "'2'", 'category', 'word')} as place from (select o.*, n from o join (select distinct category as other, n from p) using (other)) o)
select a.category, a.word as odd, other, list(p.word order by p.word) as rest from a join p on p.category = a.other and p.place = a.place group by all"""
_ANALOGIES = f"""with f as (select distinct vec_id::varchar as a, 'x' || vec_id as b from embeddings where vec_id is not null),
g as (select a, count(*) as own from f group by a),
h as (select *, sum(own) over (order by {_ORDER('a')} rows unbounded preceding) - own as first, sum(own) over () as every from g),
t as (select f.*, own, first, every, row_number() over (partition by a order by {_ORDER('b')}) - 1 + first as place from f join h using (a)),
q as (select a, b, first + own as after, every, {_PLACES(5, "'1'", 'a', 'b')} as j from (select *, (every - own)::bigint as n from t)),
r as (select q.a, q.b, t.a as c, t.b as d from q join t on t.place = (q.after + q.j) % q.every)
select if(turn, b, a) as w1, if(turn, a, b) as w2, if(turn, d, c) as w3, if(turn, c, d) as w4 from (select *, {_DRAWN("'1'", 'a', 'b', 'c', 'd')} % 2 = 1 as turn from r)"""


@query(_ODD)
def gen_odd_one_out(t):
    """G01."""
    return testgen.odd_from_categories(t("embeddings").select(F.col("label").cast("string").alias("category"), F.col("vec_id").cast("string").alias("word")))


@query(_ANALOGIES)
def gen_analogies(t):
    """G02, J15."""
    return testgen.analogies(t("embeddings").select(F.col("vec_id").cast("string").alias("a"), F.concat(F.lit("x"), F.col("vec_id")).alias("b")), 5)


@query("select date_trunc('day', ts) as day, event_type, count(*) as n, round(sum(value), 4) as words from events group by all")
def daily_counts(t):
    """R04 as a batch; the stream is in streaming/flows.py."""
    from verbarium.streaming import flows

    return flows.daily_counts(t("events")).withColumn("words", F.round("words", 4))


@query("select word, round(least(1.0, (count / 100.0) ** 0.75), 6) as weight from (" + _VOCAB.format(words=WORDS("sentence"), least=1) + ") where count >= 20")
def glove_weights(t):
    """C46."""
    v = cooccurrence.vocabulary_of(t("documents"), "text", min_count=20)
    return v.select("word", F.round(V.glove_weight(F.col("count")), 6).alias("weight"))


@query("select event_id, strftime(ts, '%Y-%m-%d') as day, floor(epoch(ts) - epoch(timestamp '2024-01-01'))::int as seconds from events")
def date_parts(t):
    """C31, C34."""
    return t("events").select("event_id", F.date_format(D.day(F.col("ts")), "yyyy-MM-dd").alias("day"), D.elapsed(F.lit("2024-01-01").cast("timestamp"), F.col("ts").cast("timestamp")).alias("seconds"))


# ----------------------------------------------------------------- training


@query()
def svd_neighbors(t):
    """Nearest words of the most frequent ones in an SVD model."""
    from verbarium.plans import training

    model = training.svd(t("documents"), dimension=20, min_count=20, subsample=0.0, text="text").select("word", "vec")
    top = cooccurrence.vocabulary_of(t("documents"), "text", max_count=5).select(F.col("word").alias("item"), "word", F.lit(1).alias("sign"))
    return embeddings.nearest_add(model, top, 5).withColumn("score", F.round("score", 4))


@query()
def glove_train_cost(t):
    """Mean cost of each epoch."""
    from verbarium.plans import training

    costs: list[float] = []
    training.glove(_sentences(t), dimension=10, min_count=20, window=5, epochs=4, costs=costs)
    return t("region").sparkSession.createDataFrame([(i, float(c)) for i, c in enumerate(costs)], "epoch int, cost double")


@query()
def word2vec_vectors(t):
    """Skip-gram with a Huffman tree."""
    from verbarium.plans import training

    return training.word2vec(t("documents"), dimension=8, min_count=50, text="text")


@query()
def skipgram_vectors(t):
    """Skip-gram with negative samples, in strata."""
    from verbarium.plans import training

    return training.word2vec(t("documents"), dimension=8, min_count=50, hsoftmax=False, negative=3, epochs=2, text="text")


@query()
def paragraph_vectors(t):
    """Vectors of all sentences, trained with those of their words."""
    from verbarium.plans import training

    return training.paragraph_vectors(_sentences(t), dimension=8, min_count=20, negative=3, epochs=2)[0]


@query()
def cbow_vectors(t):
    """CBOW with negative sampling."""
    from verbarium.plans import training

    return training.word2vec(_sentences(t), dimension=8, min_count=100, algorithm="cbow", hsoftmax=False, negative=3, subsample=1e-3)


@query("select doc_id, s || ' is in regions (' || doc_id || ' years) of \"' || lang || '\".' || chr(10) || 'Size.' || chr(10) || 'It has ' || (2 * (3 + doc_id)) || ' towns & more formula_1.' || chr(10) || 'Seen ' || case when doc_id % 2 = 0 then 'even' else 'odd' end || ' and AB.' as text from (select doc_id, coalesce(source, 'none') as s, coalesce(lang, 'xx') as lang from documents)")
def wikitext_clean(t):
    """Markup made for every document, through templates, a redirect, parser
    functions, links, elements inside one another and headings."""
    from verbarium.operators import wikitext

    row = F.concat(
        F.lit("'''"), F.coalesce("source", F.lit("none")), F.lit("''' is in [[Region|region]]s {{years|"), F.col("doc_id").cast("string"), F.lit("}} of ''"), F.coalesce("lang", F.lit("xx")), F.lit("''.\n== Empty ==\n* item\n== Size ==\nIt has {{#expr: 2 * (3 + "),
        F.col("doc_id").cast("string"), F.lit(")}} towns <ref>x <small>y</small></ref><ul><li>a<ul><li>b</li></ul></li></ul>&amp; more <math>x</math> [http://x label].\n{| class=a\n| b {| c |} d\n|}Seen {{#ifeq: "),
        (F.col("doc_id") % 2).cast("string"), F.lit("| 0 | even | odd}} and {{uc:ab}}<abbr title=x></abbr>{{#ifexpr: 1 | no}}<small>gone</small>."),
    )
    return t("documents").select("doc_id", wikitext.clean(row, {"Age": "({{{1}}} years{{{2|}}})", "Years": "#REDIRECT [[Template:Age]]"}).alias("text"))


@query("select date_trunc('day', ts) as day, event_type, count(*) as n, round(sum(value), 4) as words from events group by all")
def stream_daily_counts(t):
    """All files of the log through a stream."""
    import uuid

    from verbarium.streaming import flows

    log = t("events")
    spark = log.sparkSession
    path = log.inputFiles()[0].rsplit("/", 1)
    rows = spark.readStream.schema(log.schema).option("pathGlobFilter", path[1]).parquet(path[0])
    return flows.run_once(flows.daily_counts(rows), f"daily_{uuid.uuid4().hex}").withColumn("words", F.round("words", 4))

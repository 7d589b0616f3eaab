"""Named queries of the corpus as a product, its catalogue of models and its displays."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbarium.catalogue import _GROWTH, DOCS, FOLD, _docs, _log, _now, query
from verbarium.functions import text as T
from verbarium.operators import catalog, corpus
from verbarium.operators.jobqueue import JobQueue
from verbarium.session import shared_folder

_TITLE = r"substr(regexp_extract(regexp_replace(text, '^\s+', ''), '^[^\n]*'), 1, 50)"


@query(f"""with g as ({_GROWTH}), d as (select distinct day from g), s as (select distinct event_type as data_source from events),
o as (select s.data_source, array_to_string(list(printf('%.3f', coalesce(words, 0.0)) order by d.day), ',') as series from s cross join d left join g on g.data_source = s.data_source and g.day = d.day group by s.data_source),
z as (select data_source, sum(word_count)::bigint as size from {DOCS} group by data_source)
select data_source, size, series from z full join o using (data_source)""")
def corpus_stats(t):
    """Sizes and growth by source, merged; sources of either side stay."""
    rows = corpus.stats(_docs(t), _log(t), _now(t))
    return rows.withColumn("series", F.array_join(F.transform("series", lambda x: F.format_string("%.3f", x)), ","))


@query(f"select doc_id, {_TITLE} as title from documents")
def title_lines(t):
    """C13, I08."""
    return _docs(t).select("doc_id", "title")


@query(f"select doc_id, case when text is null then 0 else 1 end + case when lang = 'en' then 1 else 0 end as fields, {_TITLE} as title, case when lang = 'en' then source end as date from documents")
def document_metadata(t):
    """The wanted fields that a document has."""
    docs = t("documents")
    have = corpus.metadata(["title", "date"], title=T.title_line(F.col("text")), url=F.lit("u"), date=F.when(F.col("lang") == "en", F.col("source")))
    rows = docs.select("doc_id", have.alias("m"))
    return rows.select("doc_id", F.size("m").alias("fields"), F.try_element_at("m", F.lit("title")).alias("title"), F.try_element_at("m", F.lit("date")).alias("date"))


@query("select doc_id || '.txt' as name, md5(text) as content from documents where lang = 'en'")
def corpus_download(t):
    """The files of a query's documents."""
    return corpus.downloads(_docs(t), {"term": {"tags": "en"}}, "doc_id").select("name", F.md5("content").alias("content"))


_KIND = "case n_nationkey % 4 when 0 then 'word2vec' when 1 then 'glove' when 2 then 'svd' else 'other' end"
_STATUS = "case n_nationkey % 3 when 0 then 'UNTRAINED' when 1 then 'TRAINING' else 'TRAINED' end"


def _models(t):
    i = F.col("n_nationkey")
    kind = F.when(i % 4 == 0, "word2vec").when(i % 4 == 1, "glove").when(i % 4 == 2, "svd").otherwise("other")
    status = F.when(i % 3 == 0, "UNTRAINED").when(i % 3 == 1, "TRAINING").otherwise("TRAINED")
    given = F.create_map(F.lit("dimension"), (i * 10).cast("string"), F.lit("window"), F.lit("5"), F.lit("cds"), F.lit("0.75"), F.lit("alpha"), F.lit("0.025"), F.lit("epochs"), F.lit("3"))
    return t("nation").select(i.alias("embedding_id"), F.col("n_name").alias("description"), kind.alias("model"), status.alias("status"), given.alias("parameters"))


@query(f"""select id, description, model, status, 'emb' || id || '-' || model as file,
case model when 'word2vec' then 'word2vec algo=None dim=' || id * 10 || ' win=5 alpha=0.025 hs=None neg=None epochs=3'
when 'glove' then 'glove dim=' || id * 10 || ' win=5 alpha=0.025 epochs=3' when 'svd' then 'svd dim=' || id * 10 || ' win=5 cds=0.75 context=None' else model end as name
from (select n_nationkey as id, n_name as description, {_KIND} as model, {_STATUS} as status from nation)""")
def model_summaries(t):
    """F21, C22, F23, P05."""
    return catalog.summaries(_models(t)).withColumn("file", catalog.model_file(F.col("id"), F.col("model")))


@query(f"select n_nationkey as embedding_id, 'emb' || n_nationkey || '-' || k || e.ext as name from (select *, {_KIND} as k from nation), (select unnest(['.txt', '.npy', '_old.txt', '']) as ext) e")
def model_files_found(t):
    """A model's own files among all files."""
    models = _models(t).select("embedding_id", catalog.model_file(F.col("embedding_id"), F.col("model")).alias("file"))
    files = models.select(F.explode(F.transform(F.array(*[F.lit(x) for x in (".txt", ".npy", "_old.txt", "")]), lambda x: F.concat("file", x))).alias("name"))
    others = t("region").select(F.concat(F.lit("A0"), F.col("r_regionkey"), F.lit("-analogies.txt")).alias("name"))
    return catalog.own_files(models, files.unionByName(others)).select("embedding_id", "name")


@query("""select * from (values ('word2vec', 'dimension', '300'), ('word2vec', 'min_count', '5'), ('word2vec', 'window', '5'), ('word2vec', 'subsampling', '0.0'), ('word2vec', 'algorithm', 'skipgram'), ('word2vec', 'hsoftmax', 'True'), ('word2vec', 'negative', '0'), ('word2vec', 'epochs', '1'), ('word2vec', 'alpha', '0.025'),
('glove', 'dimension', '100'), ('glove', 'min_count', '10'), ('glove', 'max_count', 'None'), ('glove', 'x_max', '100.0'), ('glove', 'window', '15'), ('glove', 'alpha', '0.75'), ('glove', 'eta', '0.05'), ('glove', 'epochs', '15'),
('svd', 'dimension', '300'), ('svd', 'min_count', '10'), ('svd', 'max_count', 'None'), ('svd', 'window', '5'), ('svd', 'subsampling', '1e-05'), ('svd', 'cds', '0.75'), ('svd', 'sum_context', 'True'),
(null, 'sentence_tokenizer', 'periodspace'), (null, 'word_tokenizer', 'alphanum'), (null, 'lowercase_tokens', 'True'), (null, 'remove_accents', 'True'), (null, 'analogies', null), (null, 'odd-one-out', null), (null, 'similarity', null)) v(model, name, value)""")
def enumerated_options(t):
    """P10, F24."""
    return catalog.enumerated(t("region").sparkSession).drop("kind")


_ASKED = "(select o_orderkey as request_id, (o_custkey % 2000)::bigint as embedding_id from orders)"
_ANSWERS = f"""(select request_id, embedding_id, case when embedding_id not in (select c_custkey from customer) then 404
when embedding_id in (select s_suppkey from supplier) or request_id > min(request_id) over (partition by embedding_id) then 400 else 201 end as code from {_ASKED})"""


def _answers(t):
    asked = t("orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 2000).alias("embedding_id"))
    models = t("customer").select(F.col("c_custkey").alias("embedding_id"))
    return catalog.ask_training(asked, models, t("supplier").select(F.col("s_suppkey").alias("embedding_id")))


@query(f"select * from {_ANSWERS}")
def training_requests(t):
    """A second training job is refused."""
    return _answers(t)


@query(f"select c_custkey as embedding_id, case when c_custkey in (select embedding_id from {_ANSWERS} where code = 201) then 'TRAINING' else 'UNTRAINED' end as status from customer")
def training_started(t):
    """P07, F24."""
    models = t("customer").select(F.col("c_custkey").alias("embedding_id"), F.lit("UNTRAINED").alias("status"))
    return catalog.started(models, _answers(t))


@query("""with g as (select c_custkey as k from customer where c_nationkey = 3)
select 'model' as what, c_custkey as id, case when c_custkey in (from g) then 'UNTRAINED' else 'TRAINED' end as status from customer
union all select 'result', o_orderkey, null from orders where o_custkey not in (from g)
union all select 'job', s_suppkey, null from supplier where s_suppkey not in (from g)""")
def model_clean_up(t):
    """A deleted model's jobs and results go, and it is untrained again."""
    models = t("customer").select(F.col("c_custkey").alias("embedding_id"), F.lit("TRAINED").alias("status"), "c_nationkey")
    results = t("orders").select(F.col("o_custkey").alias("embedding_id"), F.col("o_orderkey").alias("id"))
    jobs = t("supplier").select(F.col("s_suppkey").alias("embedding_id"), F.col("s_suppkey").alias("id"))
    models, results, jobs = catalog.clean_up(models.where("c_nationkey = 3"), models, results, jobs)
    none = F.lit(None).cast("string").alias("status")
    out = models.select(F.lit("model").alias("what"), F.col("embedding_id").alias("id"), "status")
    return out.unionAll(results.select(F.lit("result"), "id", none)).unionAll(jobs.select(F.lit("job"), "id", none))


@query("select p_partkey as id, p_brand as name, case when p_partkey % 3 = 0 then 'new ' || p_partkey else p_name end as description from part")
def changed_descriptions(t):
    """Only descriptions change."""
    rows = t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.col("p_name").alias("description"))
    changes = rows.where("id % 3 = 0").select("id", F.concat(F.lit("new "), F.col("id")).alias("description"), F.lit("x").alias("name"))
    return catalog.described(rows, changes, "id").select("id", "name", "description")


def _tested(t):
    models = t("customer").select(F.col("c_custkey").alias("embedding_id"), F.when(F.col("c_custkey") % 5 == 0, "UNTRAINED").otherwise("TRAINED").alias("status"))
    results = t("orders").select(F.col("o_custkey").alias("embedding_id"), (F.col("o_orderkey") % 30).alias("testset_id"))
    testsets = t("orders").select((F.col("o_orderkey") % 30).alias("testset_id")).distinct()
    return models, testsets, results


_LACK = "not exists (select 1 from orders where o_custkey = embedding_id and o_orderkey % 30 = testset_id)"


@query(f"select * from (select c_custkey as embedding_id, 7::bigint as testset_id from customer where c_custkey % 5 <> 0) where {_LACK} union all select * from (select 11::bigint as embedding_id, (range)::bigint as testset_id from range(30)) where {_LACK}")
def tests_missing(t):
    """What lacks a result, on either side."""
    given = _tested(t)
    return catalog.tests_to_run(*given, "missing", 7).unionByName(catalog.tests_to_run(*given, 11, "missing"))


@query("select c_custkey as embedding_id, 7::bigint as testset_id from customer where c_custkey % 5 <> 0 union all select 11, range from range(30) union all select 12, 3")
def tests_full(t):
    """Everything, on either side, and one pair."""
    given = _tested(t)
    return catalog.tests_to_run(*given, "full", 7).unionByName(catalog.tests_to_run(*given, 11, "full")).unionByName(catalog.tests_to_run(*given, 12, 3))


@query("""select s_suppkey as testset_id, s_name as name, coalesce(p, -1.0)::double as progress, s_name || '-analogies.txt' as file
from supplier left join (select o_custkey, max(case when o_orderstatus = 'F' then 100.0 else 0.0 end) as p from orders group by o_custkey) on o_custkey = s_suppkey""")
def testsets_listed(t):
    """Test sets with the progress of their jobs."""
    jobs = t("orders").select(F.col("o_custkey").alias("testset_id"), F.when(F.col("o_orderstatus") == "F", 100.0).otherwise(0.0).alias("progress"))
    sets = t("supplier").select(F.col("s_suppkey").alias("testset_id"), F.col("s_name").alias("name"))
    return catalog.by_progress(sets, jobs).withColumn("file", catalog.test_file(F.col("name"), F.lit("analogies")))


@query("""select label::int as testset_id, case label % 3 when 0 then '''' || w[1] || ''' is to ''' || w[2] || ''' as ''' || w[3] || ''' is to... (''' || w[4] || ''')'
when 1 then '''' || w[1] || ''' and ''' || w[2] || ''' are similar with score ' || w[3] else '''' || w[1] || ''' is the odd one in [''' || array_to_string(w, ''', ''') || ''']' end as sample
from (select label, list_transform([0, 1, 2, 3], lambda k: (min(vec_id) + k)::varchar) as w from embeddings group by label)""")
def sample_sentences(t):
    """The first item of each test set, as a sentence."""
    i = F.col("vec_id")
    kind = F.when(F.col("label") % 3 == 0, "analogies").when(F.col("label") % 3 == 1, "similarity").otherwise("odd-one-out")
    items = t("embeddings").select(F.col("label").cast("int").alias("testset_id"), i.alias("item"), F.array(*[(i + k).cast("string") for k in range(4)]).alias("words"), kind.alias("test_type"))
    return catalog.sample_entries(items)


@query(f"select doc_id, md5(lower(text)) as lowered, md5({FOLD('text')}) as folded, md5(text) as plain from documents")
def preprocess_options(t):
    """Each choice of pre-processing."""
    text = F.col("text")
    return t("documents").select("doc_id", F.md5(T.preprocess(text, True, False)).alias("lowered"), F.md5(T.preprocess(text, False, True)).alias("folded"), F.md5(T.preprocess(text, False, False)).alias("plain"))


@query("""select event_id, strftime(ts, '%d/%m/%Y %H:%M') as shown,
case when s >= 86400 then (s // 86400) || ' days ' else '' end || case when s % 86400 >= 3600 then (s % 86400 // 3600) || ' hours ' else '' end || case when s % 3600 >= 60 then (s % 3600 // 60) || ' minutes ' else '' end as duration
from (select *, event_id * 37 % 300000 as s from events)""")
def displayed(t):
    """C24."""
    return t("events").select("event_id", T.date_shown(F.col("ts")).alias("shown"), T.long_duration(F.col("event_id") * 37 % 300000).alias("duration"))


@query("select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') as title, upper(substr(p_name, 1, 1)) || substr(p_name, 2) as first, lower(substr(p_type, 1, 1)) || substr(p_type, 2) as lowered from part")
def cased_names(t):
    """C24, C25."""
    return t("part").select("p_partkey", T.title_case(F.col("p_name")).alias("title"), T.ucfirst(F.col("p_name")).alias("first"), T.lcfirst(F.col("p_type")).alias("lowered"))


@query("""with o as (select o_orderkey as job_id, o_orderkey % 2 = 0 as even, row_number() over (order by o_orderkey) as k from orders),
c as (select job_id from o where (k <= 200 and not even) or k > 400 order by job_id limit 150)
select job_id, case when k <= 400 and even then 'SUCCESS' when k <= 400 or c.job_id is not null then 'PROGRESS' else 'PENDING' end as status,
case when c.job_id is not null then 'c' when k <= 200 then 'a' when k <= 400 then 'b' end as worker,
(case when k <= 400 then 1 else 0 end + case when c.job_id is not null then 1 else 0 end)::int as tries from o left join c using (job_id)""")
def job_leases(t):
    """Two workers take jobs and finish some, a third takes up what the first left,
    and the first comes too late for the rest."""
    spark = t("orders").sparkSession
    queue = JobQueue(spark, shared_folder(spark))
    queue.add(t("orders").select(F.col("o_orderkey").alias("job_id")))
    even = F.col("job_id") % 2 == 0
    queue.take("a", 0, 60, 200)
    queue.take("b", 30, 60, 200)
    queue.finish("a", 40, even)
    queue.finish("b", 50, even)
    queue.take("c", 70, 60, 150)
    queue.finish("a", 80, F.lit(True))
    return queue.jobs().select("job_id", "status", "worker", "tries")

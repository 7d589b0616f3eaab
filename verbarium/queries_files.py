"""Named queries of files: what the sinks write, as the readers read it again, and the
numbers that trainings are run by."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from verbarium.catalogue import DOCS, WORDS, _docs, _model, _quads, query
from verbarium.functions import text as T
from verbarium.operators import corpus, testgen
from verbarium.plans import training
from verbarium.session import shared_folder
from verbarium.sources import readers, sinks
from verbarium.sources.keyed import KeyedTable


def _folder(t) -> tuple:
    spark = t("region").sparkSession
    return spark, shared_folder(spark)


_QUADS = "(select vec_id // 4 * 4 as w from embeddings group by 1 having count(distinct vec_id) = 4)"

# ------------------------------------------------------------------ test sets


@query(f"select w::varchar as w1, (w + 1)::varchar as w2, (w + 2)::varchar as w3, (w + 3)::varchar as w4 from {_QUADS}")
def file_analogies(t):
    """S08, K11."""
    spark, path = _folder(t)
    sinks.write_test_set(_quads(t, False).select("w1", "w2", "w3", "w4"), path)
    return readers.read_analogies(spark, path).drop("item")


@query(f"select w::varchar as odd, (w + 1) || ' ' || (w + 2) || ' ' || (w + 3) as rest from {_QUADS}")
def file_odd_one_outs(t):
    """S08, K11."""
    spark, path = _folder(t)
    sinks.write_test_set(_quads(t, False).select("w1", "w2", "w3", "w4"), path)
    return readers.read_odd_one_out(spark, path).select("odd", F.array_join("rest", " ").alias("rest"))


@query(f"select w::varchar as w1, (w + 1)::varchar as w2, (w % 7 / 2.0)::double as score from {_QUADS}")
def file_similarities(t):
    """S08, K11."""
    spark, path = _folder(t)
    sinks.write_test_set(_quads(t, False).select("w1", "w2", (F.col("w1") % 7 / 2.0).alias("score")), path)
    return readers.read_similarities(spark, path).drop("item")


@query("select distinct lower(w) as word from (select unnest(string_split(p_name, ' ')) as w from part)")
def file_words(t):
    """S18, A27."""
    spark, path = _folder(t)
    t("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("value")).write.text(path)
    return readers.read_words(spark, path)


@query("select (o_orderstatus || '.' || o_orderpriority) as name, count(distinct o_orderkey) as n, min(o_orderkey::varchar) as least from orders group by 1")
def file_conjugations(t):
    """Nested forms from a file of JSON, flattened and inverted."""
    spark, path = _folder(t)
    groups = t("orders").groupBy(F.col("o_orderkey").cast("string").alias("verb"), "o_orderstatus").agg(F.map_from_entries(F.collect_list(F.struct(F.regexp_replace("o_orderpriority", "-", "-"), F.col("o_orderkey").cast("string")))).alias("inner"))
    groups.groupBy("verb").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "inner"))).alias("forms")).write.json(path)
    rows = testgen.inverted(testgen.flattened(readers.read_conjugations(spark, path)))
    return rows.select("name", F.size("forms").cast("bigint").alias("n"), F.array_min("forms").alias("least"))


@query("select lower(c_name) as b, c_custkey::varchar as a from (select c_custkey, replace(c_name, '#', '') as c_name from customer)")
def file_verb_pairs(t):
    """S18, G03."""
    spark, path = _folder(t)
    t("customer").select(F.concat_ws(" ", F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), "c_custkey").alias("value")).write.text(path)
    return readers.read_verb_pairs(spark, path)


# --------------------------------------------------------------------- models


@query("select vec_id::varchar as word, len(embedding)::int as n, round(printf('%.6f', embedding[1]::double)::float::double, 6) as first, round(printf('%.6f', embedding[64]::double)::float::double, 6) as last from embeddings")
def file_vectors(t):
    """Text vectors, six digits a number."""
    spark, path = _folder(t)
    sinks.write_vectors(_model(t).withColumn("context", F.col("vec")), path, "word")
    vec = F.transform("vec", lambda x: x.cast("double"))
    return readers.read_vectors(spark, path).select("word", F.size("vec").alias("n"), F.round(vec[0], 6).alias("first"), F.round(vec[63], 6).alias("last"))


@query("select vec_id as word, round(list_inner_product(e, e) ** 0 , 3) as norm, round(e[1] / sqrt(list_inner_product(e, e)), 4) as first from (select vec_id, embedding::double[] as e from embeddings)")
def file_model(t):
    """A model whose rows were three times too long."""
    spark, path = _folder(t)
    sinks.write_model(_model(t).select("word", F.col("word").alias("idx"), F.transform("vec", lambda x: x * 3).alias("vec")), path)
    from verbarium.functions import vector as V

    return readers.read_model(spark, path).select("word", F.round(V.norm(F.col("vec")), 3).alias("norm"), F.round(F.col("vec")[0].cast("double"), 4).alias("first"))


@query("select l_partkey::int as w, l_suppkey::int as c, sum(l_quantity)::double as x from lineitem group by 1, 2")
def file_cells(t):
    """Co-occurrences as binary triples."""
    spark, path = _folder(t)
    sinks.write_cells(t("lineitem").groupBy(F.col("l_partkey").alias("w"), F.col("l_suppkey").alias("c")).agg(F.sum("l_quantity").alias("x")), path, 1000)
    return readers.read_cells(spark, path)


@query("select l_partkey as w, count(*) as n from lineitem group by 1")
def cached_counts(t):
    """What was made under a key is read the second time."""
    spark, path = _folder(t)
    key = training.cache_key({"match_all": {}}, {"lowercase_tokens": True}, min_count=1, window=5)
    training.cached_cells(path, key, lambda: t("lineitem").groupBy(F.col("l_partkey").alias("w")).agg(F.count("*").alias("n")))

    def again():
        raise AssertionError("made twice")

    return training.cached_cells(path, key, again)


@query("""with w as (select label::varchar || '_' || (vec_id % 7) as tag, embedding from embeddings where vec_id % 5 <> 0)
select tag, round(avg(embedding[1]::double), 5) as first, round(avg(embedding[64]::double), 5) as last from w group by tag""")
def document_vectors(t):
    """The mean of the known words of each sentence."""
    rows = t("embeddings").groupBy(F.col("label").alias("doc_id"), (F.col("vec_id") % 7).alias("sid")).agg(F.collect_list("vec_id").alias("tokens"))
    out = training.document_vectors(rows, _model(t).where("word % 5 <> 0"))
    return out.select("tag", F.round(F.col("vec")[0], 5).alias("first"), F.round(F.col("vec")[63], 5).alias("last"))


@query("select event_id, round(0.025 - 0.0249 * least(user_id / 10.0, 1 + event_id % 20) / (1 + event_id % 20), 9) as rate from events")
def event_learning_rates(t):
    """The rate that each event of a training log comes with."""
    rate = training.rate_at(F.col("user_id") / 10.0, 1 + F.col("event_id") % 20, 0.025, 0.0001)
    return t("events").select("event_id", F.round(rate, 9).alias("rate"))


@query("""select event_id, round(start + size * (n + share) / epochs, 9) as done from (
  select event_id, event_id % 3 as k, event_id // 3 % 3 as p, case when event_id // 3 % 3 = 2 then event_id // 9 % 4 else 0 end as n, case when event_id // 3 % 3 = 2 then 4 else 1 end as epochs, user_id % 11 / 10.0 as share from events) left join (
  values (0, 0, 0.0::double, 0.2::double), (0, 2, 0.2, 0.8), (1, 0, 0.0, 0.05), (1, 1, 0.05, 0.2), (1, 2, 0.35, 0.65), (2, 0, 0.0, 0.1), (2, 1, 0.1, 0.7), (2, 2, 0.8, 0.2)) v(k, p, start, size) using (k, p)""")
def event_progress(t):
    """How much of its training each event of a log reports; none where the kind
    doesn't have the phase."""
    i = F.col("event_id")
    fit = F.floor(i / 3) % 3 == 2
    kind = F.element_at(F.array(F.lit("word2vec"), F.lit("glove"), F.lit("svd")), (i % 3 + 1).cast("int"))
    phase = F.element_at(F.array(F.lit("vocabulary"), F.lit("cooccurrence"), F.lit("fit")), (F.floor(i / 3) % 3 + 1).cast("int"))
    done = training.progress_at(kind, phase, F.col("user_id") % 11 / 10.0, F.when(fit, F.floor(i / 9) % 4).otherwise(0), F.when(fit, 4).otherwise(1))
    return t("events").select("event_id", F.round(done, 9).alias("done"))


@query("select n_nationkey as epochs, e::int as epoch, round(0.025 - 0.0249 * e / n_nationkey, 9) as first, round(0.025 - 0.0249 * (e + 1) / n_nationkey, 9) as last from nation, range(n_nationkey) r(e) where n_nationkey > 0")
def learning_rates(t):
    """The rates of trainings of 1 to 24 epochs."""
    rows = [(n, *r) for n in range(1, 25) for r in training.rates(0.025, 0.0001, n)]
    out = t("region").sparkSession.createDataFrame(rows, "epochs int, epoch int, first double, last double")
    return out.select("epochs", "epoch", F.round("first", 9).alias("first"), F.round("last", 9).alias("last"))


@query("""select * from (values ('word2vec', 'vocabulary', 0.1::double), ('word2vec', 'fit', 0.5), ('glove', 'vocabulary', 0.025), ('glove', 'cooccurrence', 0.15), ('glove', 'fit', 0.59375), ('svd', 'vocabulary', 0.05), ('svd', 'cooccurrence', 0.45), ('svd', 'fit', 0.875)) v(model, phase, done)""")
def training_progress(t):
    """Half of a phase; of a fit, half of its second epoch of four."""
    rows = [(m, p, round(training.progress(m, p, 0.5, *((1, 4) if p == "fit" else (0, 1))), 9)) for m, ps in training.PHASES.items() for p in ps]
    return t("region").sparkSession.createDataFrame(rows, "model string, phase string, done double")


@query("""select * from (values ('word2vec', 'subsample', '0.0'), ('word2vec', 'window', '7'), ('glove', 'rate', '0.05'), ('glove', 'window', '7'), ('svd', 'smoothing', '0.75'), ('svd', 'subsample', '1e-05'), ('svd', 'window', '7')) v(model, name, value)""")
def training_arguments(t):
    """M17, MJ: stored parameters under the names of the functions."""
    rows = [(m, k, str(v)) for m in ("word2vec", "glove", "svd") for k, v in training.arguments(m, {"window": 7}).items() if k in ("subsample", "rate", "smoothing", "window")]
    return t("region").sparkSession.createDataFrame(rows, "model string, name string, value string")


# --------------------------------------------------------------------- corpus


@query(f"select doc_id, data_source, word_count from {DOCS}")
def file_corpus(t):
    """A corpus by source, as written and read."""
    spark, path = _folder(t)
    sinks.write_corpus(_docs(t), path)
    return spark.read.parquet(path).select("doc_id", "data_source", "word_count")


@query("select user_id as _id, max(event_id) as event_id from events group by 1")
def file_upsert(t):
    """A table's rows replaced by newer ones."""
    spark, path = _folder(t)
    rows = t("events").select(F.col("user_id").alias("_id"), "event_id")
    rows.where("event_id % 2 = 0").groupBy("_id").agg(F.max("event_id").alias("event_id")).write.parquet(path)
    sinks.upsert_corpus(spark, path, rows.where("event_id % 2 = 1"), path + "-new", "event_id")
    return spark.read.parquet(path + "-new")


_LATEST = "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1"


@query(_LATEST)
def keyed_upserts(t):
    """Batches into the buckets of a table, each of them twice."""
    spark, path = _folder(t)
    table = KeyedTable(spark, path, ["user_id"], "event_id", 16)
    rows = t("events").select("user_id", "event_id", "event_type", "value")
    for number, part in enumerate((2, 0, 1)):
        for _ in range(2):
            table.upsert(rows.where(F.col("event_id") % 3 == part), ("log", number))
    return table.read()


@query(_LATEST)
def stream_upserts(t):
    """A stream's batches into the buckets of a table."""
    from verbarium.streaming import flows

    spark, path = _folder(t)
    t("events").select("user_id", "event_id", "event_type", "value").repartition(3, "event_id").write.parquet(path)
    table = KeyedTable(spark, f"{path}-table", ["user_id"], "event_id", 16)
    flows.upsert_into(flows.stream(spark, path, 1), table, "log", f"{path}-checkpoint").awaitTermination()
    return table.read()


@query("select md5(string_agg(line, chr(10) order by line)) as lines, count(*) as n from (select unnest(string_split(text, chr(10))) as line from documents where text is not null)")
def file_texts(t):
    """Contents in compressed files of bounded size."""
    spark, path = _folder(t)
    sinks.write_texts(_docs(t).where("content is not null"), path, 300, "bzip2")
    lines = spark.read.option("lineSep", "\n").text(path)
    return sinks.digested(lines)


_SAFE = r"regexp_replace(text, '[<>&]', ' ', 'g')"


@query(f"select doc_id::varchar as id, 'http://h/' || doc_id as url, source as title, md5(regexp_replace(source || chr(10) || chr(10) || {_SAFE}, '^\\s+|\\s+$', '', 'g')) as content from documents where text is not null and source is not null")
def file_pages(t):
    """Documents as elements of pseudo XML files."""
    spark, path = _folder(t)
    docs = t("documents").where("text is not null and source is not null")
    sinks.write_pages(docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("http://h/"), "doc_id").alias("url"), F.col("source").alias("title"), F.regexp_replace("text", "[<>&]", " ").alias("text")), path)
    return readers.read_pseudo_xml(spark, path).withColumn("content", F.md5("content"))


def _dump(t, path: str) -> None:
    """A dump of all documents: articles, pages of other namespaces, redirects and
    templates."""
    i = F.col("doc_id")
    space = F.when(i % 7 == 0, 10).when(i % 7 == 1, 1).otherwise(0)
    title = F.concat(F.when(i % 7 == 0, "Template:T").when(i % 7 == 1, "Talk:P").otherwise("P"), i)
    page = F.concat(F.lit("<page><title>"), title, F.lit("</title><ns>"), space, F.lit("</ns><id>"), i, F.lit("</id>"), F.when(i % 7 == 2, '<redirect title="X"/>').otherwise(""), F.lit('<revision><text xml:space="preserve">Body of '), i, F.lit(" &amp; {{t|1}}</text></revision></page>"))

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["<mediawiki>"]})
        yield from frames
        yield pd.DataFrame({"value": ["</mediawiki>"]})

    t("documents").select(page.alias("value")).mapInPandas(whole, "value string").write.text(path)


@query("select distinct doc_id as id, 'P' || doc_id as title, 'Body of ' || doc_id || ' & {{t|1}}' as text from documents where doc_id % 7 > 2")
def file_wiki_pages(t):
    """S11, F19."""
    spark, path = _folder(t)
    _dump(t, path)
    return readers.read_wiki_pages(spark, path).distinct()


@query("select distinct 'Template:T' || doc_id as title, 'Body of ' || doc_id || ' & {{t|1}}' as text from documents where doc_id % 7 = 0")
def file_wiki_templates(t):
    """The pass over a dump's templates."""
    spark, path = _folder(t)
    _dump(t, path)
    return readers.read_templates(spark, path).distinct()


@query(f"select coalesce(source, 'none') as year, sum(len({WORDS(_SAFE)}))::bigint as words from documents where text is not null group by 1")
def file_xml_texts(t):
    """Gzipped XML files in folders: all text nodes. The reader takes a file
    whole, so files have a bounded number of documents."""
    spark, path = _folder(t)
    body = F.concat(F.lit("<doc><s id='1'><w>"), F.regexp_replace("text", "[<>&]", " "), F.lit("</w></s></doc>"))
    t("documents").where("text is not null").select(F.coalesce("source", F.lit("none")).alias("source"), body.alias("value")).write.partitionBy("source").option("maxRecordsPerFile", 500).option("compression", "gzip").text(path)
    rows = readers.read_xml_texts(spark, path).withColumn("words", F.size(T.tokens(F.col("content"))))
    return rows.groupBy(F.regexp_replace("year", "^source=", "").alias("year")).agg(F.sum("words").alias("words"))


@query("select user_id as _id, count(*) as n from events group by 1")
def ensured_table(t):
    """A table made once, filled, and kept by a second call."""
    spark, path = _folder(t)
    name = "verbarium_" + path.rsplit("/", 1)[1]
    for _ in range(2):
        sinks.ensure_table(spark, name, "_id bigint, n bigint")
    t("events").groupBy(F.col("user_id").alias("_id")).agg(F.count("*").alias("n")).write.mode("append").insertInto(name)
    sinks.ensure_table(spark, name, "_id bigint, n bigint")
    return spark.table(name)


@query(f"select doc_id from {DOCS} where word_count >= 10 and data_source is not null")
def prepared_documents(t):
    """What an importer indexes."""
    return corpus.long_enough(_docs(t)).where("data_source is not null and length(_id) = 30 and content_type = 'clean'").select("doc_id")

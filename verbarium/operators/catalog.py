"""The catalogue of models, test sets, jobs and results (survey J01-J04, W01-W02, F22, K12-K13, P05-P10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODELS = {
    "word2vec": {"dimension": 300, "min_count": 5, "window": 5, "subsampling": 0.0, "algorithm": "skipgram", "hsoftmax": True, "negative": 0, "epochs": 1, "alpha": 0.025},
    "glove": {"dimension": 100, "min_count": 10, "max_count": None, "x_max": 100.0, "window": 15, "alpha": 0.75, "eta": 0.05, "epochs": 15},
    "svd": {"dimension": 300, "min_count": 10, "max_count": None, "window": 5, "subsampling": 1e-5, "cds": 0.75, "sum_context": True},
}
PREPROCESSING = {"sentence_tokenizer": "periodspace", "word_tokenizer": "alphanum", "lowercase_tokens": True, "remove_accents": True}
TESTS = ("analogies", "odd-one-out", "similarity")
EMBEDDING_KEYS = {"model", "description", "parameters", "query", "preprocessing"}


def new_embedding(spec: dict) -> dict:
    """Exactly the five keys, a known model, defaults for what isn't given."""
    if set(spec) != EMBEDDING_KEYS:
        raise ValueError(f"missing {sorted(EMBEDDING_KEYS - set(spec))}, unknown {sorted(set(spec) - EMBEDDING_KEYS)}")
    if spec["model"] not in MODELS:
        raise ValueError(f"no model {spec['model']}")
    return spec | {"parameters": MODELS[spec["model"]] | (spec["parameters"] or {}), "preprocessing": PREPROCESSING | (spec["preprocessing"] or {}), "status": "UNTRAINED"}


#: Ranges of values that a group's ranks are counted in.
RANGES = 256


def ranks(rows: DataFrame, by: list[str], value: str, descending: bool = False) -> DataFrame:
    """``rows`` with _rank (of the first of equal values, null last) and _ties. Distinct
    values are counted first and ranked within ranges, and the ranges by their sums: no
    task holds a whole group, nor all rows of one value."""
    number = F.col(value).cast("double")
    seen = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties"))
    edges = seen.groupBy(*by).agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"))
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by]
    seen = seen.alias("s").join(edges.alias("e"), on).select("s.*", "_lo", "_hi") if by else seen.crossJoin(F.broadcast(edges))
    share = F.when(F.col("_hi") > F.col("_lo"), (number - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    place = F.floor((1 - share if descending else share) * (RANGES - 1)).cast("int")
    seen = seen.withColumn("_range", F.when(number.isNull(), RANGES).otherwise(place)).drop("_lo", "_hi")
    sums = seen.groupBy(*by, "_range").agg(F.sum("_ties").alias("_n"))
    sums = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")).drop("_n")
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_range"]]
    seen = seen.alias("s").join(sums.alias("b"), on).select("s.*", "_before")
    inside = Window.partitionBy(*by, "_range").orderBy(F.desc_nulls_last(value) if descending else F.asc_nulls_last(value))
    seen = seen.withColumn("_rank", F.sum("_ties").over(inside) - F.col("_ties") + F.col("_before") + 1)
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, value]]
    return rows.alias("r").join(seen.alias("s"), on).select("r.*", "_rank", "_ties")


def ranked(results: DataFrame, partition: str = "testset_id", score: str = "accuracy") -> DataFrame:
    """Rank among all results of a test set; filter afterwards."""
    return ranks(results, [partition], score, True).withColumnRenamed("_rank", "rank").drop("_ties")


def filtered(df: DataFrame, **equal) -> DataFrame:
    """conditions that are given."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def lacking(left: DataFrame, results: DataFrame, key: str | list[str]) -> DataFrame:
    """J02."""
    return left.join(results.select(key).distinct(), key, "left_anti")


def named(results: DataFrame, models: DataFrame, testsets: DataFrame) -> DataFrame:
    """Results with what their model and test set are called."""
    return results.join(models, "embedding_id").join(testsets, "testset_id")


def status(task: str = "task_id", elapsed: str = "elapsed_time", broker: Column | None = None) -> tuple[Column, Column]:
    """(status, progress) of a job; progress is 100 when it has finished."""
    running, done = F.col(task).isNotNull(), F.col(elapsed).isNotNull()
    state = F.when(running, broker if broker is not None else F.lit("PROGRESS")).when(done, "SUCCESS").otherwise("PENDING")
    return state, F.when(~running & done, 100.0).otherwise(0.0)


def plan_jobs(embeddings: DataFrame, testsets: DataFrame, jobs: DataFrame) -> DataFrame:
    """A job for each trained model and test set; pending and running ones stay
    (``keep``), finished ones are replaced (``replace``), the rest is new (``create``)."""
    wanted = embeddings.where("status = 'TRAINED'").select("embedding_id").crossJoin(testsets.select("testset_id"))
    state = jobs.select("embedding_id", "testset_id", "status").dropDuplicates(["embedding_id", "testset_id"])
    action = F.when(F.col("status").isNull(), "create").when(F.col("status").isin("PENDING", "PROGRESS"), "keep").otherwise("replace")
    return wanted.join(state, ["embedding_id", "testset_id"], "left").select("embedding_id", "testset_id", action.alias("action"))


def cascade(parent: int, key: str, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """The tables without what belongs to a deleted model or test set."""
    return tuple(t.where(F.col(key) != parent) for t in tables)


def jobs_by_testset(jobs: DataFrame) -> DataFrame:
    """A25."""
    done = F.count(F.when(F.col("elapsed_time").isNotNull(), 1))
    return jobs.groupBy("testset_id").agg(F.count("*").alias("jobs"), done.alias("finished"), F.max("progress").alias("progress"), (done / F.count("*")).alias("share"))


# What a model is called, the order of statuses in a list, and sentences.
NAMES = {
    "word2vec": ("algo=algorithm", "dim=dimension", "win=window", "alpha=alpha", "hs=hsoftmax", "neg=negative", "epochs=epochs"),
    "glove": ("dim=dimension", "win=window", "alpha=alpha", "epochs=epochs"),
    "svd": ("dim=dimension", "win=window", "cds=cds", "context=sum_context"),
}
STATUS_ORDER = ("TRAINING", "TRAINED", "UNTRAINED")


def model_name(kind: Column, parameters: Column) -> Column:
    """The model and those of its parameters (a map of strings) that tell it apart."""
    out = kind
    for model, shown in NAMES.items():
        parts = [F.concat(F.lit(x.partition("=")[0] + "="), F.coalesce(F.try_element_at(parameters, F.lit(x.partition("=")[2])), F.lit("None"))) for x in shown]
        out = F.when(kind == model, F.concat_ws(" ", kind, *parts)).otherwise(out)
    return out


def sample_sentence(kind: Column, w: Column) -> Column:
    """C23, of an array of words; the third of a similarity is its score."""
    listed = F.concat(F.lit("['"), F.array_join(w, "', '"), F.lit("']"))
    odd = F.format_string("'%s' is the odd one in %s", w[0], listed)
    alike = F.format_string("'%s' and '%s' are similar with score %s", F.get(w, 0), F.get(w, 1), F.get(w, 2))
    return F.when(kind == "analogies", F.format_string("'%s' is to '%s' as '%s' is to... ('%s')", *[F.get(w, i) for i in range(4)])).when(kind == "similarity", alike).when(kind == "odd-one-out", odd).otherwise("")


def sample_entries(items: DataFrame, testset: str = "testset_id", item: str = "item", words: str = "words", kind: str = "test_type") -> DataFrame:
    """The first item of each test set as a sentence."""
    first = items.groupBy(testset).agg(F.min_by(F.struct(F.col(kind).alias("k"), F.col(words).alias("w")), item).alias("f"))
    return first.select(testset, sample_sentence(F.col("f.k"), F.col("f.w")).alias("sample"))


def model_file(embedding_id: Column, kind: Column) -> Column:
    """F23."""
    return F.format_string("emb%s-%s", embedding_id.cast("string"), kind)


def test_file(name: Column, kind: Column) -> Column:
    """F23."""
    return F.format_string("%s-%s.txt", name, kind)


def own_files(models: DataFrame, files: DataFrame) -> DataFrame:
    """The files (name) whose names begin with a model's (file); names are cut at
    the model's kind, so the two meet by equal keys."""
    stem = F.regexp_extract("name", r"^(emb\d+-[a-z0-9]+?)(?:[._-].*)?$", 1)
    return models.join(files.withColumn("file", stem).where("file <> ''"), "file")


def summaries(models: DataFrame, full: bool = False) -> DataFrame:
    """what a list of models shows, or all of a model; ``parameters``: a map."""
    name = model_name(F.col("model"), F.col("parameters")).alias("name")
    short = models.select(F.col("embedding_id").alias("id"), name, "description", "model", "status", *(["parameters", F.struct(F.col("corpus_size").alias("size"), "query", "preprocessing").alias("corpus")] if full else []))
    return short


def enumerated(spark) -> DataFrame:
    """P10: models with their parameters and defaults, pre-processing options and kinds
    of tests, as rows of text."""
    rows = [("model", m, k, str(v)) for m, ps in MODELS.items() for k, v in ps.items()]
    rows += [("preprocessing", None, k, str(v)) for k, v in PREPROCESSING.items()] + [("test", None, k, None) for k in TESTS]
    return spark.createDataFrame(rows, "kind string, model string, name string, value string")


def ask_training(asked: DataFrame, models: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests (request_id, embedding_id) with a status code: 404 without such a
    model, 400 if it has a training job or another request came before, else 201."""
    known = models.select("embedding_id", F.lit(True).alias("_known"))
    busy = jobs.select("embedding_id").distinct().withColumn("_busy", F.lit(True))
    first = asked.groupBy("embedding_id").agg(F.min("request_id").alias("_first"))
    rows = asked.join(first, "embedding_id").join(known, "embedding_id", "left").join(busy, "embedding_id", "left")
    code = F.when(F.col("_known").isNull(), 404).when(F.col("_busy").isNotNull() | (F.col("request_id") > F.col("_first")), 400).otherwise(201)
    return rows.select("request_id", "embedding_id", code.alias("code"))


def started(models: DataFrame, answers: DataFrame) -> DataFrame:
    """The models, TRAINING where a job was created."""
    made = answers.where("code = 201").select("embedding_id", F.lit("TRAINING").alias("_new"))
    return models.join(made, "embedding_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def clean_up(gone: DataFrame, models: DataFrame, *tables: DataFrame, key: str = "embedding_id") -> tuple[DataFrame, ...]:
    """After a model's (or test set's) training job or data are deleted: the
    models, those untrained again, and its jobs and results without their rows."""
    gone = gone.select(key).distinct()
    left = tuple(t.join(gone, key, "left_anti") for t in tables)
    reset = models.join(gone.withColumn("_gone", F.lit(True)), key, "left")
    return reset.withColumn("status", F.when(F.col("_gone"), "UNTRAINED").otherwise(F.col("status"))).drop("_gone"), *left


def described(models: DataFrame, changes: DataFrame, key: str = "embedding_id") -> DataFrame:
    """New descriptions; nothing else of a row can change."""
    return models.join(changes.select(key, F.col("description").alias("_d")), key, "left").withColumn("description", F.coalesce("_d", "description")).drop("_d")


def tests_to_run(models: DataFrame, testsets: DataFrame, results: DataFrame, embedding: int | str, testset: int | str) -> DataFrame:
    """The trained pairs of a model and a test set: by ids, or ``full`` or ``missing``
    (without a result) on one side."""
    ids = [x for x in (embedding, testset) if isinstance(x, int)]
    if not ids:
        raise ValueError("at least one id must be given")
    m, s = models.where("status = 'TRAINED'").select("embedding_id"), testsets.select("testset_id")
    m = m.where(F.col("embedding_id") == embedding) if isinstance(embedding, int) else m
    s = s.where(F.col("testset_id") == testset) if isinstance(testset, int) else s
    pairs = m.crossJoin(s)  # one of the sides is one row
    if "missing" in (embedding, testset):
        pairs = pairs.join(results.select("embedding_id", "testset_id").distinct(), ["embedding_id", "testset_id"], "left_anti")
    return pairs


def by_status(models: DataFrame, order: tuple[str, ...] = STATUS_ORDER, then: str = "embedding_id") -> DataFrame:
    """In the order of a list of statuses, unknown ones first."""
    return models.orderBy(F.array_position(F.array(*[F.lit(x) for x in order]), F.col("status")), then)


def by_progress(testsets: DataFrame, jobs: DataFrame) -> DataFrame:
    """Test sets by the progress of their jobs, those without any last, then by name."""
    done = jobs.groupBy("testset_id").agg(F.max("progress").alias("progress"))
    return testsets.join(done, "testset_id", "left").withColumn("progress", F.coalesce("progress", F.lit(-1.0))).orderBy(F.desc("progress"), "name")

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from verbarium.llm import jaccard_join, quality
from verbarium.llm.common import drop, materialize


def test_batches_of_long_rows_are_bounded(spark):
    """10,000 rows of a few kilobytes were one batch in the executor and its worker."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    long = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("word "), 2000).alias("text"))
    rows, path = materialize(long.mapInArrow(sizes, "n bigint, size bigint"))
    got = rows.collect()
    assert sum(r["n"] for r in got) == 4000 and max(r["size"] for r in got) < 12 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) != str(8 << 20)
    drop(spark, path)


def test_gathered_keys_take_little():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, jaccard_join.GATHER, dtype=np.uint64)
    ids = rng.integers(0, 5000, jaccard_join.GATHER)
    tracemalloc.start()
    jaccard_join.by_key(keys, ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20


def test_kept_texts_travel_once(spark):
    """Scores are the same with and without the text among the kept columns; a kept text isn't sent twice."""
    model = quality.Model(np.linspace(-1, 1, 1 << 10).astype(np.float32), 0.1, 10)
    rows = [(i, f"some text {i} " * (i % 7), "en") for i in range(200)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = quality.score(docs, model, keep=("text", "lang"))
    assert kept.columns == ["doc_id", "text", "lang", "score"]
    assert sorted(map(repr, kept.select("doc_id", "text", "lang").collect())) == sorted(map(repr, docs.collect()))
    assert sorted(map(repr, kept.select("doc_id", "score").collect())) == sorted(map(repr, quality.score(docs, model).collect()))
    assert "_text" not in kept._jdf.queryExecution().optimizedPlan().toString()

"""What the queries with SQL don't reach: order, streams of bytes, errors, trainings."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbarium.functions import text as T
from verbarium.operators import catalog, cooccurrence, corpus, embeddings, ingest, querydsl, testgen, wikitext
from verbarium.plans import training
from verbarium.sources import readers, sinks


def test_highlight_marks_whole_words(spark):
    rows = spark.createDataFrame([("áthat That is THAT, thatch",), ("none",), ("x" * 100,), (None,)], "t string")
    got = [r[0] for r in rows.select(T.highlighted(F.col("t"), ["that"])).collect()]
    assert got == ["<em>That</em> is <em>THAT</em>, thatch", "none", "x" * 100 + "...", None]


def test_fold_and_analysis_of_odd_texts(spark):
    texts = ["½ ﬁn ① Ａｂ ế 𝐀", "ß", "la el", "", None, "’quoted’ estuviésemos tendría palabra"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(T.fold(F.col("t")).alias("f"), T.fold_exact(F.col("t")).alias("e"), T.analyzed(F.col("t")).alias("a")).collect()
    assert all(r["f"] == r["e"] for r in got)
    assert [r["a"] for r in got][1:] == [[""], [], [], None, ["quoted", "palabra"]]
    assert querydsl.analyse("La Ñandú estuviésemos ½") == ["nandu", "12"]


def test_search_orders_by_score(spark):
    docs = spark.createDataFrame([(i, t, "s", len(t.split())) for i, t in enumerate(["dog cat", "dog dog", "bird", "dog " + "x " * 50])], "_id int, content string, data_source string, word_count int")
    page = corpus.search(docs, {"match": {"content": "dog"}}).collect()
    assert [r["_id"] for r in page] == [1, 0, 3] and {r["count"] for r in page} == {3} and {r["words"] for r in page} == {55}
    assert [r["rank"] for r in corpus.search(docs, None, offset=1, page=2).collect()] == [2, 3]
    assert querydsl.wanted_words({"bool": {"must": [{"match": {"content": "Dog"}}], "must_not": [{"match": {"content": "cat"}}]}}) == ["dog"]


def test_zip_in_pieces(spark):
    files = spark.createDataFrame([(f"{i}.txt", f"text é {i} " * 50) for i in range(20)], "name string, content string").repartition(3)
    pieces = list(corpus.zipped(files))
    assert len(pieces) > 20
    with zipfile.ZipFile(io.BytesIO(b"".join(pieces))) as archive:
        assert len(archive.namelist()) == 20 and archive.read("7.txt").decode() == "text é 7 " * 50


def test_chunks(spark):
    assert [len(c) for c in ingest.chunks(spark.range(25), 10)] == [10, 10, 5] and list(ingest.chunks(spark.range(0), 10)) == []


def test_orders_of_lists(spark):
    models = spark.createDataFrame([(1, "TRAINED"), (2, "UNTRAINED"), (3, "TRAINING"), (4, "TRAINED")], "embedding_id int, status string")
    assert [r[0] for r in catalog.by_status(models).collect()] == [3, 1, 4, 2]
    sets = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c")], "testset_id int, name string")
    jobs = spark.createDataFrame([(3, 50.0), (3, 100.0), (9, 1.0)], "testset_id int, progress double")
    assert [r["name"] for r in catalog.by_progress(sets, jobs).collect()] == ["c", "a", "b"]
    with pytest.raises(ValueError):
        catalog.tests_to_run(models, sets, jobs, "full", "missing")


def test_ranks_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(catalog, "RANGES", 4)
    rng = np.random.default_rng(3)
    rows = [(int(g), float(v) if v < 9 else None) for g, v in zip(rng.integers(0, 3, 300), rng.integers(0, 11, 300), strict=True)] + [(5, 1.0)] * 40
    table = spark.createDataFrame(rows, "g int, v double")
    for down in (True, False):
        for g, v, rank, ties in catalog.ranks(table, ["g"], "v", down).collect():
            own = [x for h, x in rows if h == g]
            before = sum(x is not None and (v is None or (x > v if down else x < v)) for x in own)
            assert (rank, ties) == (before + 1, sum(x == v for x in own)), (g, v)
    assert catalog.ranks(table, ["g"], "v").count() == 340


def test_counted_pairs(spark):
    rows = spark.createDataFrame([(0, 0, p, i) for p, i in ((1, 5), (3, 5), (4, 7), (9, 5), (10, 2))] + [(0, 1, 1, 7), (1, 0, 1, 7), (1, 0, 2, 7)], "doc_id bigint, sid int, pos int, id int")
    numbered = rows.withColumn("pos", F.expr("row_number() over (partition by doc_id, sid order by pos)"))
    for weighting in ("count", "inverse", "expected"):
        plain = {(r.w, r.c): round(r.x, 9) for r in cooccurrence.cooccurrence(cooccurrence.pairs(numbered, 2), weighting, 2).collect()}
        assert {(r.w, r.c): round(r.x, 9) for r in cooccurrence.counted(rows, 2, weighting).collect()} == plain


def test_vector_queries_over_blocks(spark, monkeypatch):
    """The same neighbours for any blocks; equal vectors tie by word."""
    x = np.random.default_rng(1).normal(size=(60, 5))
    x[40:50] = x[3]
    model = spark.createDataFrame([(f"w{i:02}", (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)], "word string, vec array<double>")
    items = spark.createDataFrame([(i, f"w{i:02}", f"w{i + 1:02}", f"w{i + 2:02}") for i in range(20)], "item int, a string, b string, c string")
    asked = embeddings.signed(items, ["b", "c"], ["a"])
    for method in (embeddings.nearest_add, embeddings.nearest_mul):
        whole = sorted(map(tuple, method(model, asked, 12).drop("score").collect()))
        monkeypatch.setattr(embeddings, "ROWS", 7)
        monkeypatch.setattr(embeddings, "ITEMS", 3)
        assert sorted(map(tuple, method(model, asked, 12).drop("score").collect())) == whole
        monkeypatch.undo()


def test_model_checks(spark, tmp_path):
    good = spark.createDataFrame([("a", 0, [3.0, 4.0]), ("b", 1, [0.0, 0.0])], "word string, idx int, vec array<double>")
    sinks.write_model(good, str(tmp_path / "m"))
    assert {r["word"]: [round(x, 4) for x in r["vec"]] for r in readers.read_model(spark, str(tmp_path / "m")).collect()} == {"a": [0.6, 0.8], "b": [0.0, 0.0]}
    for name, rows in (("twice", [("a", 0, [1.0]), ("a", 1, [2.0])]), ("lengths", [("a", 0, [1.0]), ("b", 1, [1.0, 2.0])])):
        sinks.write_model(spark.createDataFrame(rows, "word string, idx int, vec array<double>"), str(tmp_path / name))
        with pytest.raises(ValueError):
            readers.read_model(spark, str(tmp_path / name))


def test_sessions(spark, tmp_path):
    (tmp_path / "c12.htm").write_bytes("<html><head>x</head><body class=a>Sesi\xf3n <b>uno</b> &amp; dos</body></html>".encode("latin-1"))
    (row,) = readers.read_sessions(spark, str(tmp_path)).collect()
    assert (row["content"], row["kind"]) == ("Sesión uno & dos", "comision")


def test_verb_sets(spark):
    forms = spark.createDataFrame([(f"v{i}", t, f"{t}{i}") for i in range(12) for t in ("inf", "past")], "verb string, tense string, form string")
    rows = testgen.verb_odd(forms, "past", "inf").collect()
    assert len(rows) == 24 and all(len(set(r["rest"])) == 4 and all(w.startswith("inf") for w in r["rest"]) for r in rows)
    assert sorted({r["odd"] for r in rows}) == sorted(f"past{i}" for i in range(12))


def sentences(spark, *texts):
    return cooccurrence.sentence_table(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, content string"))


def test_huffman_codes_are_prefix_free():
    codes = ["".join(str(int(t)) for t in turns) for _, turns in training.huffman(np.array([9.0, 5, 3, 1, 1]))]
    assert all(not b.startswith(a) for a in codes for b in codes if a != b) and len(codes[0]) == min(map(len, codes))
    assert [len(p) for p, _ in training.huffman(np.array([4.0]))] == [0]


@pytest.mark.parametrize("options", [{"algorithm": "cbow", "hsoftmax": True}, {"algorithm": "skipgram", "hsoftmax": True, "subsample": 0.01}])
def test_word2vec_options(spark, options):
    rows = sentences(spark, *["red blue red blue green", "dog cat dog cat bird"] * 20)
    model = training.word2vec(rows, dimension=4, min_count=1, epochs=2, **options).collect()
    assert {r["word"] for r in model} <= {"red", "blue", "green", "dog", "cat", "bird"} and len(model) >= 4
    assert all(abs(sum(x * x for x in r["vec"]) - 1) < 1e-3 for r in model)


@pytest.mark.parametrize("n, k", [(7, 3), (12, 12), (90, 8)])
def test_truncated_svd_is_numpys(spark, n, k):
    rng = np.random.default_rng(n)
    matrix = rng.standard_normal((n, 5)) @ np.diag([9.0, 6, 4, 3, 2]) @ rng.standard_normal((5, n)) + 0.1 * rng.standard_normal((n, n))
    matrix[rng.random((n, n)) < 0.3] = 0
    matrix[n // 2] = 0  # a word without cells
    cells = [(int(w), int(c), float(matrix[w, c])) for w, c in zip(*np.nonzero(matrix), strict=True)]
    u, s, v = training.truncated_svd(spark.createDataFrame(cells, "w int, c int, x double"), n, k, passes=200, tolerance=1e-12)
    want_u, want, want_v = np.linalg.svd(matrix)
    real = int((want[:k] > 1e-9 * want[0]).sum())
    assert np.allclose(s[:real], want[:real], rtol=1e-6) and not s[real:].any()
    near = (want_u[:, :real] * want[:real]) @ want_v[:real]
    assert np.allclose((u * s) @ v.T, near, atol=1e-3 * want[0])
    assert np.allclose(u[:, :real].T @ u[:, :real], np.eye(real), atol=1e-6) and not u[n // 2].any()


def test_truncated_svd_of_nothing(spark):
    none = spark.createDataFrame([], "w int, c int, x double")
    assert not training.truncated_svd(none, 3, 2)[0].any() and training.truncated_svd(none, 0, 0)[1].size == 0
    assert training.svd(sentences(spark, "one two"), min_count=5).count() == 0


def test_svd_puts_words_of_one_company_together(spark):
    rows = sentences(spark, *["red blue red blue green. dog cat bird dog cat", "green blue red. bird cat dog"] * 5)
    vec = {r["word"]: np.array(r["vec"]) for r in training.svd(rows, dimension=3, min_count=1, window=2, subsample=0.0, sum_context=False, power=1.0).collect()}
    assert set(vec) == {"red", "blue", "green", "dog", "cat", "bird"} and vec["dog"] @ vec["cat"] > vec["dog"] @ vec["blue"] + 0.3


def test_vectors_are_summed_by_id(spark):
    """Also where batches part the rows of an id."""
    packed = training._packed
    rows = spark.range(5000).selectExpr("cast(id % 7 as int) as id").repartition(5).mapInArrow(lambda bs: (packed(b.column(0).to_numpy(), np.ones((b.num_rows, 2))) for b in bs), training.PACKED)
    ids, sums = training._summed(rows)
    assert dict(zip(ids.tolist(), sums[:, 1].tolist(), strict=True)) == {i: float(len(range(i, 5000, 7))) for i in range(7)}


def test_progress_is_reported(spark):
    seen = []
    rows = training.reported(spark.range(1000), "pass", 100, lambda *x: seen.append(x))
    assert rows.count() == 1000
    rows.reported()
    assert seen == [("pass", 1000, 10)]


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("a <ul><li>x<ul><li>y</li></ul></li></ul>b", "a b"),
        ("<small>gone</small>kept <abbr title=x>too</abbr>", "kept too"),
        ("<math>x</math> <math>y</math> <math>x</math>", "formula_1 formula_2 formula_1"),
        ("&lt;&lt;q&gt;&gt; ''it'' '''bold''' {{#ifexpr: 1 | a | b}}end", '«q» "it" bold end'),
        ("{| a\n{| b |}\nc |}after", "after"),
    ],
)
def test_wikitext_elements(text, clean):
    assert wikitext.Cleaner().compact(text) == clean


def test_xml_files_hold_a_bounded_number_of_documents(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry

    rows = [(i, f"word{i} & two three", "one") for i in range(2500)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1,)], "r_regionkey long").write.parquet(str(tmp_path / "region.parquet"))
    read, seen = readers.read_xml_texts, []

    def longest(session, path):
        seen.append(session.read.option("recursiveFileLookup", "true").text(path, wholetext=True).selectExpr("max(size(split(value, '</doc>'))) - 1").first()[0])
        return read(session, path)

    monkeypatch.setattr(readers, "read_xml_texts", longest)
    got = entry.queries()["file_xml_texts"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("one", 7500)] and seen[0] <= 500


def test_a_digest_of_all_lines_holds_none_whole(spark):
    import hashlib

    rows = ["b", "", "a", "ñ", "b", "", "z" * 3000] * 400 + [f"line {i}" for i in range(500)]
    lines = spark.createDataFrame([(r,) for r in rows], "value string").repartition(5)
    got = sinks.digested(lines)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    assert tuple(got.first()) == (hashlib.md5("\n".join(sorted(rows, key=str.encode)).encode()).hexdigest(), len(rows))
    assert tuple(sinks.digested(lines.limit(0)).first()) == (None, 0)

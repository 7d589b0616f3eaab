import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verbarium import catalogue
from verbarium.operators import catalog, cooccurrence, corpus, embeddings, evaluate, ingest, testgen, wikitext
from verbarium.plans import training
from verbarium.sources import readers, sinks


@pytest.fixture(scope="module")
def model(spark):
    return spark.createDataFrame([("w0", [1.0, 0.0]), ("w1", [0.8, 0.6]), ("w2", [0.0, 1.0]), ("w3", [-0.6, 0.8])], "word string, vec array<double>")


def pairs(df):
    return [(r["word"], round(r["score"], 6)) for r in df.orderBy("rank").collect()]


def test_neighbours(model):
    assert pairs(embeddings.most_similar(model, ["w1", "w2"], ["w0"])) == [("w3", 0.868243)]
    assert pairs(embeddings.most_similar(model, ["w1", "w2"], ["w0"], method="mul")) == [("w3", 2.248876)]
    assert pairs(embeddings.most_similar(model, "w0")) == [("w1", 0.8), ("w2", 0.0), ("w3", -0.6)]
    assert pairs(embeddings.most_similar(model, ["w0"], method="mul")) == [("w1", 0.89991), ("w2", 0.49995), ("w3", 0.19998)]
    with pytest.raises(embeddings.UnknownWord):
        embeddings.most_similar(model, ["w9"])
    with pytest.raises(ValueError):
        embeddings.most_similar(model, [], ["w1"], method="mul")


def test_odd_one_out(spark, model):
    items = spark.createDataFrame([(0, w) for w in ("w0", "w1", "w3", "zzz")] + [(1, "zzz")], "item int, word string")
    (row,) = embeddings.odd_one_out(model, items).collect()
    assert (row["item"], row["odd"], round(row["score"], 6)) == (0, "w3", 0.216930)


def test_evaluation(spark, model):
    items = spark.createDataFrame([(0, "w0", "w1", "w2", "w3"), (1, "w0", "w1", "w2", "no")], "item int, w1 string, w2 string, w3 string, w4 string")
    row = evaluate.evaluate(model, items, "analogies").first()
    assert row["top1_mul"] == 0.5 and row["missing"] == [1] and row["wrong"] == [] and row["total"] == 2
    empty = evaluate.evaluate(model, items.limit(0), "analogies").first()
    assert empty["accuracy"] == 0.0 and empty["total"] == 0
    sims = spark.createDataFrame([(i, "", "", s, p) for i, (s, p) in enumerate(zip([0.9, 0.5, 0.0, 0.0, 0.7], [9.0, 4.0, 3.0, 1.0, 4.0]))], "item int, w1 string, w2 string, similarity double, score double")
    assert round(evaluate.spearman(sims, "similarity", "score").first()["accuracy"], 6) == 0.947368
    assert evaluate.spearman(sims.withColumn("score", F.lit(1.0)), "similarity", "score").first()["accuracy"] == 0.0
    odd = spark.createDataFrame([(0, "w3", ["w0", "w1"]), (1, "x", ["y"])], "item int, odd string, rest array<string>")
    row = evaluate.evaluate(model, odd, "odd-one-out").first()
    assert row["accuracy"] == 0.5 and row["missing"] == [1]
    with pytest.raises(ValueError):
        evaluate.evaluate(model, odd, "spelling")


def sentence(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    return cooccurrence.sentence_table(docs)


def test_cooccurrence(spark):
    rows = sentence(spark, "a b z a c")
    vocab = cooccurrence.with_ids(cooccurrence.vocabulary(rows).where("word <> 'z'"))
    names = {r["id"]: r["word"] for r in vocab.collect()}
    cells = cooccurrence.cooccurrence(cooccurrence.pairs(cooccurrence.placed(rows, vocab), 2), "inverse")
    got = {(names[r["w"]], names[r["c"]]): r["x"] for r in cells.collect()}
    assert got == {("a", "a"): 1.0, ("a", "b"): 2.0, ("b", "a"): 2.0, ("a", "c"): 1.0, ("c", "a"): 1.0, ("b", "c"): 0.5, ("c", "b"): 0.5}


def test_ppmi(spark):
    rows = [(a, b, x) for a, b, x in (("A", "B", 2.0), ("A", "C", 1.0), ("B", "C", 3.0)) for a, b in ((a, b), (b, a))]
    got = {r["w"] + r["c"]: round(r["x"], 6) for r in cooccurrence.ppmi(spark.createDataFrame(rows, "w string, c string, x double")).collect()}
    assert got == {"AB": 0.521816, "BA": 0.39411, "BC": 0.583814, "CB": 0.639599}


def test_word_ids(spark):
    rows = sentence(spark, "b a b a c ab a1\nd é abc abd aa c b")
    words = [(r["word"], r["count"]) for r in cooccurrence.vocabulary(rows).collect()]
    got = {r["word"]: r["id"] for r in cooccurrence.with_ids(cooccurrence.vocabulary(rows)).collect()}
    assert got == {w: i for i, (w, _) in enumerate(sorted(words, key=lambda x: (-x[1], x[0])), 1)}
    got = {r["word"]: r["id"] for r in cooccurrence.with_ids(cooccurrence.vocabulary(rows), "word").collect()}
    assert got == {w: i for i, (w, _) in enumerate(sorted(words))}


def test_counts_and_models_take_the_whole_corpus(spark, tmp_path):
    """Every language and none, and words beyond the 200 most frequent."""
    texts = [(i, " ".join(f"{lang or 'no'}{j % 60}" for j in range(i, i + 300)), lang) for i, lang in enumerate(("es", "en", "de", "fr", None) * 30)]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    words = {w for _, t, _ in texts for w in t.split()}
    assert len(words) == 300
    assert {r["id"] for r in run("subsample_hash")} == set(range(1, 301))
    counts = Counter(w for _, t, _ in texts for w in t.split())
    ids = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w)), 1)}
    width = {(d, i): 1 + int(hashlib.md5(f"1|{d}|0|{i}".encode()).hexdigest()[:13], 16) % 5 for d, t, _ in texts for i in range(1, len(t.split()) + 1)}
    want = Counter()
    for d, t, _ in texts:
        own = [ids[w] for w in t.split()]
        for i in range(len(own)):
            want.update((own[i], own[j]) for j in range(max(0, i - 5), min(len(own), i + 6)) if j != i and abs(i - j) <= width[d, i + 1])
    assert {(r["w"], r["c"]): r["x"] for r in run("cooc_dynamic")} == want
    assert {r["word"] for r in run("word2vec_vectors")} == {r["word"] for r in run("cbow_vectors")} == words


def test_shuffle_takes_cooccurrence_records(spark, tmp_path):
    spark.createDataFrame([(0, "a b c a"), (1, "d a. b d")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda: [tuple(r) for r in catalogue.QUERIES["shuffle_records"](spark, str(tmp_path)).collect()]
    got, want = run(), Counter()
    for words in (["a", "b", "c", "a"], ["d", "a"], ["b", "d"]):
        for i, j in ((i, j) for i in range(len(words)) for j in range(len(words)) if i != j):
            want[1 + "abdc".index(words[i]), 1 + "abdc".index(words[j])] += 1 / abs(i - j)
    assert {(w, c): x for w, c, x in got} == {k: round(x, 4) for k, x in want.items()} and len(got) == len(want)
    assert got == run() != sorted(got)


def test_shuffled_makes_rows_once(spark):
    """The order is that of the hashes over all partitions, and no row is made twice for it."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 20_000, 1, 3).select((F.col("id") % 5000).alias("w"), F.col("id").cast("double").alias("x"))
    made_rows = rows.mapInArrow(counted, "w bigint, x double")
    got = [tuple(r) for r in cooccurrence.shuffled(made_rows, 7).collect()]
    assert made.value == 20_000 and len(set(got)) == 20_000
    hashed = rows.select("w", "x", F.xxhash64(F.lit(7), "w", "x").alias("h")).collect()
    assert got == [(r["w"], r["x"]) for r in sorted(hashed, key=lambda r: (r["h"], r["w"], r["x"]))]
    assert cooccurrence.shuffled(made_rows.limit(0)).collect() == []


def test_vocabulary_order_and_cap(spark):
    rows = sentence(spark, "b a b a c\nd")
    assert [r["word"] for r in cooccurrence.vocabulary(rows, max_count=2).orderBy(F.desc("count"), "word").collect()] == ["a", "b"]
    assert "d" not in {r["word"] for r in cooccurrence.vocabulary(rows, least_tokens=2).collect()}


def test_training(spark):
    texts = [f"{a} {b} {a} {b}. {c} {d} {c} {d}" for a, b, c, d in [("red", "blue", "dog", "cat")] * 30]
    rows = sentence(spark, *texts)
    costs = []
    model = training.glove(rows, dimension=4, min_count=1, window=3, epochs=15, costs=costs)
    assert model.count() == 4 and costs[-1] < costs[0]
    for kind in (training.svd(rows, dimension=2, min_count=1, window=3, subsample=0.0), training.word2vec(rows, dimension=4, min_count=1, algorithm="cbow", hsoftmax=False, negative=2, epochs=2)):
        assert all(math.isclose(sum(x * x for x in r["vec"]), 1.0, abs_tol=1e-3) for r in kind.collect())
    assert training.arguments("svd", {"cds": 0.5})["smoothing"] == 0.5
    assert training.cache_key({"a": 1}, {"x": True}) != training.cache_key({"a": 1}, {"x": False})


def test_catalogue(spark):
    assert catalog.new_embedding({"model": "svd", "description": "", "parameters": {}, "query": {}, "preprocessing": {}})["parameters"]["cds"] == 0.75
    for bad in ({"model": "svd"}, {"model": "lsa", "description": "", "parameters": {}, "query": {}, "preprocessing": {}}):
        with pytest.raises(ValueError):
            catalog.new_embedding(bad)
    jobs = spark.createDataFrame([(None, 5), (None, None), ("t", None)], "task_id string, elapsed_time int")
    state, progress = catalog.status()
    assert [tuple(r) for r in jobs.select(state, progress).collect()] == [("SUCCESS", 100.0), ("PENDING", 0.0), ("PROGRESS", 0.0)]


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old")], "_id string, at int, v string")
    new = spark.createDataFrame([("a", 1, "new"), ("b", 2, "new"), ("c", 1, "new")], "_id string, at int, v string")
    assert sorted(map(tuple, corpus.upsert(old, new, ["_id"], "at").collect())) == [("a", 1, "new"), ("b", 5, "old"), ("c", 1, "new")]


def test_ingest(spark):
    entries = spark.createDataFrame([("s", "1", "failure", 4), ("s", "2", "failure", 5), ("t", "1", "pending", 0)], "data_source string, source_id string, outcome string, number_of_tries int")
    assert {tuple(r)[:2] for r in ingest.retryable(entries).collect()} == {("s", "1"), ("t", "1")}
    found = spark.createDataFrame([("s", "1"), ("t", "2"), ("t", "2")], "data_source string, source_id string")
    assert [tuple(r)[:2] for r in ingest.new_entries(found, entries).collect()] == [("t", "2")]
    page = "<html><h1>Big &amp; <b>bold</b></h1><div class='ad'><p>buy</p></div><p>One<br>line<p>Two<script>x</script></body>"
    (row,) = ingest.Connector("d", "u", dropped=("div.ad",)).extract(spark.createDataFrame([("http://d/12", page)], "url string, html string")).collect()
    assert (row["title"], row["source_id"]) == ("Big & bold", 12) and row["content"].split("\n")[-2:] == ["Oneline", "Two"]


def test_generators(spark):
    words = spark.createDataFrame([(c, f"{c}{i}") for c in "xyz" for i in range(4)], "category string, word string")
    rows = testgen.odd_from_categories(words).collect()
    assert len(rows) == 12 and all(len(r["rest"]) == 3 and {w[0] for w in r["rest"]} == {r["other"]} != {r["category"]} for r in rows)
    forms = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(8)], "a string, b string")
    assert testgen.analogies(forms, 3).count() == 24


def test_generators_take_every_row(spark, tmp_path):
    rows = [(i, i % 3) for i in range(90)]
    spark.createDataFrame(rows, "vec_id bigint, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    label = {str(i): str(c) for i, c in rows}
    odd = catalogue.QUERIES["gen_odd_one_out"](spark, str(tmp_path)).collect()
    assert {r["odd"] for r in odd} == set(label) and len(odd) == 90
    assert all(len(set(r["rest"])) == 3 and {label[w] for w in r["rest"]} == {r["other"]} != {label[r["odd"]]} for r in odd)
    assert len({r["other"] for r in odd if r["category"] == "0"}) == 2 and len({w for r in odd for w in r["rest"]}) > 60
    got = [tuple(w.removeprefix("x") for w in r) for r in catalogue.QUERIES["gen_analogies"](spark, str(tmp_path)).collect()]
    assert len(got) == len({(a, c) for a, _, c, _ in got}) == 450 and {a for a, *_ in got} == set(label)
    assert all(a == b and c == d and a != c for a, b, c, d in got)


def test_generators_on_few_and_repeated_rows(spark):
    forms = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1"), ("c", None), (None, "9")], "a string, b string")
    pairs = {("a", "1"), ("a", "2"), ("b", "1"), ("c", None)}
    got = [tuple(sorted([tuple(sorted(map(str, r[:2]))), tuple(sorted(map(str, r[2:])))])) for r in testgen.analogies(forms, 9).collect()]
    want = [tuple(sorted([tuple(sorted(map(str, x))), tuple(sorted(map(str, y)))])) for x in pairs for y in pairs if x[0] != y[0]]
    assert sorted(got) == sorted(want)
    words = spark.createDataFrame([("x", "p"), ("y", "q"), ("y", "r"), ("y", "q"), (None, "z")], "category string, word string")
    assert sorted((r["odd"], r["rest"]) for r in testgen.odd_from_categories(words).collect()) == [("p", ["q", "r"]), ("q", ["p"]), ("r", ["p"])]
    assert testgen.odd_from_categories(words.where("category = 'x'")).collect() == testgen.analogies(forms.where("a = 'a'")).collect() == []


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_text(": header\na b c d\nbroken line\n\ne f g h\n")
    assert [tuple(r)[1:] for r in readers.read_analogies(spark, str(tmp_path / "a.txt")).collect()] == [("a", "b", "c", "d"), ("e", "f", "g", "h")]
    assert readers.read_rejects(spark, str(tmp_path / "a.txt"), 4).count() == 1
    (tmp_path / "s.txt").write_text("a\tb\t1.5\nc d 2\n")
    assert [r["score"] for r in readers.read_similarities(spark, str(tmp_path / "s.txt")).collect()] == [1.5, 2.0]
    (tmp_path / "d.xml").write_text('<doc id="1" url="u" title="t">\ntext <ref>x</ref>more\n</doc>\n<doc id="2" url="u" title="v">b</doc>')
    assert [(r["id"], r["content"]) for r in readers.read_pseudo_xml(spark, str(tmp_path / "d.xml")).collect()] == [("1", "text more"), ("2", "b")]
    model = spark.createDataFrame([("w", [1.0, 2.0], [0.5, 0.5])], "word string, vec array<double>, context array<double>")
    sinks.write_vectors(model, str(tmp_path / "v"))
    assert readers.read_vectors(spark, str(tmp_path / "v")).first()["vec"] == [1.5, 2.5]


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("a [[Link|label]]s and [[File:x.jpg|thumb]] end", "a labels and end"),
        ("'''Bold''' [http://x y] {{none}}rest", "Bold rest"),
        ("{{t|1|b=2}}", "1-2-d"),
        ("x {{#if: | a | b}} {{#switch: k | j=1 | k=2}} {{uc:ab}}", "x b 2 AB"),
        ("{{#ifeq: 1 | 1 | yes | no}} {{#expr: 2^3 + 4 mod 3}}", "yes 9"),
        ("open {{brace stays", "open {{brace stays"),
        ("== Empty ==\n* item\n== Full ==\nText &lt;b&gt;", "Full.\nText"),
        ("{| table\n| x\n|}after", "after"),
        ("{{loop}}", ""),
    ],
)
def test_wikitext(text, clean):
    tool = wikitext.Cleaner({"T": "{{{1}}}-{{{b}}}-{{{c|d}}}<noinclude>doc</noinclude>", "Loop": "{{loop}}"})
    assert tool.compact(text) == clean

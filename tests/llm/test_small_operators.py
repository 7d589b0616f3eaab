"""Mixing, url rules, classifiers, decontamination and neighbours on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbarium.llm import additive_ann, decontaminate, mixing, quality, toxicity, url_rules
from verbarium.llm.queries import HOST_RULES


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rows = [(i, "w " * (i % 9), f"s{i % 4 if i % 3 else 0}") for i in range(200)] + [(500, None, None), (501, "a b", None), (502, "", "empty"), (None, "x y z", "s1"), (7, "again", "s1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as size")
    out = mixing.mix(docs.repartition(3)).toPandas()
    assert len(out) == len(rows)
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert sorted(map(str, out.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))
    assert (out["taken"] <= 2 * out["size"]).all() and (out["taken"] >= 0).all()
    per = out.groupby("source", dropna=False).agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"), own=("source_size", "first"))
    assert (per["size"] == per["own"]).all() and (abs(per["taken"] - per["target"]) <= 0.5 + 1e-9).all()
    assert abs(per["target"].sum() - 1.5 * per["size"].sum()) < 1e-6 and (per["target"] <= 2 * per["own"] + 1e-9).all()
    assert mixing.mix(docs.limit(0)).collect() == []
    assert mixing.mix(docs.where("doc_id = 502")).first()["target"] == 0.0


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://a.org", "http://a.org/x", "HTTP://Sub.Example.ORG/es/1?q", "http://example.org/en/12#f", "http://example.org/en/2", "http://notexample.org/es/", "http://xorg/", "https://b.com/fr/x", "https://b.com/de/x", "https://b.com/DE/x", "http://ads.x.net/", "http://x.net/ads/1", "http://x.net/é?a#b", "ftp://h:80/p", "x://y://z/w"]
    pages = spark.createDataFrame([(i, u, i) for i, u in enumerate(urls)], "page_id bigint, url string, host int")
    rules = (*(url_rules.host_rule(a, r) for a, r in HOST_RULES), *url_rules.OWN_RULES)
    got = {r["page_id"]: r for r in url_rules.judge(pages, rules).collect()}
    ends = [(r["rule"], r["verdict"]) for _, r in sorted(got.items())]
    assert ends[:5] == [(None, "allow")] * 4 + [("org/", "allow")]
    assert ends[5:10] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("org/", "allow"), (None, "allow")]
    assert ends[10:16] == [("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"), (None, "block"), (None, "block"), (None, "allow")]
    assert (got[5]["host"], got[5]["path"], got[2]["host"], got[16]["host"]) == ("sub.example.org", "/es/1", "", "h:80")
    assert url_rules.judge(pages.limit(0), rules).collect() == []


def test_rules_run_only_where_their_token_is(spark):
    """With and without the index, verdicts are the same."""
    bare = tuple(url_rules.Rule(r.name, r.pattern, (), r.action, r.rank) for r in url_rules.OWN_RULES)
    rng = random.Random(3)
    parts = ["ads", "track", "x", "img.png", "casino", "CART", "a-b"]
    pages = spark.createDataFrame([(i, "http://h.com/" + "/".join(rng.choices(parts, k=3))) for i in range(200)], "page_id bigint, url string")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(url_rules.judge(pages, url_rules.OWN_RULES)) == key(url_rules.judge(pages, bare))


def corpus(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
    rows = []
    for i in range(400):
        words = [word() for _ in range(60)]
        kind = i % 4
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        if kind == 2:
            words[::20] = [rng.choice(["stupid", "trash", "moron"]) for _ in words[::20]]
        rows.append((i, " ".join(words), int(kind != 1), int(kind == 2)))
    rows += [(1000, None, None, None), (1001, "", 1, 0), (1002, "x" * 200_000, None, None), (1003, "word " * 50_000, 1, 0), (5, rows[5][1], 0, 0)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, quality int, toxic int")
    return table.select("doc_id", "text", F.lit("x").alias("score"), F.lit(1).alias("row")), table.select("doc_id", "quality", "toxic")


def test_quality(spark):
    docs, labels = corpus(spark)
    out = quality.assess(docs, labels, settings=quality.Settings(bits=14)).join(labels.groupBy("doc_id").agg(F.min("quality").alias("y")), "doc_id").toPandas()
    assert len(out) == 405 and out["score"].between(0, 1).all()
    held = out[out["held_out"] & out["y"].notna()]
    assert ((held["score"] >= 0.5) == (held["y"] == 1)).mean() > 0.95
    assert set(quality.assess(docs, labels.limit(0)).toPandas()["score"]) == {0.5}
    assert quality.assess(docs.limit(0), labels).collect() == []


def test_toxicity(spark):
    docs, labels = corpus(spark)
    out = toxicity.assess(docs, labels, toxicity.Settings(bits=16)).join(labels.groupBy("doc_id").agg(F.min("toxic").alias("y")), "doc_id").toPandas()
    held = out[out["held_out"] & out["y"].notna()]
    assert (held["toxic"] == held["y"]).mean() > 0.95
    assert held[held["y"] == 1]["severity"].min() > held[held["y"] == 0]["severity"].max() - 0.5
    model = toxicity.fit(docs, labels, settings=toxicity.Settings(bits=16))
    assert (np.diff(model.thresholds) >= 0).all()
    assert len(toxicity.assess(docs, labels.limit(0)).collect()) == 405


def distance(pattern, text):
    """Smallest edit distance of the pattern to any stretch of the text, by the table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(1)
    for _ in range(300):
        p, t = ([rng.randrange(4) for _ in range(rng.randrange(1, n))] for n in (12, 30))
        assert decontaminate.myers(p, t) == distance(p, t)


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 3, 12, 25, 40])))) for i in range(12)] + [(50, None), (51, ""), (52, "!!")]
    docs = []
    for i in range(150):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 60))]
        if i % 2:
            item = rng.choice(items[:12])[1].split()
            for _ in range(rng.randrange(0, 8)):
                at = rng.randrange(len(item) + 1)
                item[at : at + rng.randrange(2)] = [f"w{rng.randrange(60)}"] * rng.randrange(2)
            words[len(words) // 2 : len(words) // 2] = item
        docs.append((i, ", ".join(words).title()))
    docs += [(900, None), (901, ""), (3, docs[3][1])]
    out = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("n_items", F.lit(1)), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {r["doc_id"]: (r["item_ids"], r["min_distance"]) for r in out.collect()}
    for doc, text in docs:
        words = (text or "").lower().replace(",", "").split()
        near = {i: distance(t.split(), words) for i, t in items[:12]}
        hits = {i: d for i, d in near.items() if d <= len(dict(items)[i].split()) * 15 // 100}
        assert got[doc] == (sorted(hits), min(hits.values(), default=None)), doc
    assert out.count() == len(docs)


def test_decontamination_in_slices(spark, monkeypatch):
    """A benchmark of several slices gives the rows of one slice, repeated ones too."""
    rng = random.Random(5)
    items = [(i if i % 7 else None, " ".join(f"w{rng.randrange(80)}" for _ in range(14))) for i in range(30)] + [(3, "once more"), (9, None)]
    docs = [(i, " ".join(["start", items[i % 31][1], "middle", items[i * 7 % 31][1]][: i % 4 + 1]), "s") for i in range(60)]
    docs += [docs[2], docs[3], docs[3], (None, docs[3][1], "s"), (None, docs[3][1], "s"), (99, None, None)]
    run = lambda: sorted(map(str, decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(items, "item_id bigint, text string"), keep=("text", "source")).collect()))
    whole = run()
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", 40)
    assert run() == whole and len(whole) == len(docs) and any("None, " in r for r in whole)


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_neighbours(spark, metric):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, x[7].tolist()) for i in range(60)]
    bad = [(3000, None), (3020, [0.0] * 16), (3040, [1.0]), (3060, [float("nan")] * 16), (3080, [None] * 16), (None, x[0].tolist()), (40, x[40].tolist())]
    table = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(1))
    settings = additive_ann.Settings(books=8, words=32, sample=600, rerank=120)
    out = additive_ann.nearest(table, F.col("vec_id") % 20 == 0, 10, metric=metric, settings=settings).toPandas()
    ids, data = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        v = data[ids == q][0]
        s = data @ v if metric == "ip" else -((data - v) ** 2).sum(axis=1)
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:10]]
        mine = out[out["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        hit, total = hit + len(set(best) & set(mine["vec_id"])), total + 10
    assert hit / total >= 0.9
    assert set(out["query_id"]) == set(ids[ids % 20 == 0])
    assert additive_ann.nearest(table.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_recall_with_many_blocks(spark, monkeypatch):
    """Ten blocks of codes, far fewer candidates a block than rows: recall is that of a block."""
    monkeypatch.setattr(additive_ann, "BLOCK", 150)
    monkeypatch.setattr(additive_ann, "GROUP", 30)
    monkeypatch.setattr(additive_ann, "CELL", 300)
    x = np.random.default_rng(6).normal(size=(2000, 16)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    settings = additive_ann.Settings(books=4, words=16, sample=600, rerank=50)
    out = additive_ann.nearest(table, F.col("vec_id") % 20 == 0, 10, settings=settings).toPandas()
    hit = 0
    for q in range(0, 2000, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:10]) & set(out[out["query_id"] == q]["vec_id"]))
    assert hit / 1000 >= 0.95


def test_packed_features():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 3000):
        ids = np.sort(rng.choice(1 << 18, n, replace=False))
        counts = rng.integers(1, 70_000, n)
        got = quality.unpack(quality.pack(ids.astype(np.int32), counts.astype(np.int32)))
        assert np.array_equal(got[0], ids) and np.array_equal(got[1], counts)


def test_toxicity_learns_the_grades_of_labels(spark):
    """With labels of several grades, severity follows them on rows not learned from."""
    rng = random.Random(4)
    rows = []
    for i in range(600):
        grade = i % 4
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(30)]
        words[:: 30 // grade if grade else 31] = ["fool", "idiot", "scum"][:grade] + ["fool"] * (len(words[:: 30 // grade]) - grade) if grade else words[::31]
        rows.append((i, " ".join(words), grade))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, grade int")
    model = toxicity.fit(table, table.select("doc_id", F.col("grade").alias("toxic")).where(~quality.held_out()), settings=toxicity.Settings(bits=16), values=(0, 1, 2, 3))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) >= 0).all()
    out = toxicity.score(table, model).join(table.select("doc_id", F.col("grade").alias("y")), "doc_id").where(quality.held_out()).toPandas()
    means = out.groupby("y")["severity"].mean()
    assert means.is_monotonic_increasing and (out["grade"] == out["y"]).mean() > 0.8


def test_classifiers_on_empty_tables(spark):
    docs, labels = corpus(spark)
    assert toxicity.assess(docs.limit(0), labels).collect() == []
    assert len(quality.assess(docs, labels.limit(0)).collect()) == 405


def test_neighbours_in_double_precision(spark, monkeypatch):
    """Scores that single precision can't tell apart, components beyond its range, and
    the exact way over several blocks."""
    monkeypatch.setattr(additive_ann, "BLOCK", 40)
    monkeypatch.setattr(additive_ann, "CELL", 64)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 8)), 3)
    x[58], x[59] = x[20] * 10, x[20] * 10 * (1 + 1e-12)
    for scale in (1.0, 1e200, 1e-200):
        table = spark.createDataFrame([(i, (v * np.sqrt(scale)).tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
        for exact in (False, True):
            settings = additive_ann.Settings(books=4, words=16, sample=300, rerank=40, recall=1.0, exact=exact)
            out = additive_ann.nearest(table, F.col("vec_id") % 20 == 0, 5, settings=settings).toPandas().sort_values(["query_id", "rank"])
            for q in range(0, 300, 20):
                s = (x * x[q]).sum(axis=1)
                s[q] = -np.inf
                want = np.lexsort((np.arange(300), -s))[:5].tolist()
                mine = out[out["query_id"] == q]
                assert mine["vec_id"].tolist() == want, (scale, exact, q)
                assert np.allclose(mine["score"], s[want] * scale, rtol=1e-9)


def test_hot_vector_goes_to_several_tasks(spark, monkeypatch):
    """A third of all rows has one vector: its smallest ids come first, whatever the blocks."""
    monkeypatch.setattr(additive_ann, "BLOCK", 50)
    monkeypatch.setattr(additive_ann, "GROUP", 5)
    monkeypatch.setattr(additive_ann, "CELL", 100)
    x = np.random.default_rng(6).normal(size=(600, 8))
    x[::3] = x[0] * 3
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    out = additive_ann.nearest(table, F.col("vec_id") % 60 == 0, 4, settings=additive_ann.Settings(books=4, words=16)).toPandas()
    assert out[out["query_id"] == 0].sort_values("rank")["vec_id"].tolist() == [3, 6, 9, 12]
    assert out[out["query_id"] == 60].sort_values("rank")["vec_id"].tolist() == [0, 3, 6, 9]


def test_literal_tokens():
    of = url_rules.literal_tokens
    assert of(r"(?:\A|\.)example\.org\n/es/") == ("example", "org", "es")
    assert of(r"(?:\A|\.)example\.org\n/en/1") == ("example", "org", "en")
    assert of(r"\n[^?#]*/ads(?:/|\Z)") == ("ads",) and of(r"\.jpg\Z") == ("jpg",)
    assert of(r"/(?:a|b)/") == of(r"a|b") == of(r"(?i)/ads/") == of(r"(?<=x)/ads/") == of("ads") == of("/ads.") == ()
    assert of("/ads?/") == of("/ad+s/") == of("/ads/?x") == of("/ad[s]/") == ()
    assert of(r"/x/ads\b") == ("x", "ads") and of(r"/(ads/[0-9]+)/y/") == ("ads", "y") and of("/ADS/") == ("ads",)
    assert of(r"\bads\.x{2}/y-") == ("ads", "y") and of(r"-ads-{1,2}b/") == ("ads", "b")


def test_derived_tokens_lose_no_match(spark, monkeypatch):
    """Random expressions over random urls, in slices: as if every rule ran everywhere."""
    monkeypatch.setattr(url_rules, "SLICE_RULES", 7)
    rng = random.Random(9)
    bits = ["ads", "x", "/", "\\.", "a?", "[ab]", "[/.]", "(?:/|\\Z)", "(?:ads|x)", "b+", "/+", "\\d", "\\b", ".", "A"]
    rules = [url_rules.pattern_rule(rng.choice(["allow", "block"]), "".join(rng.choices(bits, k=rng.randrange(1, 5))), f"r{i:03}") for i in range(60)]
    assert any(r.tokens for r in rules)
    parts = ["ads", "x", "a", "b", "xx", "A", "1", "é", "adsx", "ADS", "\u212a"]
    pages = spark.createDataFrame([(i, "http://h.com/" + "".join(rng.choice(parts) + rng.choice("/.-") for _ in range(4))) for i in range(150)], "page_id bigint, url string")
    bare = [url_rules.Rule(r.name, r.pattern, (), r.action, r.rank) for r in rules]
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(url_rules.judge(pages, rules)) == key(url_rules.judge(pages, bare))
    assert {r["verdict"] for r in url_rules.judge(pages, [], default="keep").collect()} == {"keep"}


def test_rule_file(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("# rules\n\nallow org/\nblock  example.org/es/\nblock /\\.exe\\Z/\n")
    rules = list(url_rules.read_rules(spark, str(tmp_path / "rules.txt")))
    assert [(r.action, r.name) for r in rules] == [("allow", "org/"), ("block", "example.org/es/"), ("block", "/\\.exe\\Z/")]
    pages = spark.createDataFrame([(1, "http://example.org/es/a"), (2, "http://x.com/a.exe")], "page_id bigint, url string")
    assert {r["page_id"]: r["rule"] for r in url_rules.judge(pages, rules).collect()} == {1: "example.org/es/", 2: "/\\.exe\\Z/"}
    (tmp_path / "bad.txt").write_text("maybe org/\n")
    with pytest.raises(ValueError):
        list(url_rules.read_rules(spark, str(tmp_path / "bad.txt")))


def test_decontamination_by_kind_of_id_and_punctuation(spark):
    items = [("a", "one two three\u2019s four\u00a0five six"), (None, "\u201cseven\u201d eight nine ten")]
    docs = [(1, "x one two three's four five six y"), (2, "x one two three\u2019s four five six y"), (3, "seven\u2014eight nine ten"), (4, "clean"), (5, "one " * 30_000)]
    table, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.leaks(table, bench).collect()}
    assert got == {1: ["a"], 2: ["a"], 3: [None], 4: [], 5: []}
    assert [r["n_items"] for r in decontaminate.leaks(table, bench.limit(0)).collect()] == [0] * 5
    assert decontaminate.leaks(table.limit(0), bench).collect() == []


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("shape", ["one 1e6", "one 1e25", "mixed"])
def test_lengths_cost_no_recall(spark, monkeypatch, metric, shape):
    """One very long vector, and lengths over twelve powers of ten, in one cell and many."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if shape == "mixed":
        x *= (10.0 ** rng.uniform(-6, 6, size=1500))[:, None]
    else:
        x[77] = 0
        x[77, 0] = float(shape[4:])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    for cell in (4096, 100):
        monkeypatch.setattr(additive_ann, "CELL", cell)
        out = additive_ann.nearest(table, F.col("vec_id") % 20 == 0, 20, metric=metric, settings=additive_ann.Settings(books=8, sample=700)).toPandas()
        hits = 0
        for q in range(0, 1500, 20):
            s = x @ x[q] if metric == "ip" else -((x - x[q]) ** 2).sum(axis=1)
            s[q] = -np.inf
            want = set(np.lexsort((np.arange(1500), -s))[:20].tolist())
            hits += len(want & set(out[out["query_id"] == q]["vec_id"]))
        assert hits / (75 * 20) >= 0.9, (cell, hits)


def test_rules_of_odd_expressions(spark):
    of = url_rules.literal_tokens
    assert of("/a{b/x/") == ("a", "b", "x") and of("/ads{}/") == ("ads",)
    assert of(r"/ads\.{00,1}x/") == () and of(r"/ads\.{1,}x/") == ("ads", "x") and of("/x/ads{,2}/") == ("x",)
    pages = spark.createDataFrame([(1, "http://h.com/a{b/x/"), (2, "http://h.com/y")], "page_id bigint, url string")
    assert {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, [url_rules.pattern_rule("block", "/a{b/x/")]).collect()} == {1: "block", 2: "allow"}


def test_mixing_of_many_sources(spark, monkeypatch):
    """Beyond the broadcast's bound sources are joined by salts, with equal rows."""
    docs = spark.createDataFrame([(i, "w " * (i % 7), f"s{i % 11 if i % 3 else 0}" if i % 13 else None) for i in range(300)], "doc_id bigint, text string, source string")
    few = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert sorted(map(str, mixing.mix(docs).collect())) == few


def test_ids_of_other_kinds_raise_or_work(spark):
    from verbarium.llm import jaccard_join, pii, recompression, token_store, warc

    docs = spark.createDataFrame([("a", "one two three", "http://h.org/")], "doc_id string, text string, url string")
    for work in (
        lambda: jaccard_join.similar(docs),
        lambda: recompression.dedup(docs),
        lambda: token_store.write_tokens(docs, "/tmp/unused", "unused"),
        lambda: warc.archived(docs.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html")),
        lambda: additive_ann.nearest(docs.withColumnRenamed("doc_id", "vec_id"), F.lit(True)),
    ):
        with pytest.raises(TypeError):
            work()
    assert mixing.mix(docs.withColumn("source", F.lit("s"))).first()["doc_id"] == "a"
    assert pii.digest(pii.find(docs, pii.learn([]))).first()["doc_id"] == "a"


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_ann_on_rows_that_codes_tell_little_of(spark, metric):
    """Many independent components, and a rare kind of rows that no codebook knows."""
    rng = np.random.default_rng(6)
    x = np.hstack((rng.standard_normal((1500, 96)), np.zeros((1500, 32))))
    x[:40] = 0
    x[:40, 96:] = rng.standard_normal((40, 32))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    settings = additive_ann.Settings(books=4, words=16, sample=600, rerank=20)
    out = additive_ann.nearest(table, F.col("vec_id") % 20 == 0, 10, metric=metric, settings=settings).toPandas()
    found = out.groupby("query_id")["vec_id"].agg(set)
    right = []
    for q in range(0, 1500, 20):
        near = x @ x[q] if metric == "ip" else -((x - x[q]) ** 2).sum(axis=1)
        near[q] = -np.inf
        right.append(len(found[q] & set(np.argsort(-near)[:10].tolist())) / 10)
    assert np.mean(right) > 0.97 and min(right) > 0.5

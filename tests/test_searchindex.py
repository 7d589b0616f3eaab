"""The stored index against searches that scan."""

import random

import pytest

from verbarium.operators import corpus, querydsl, searchindex


def rows_of(docs, query, **page):
    return [tuple(r) for r in corpus.search(docs, query, **page).collect()]


def corpus_of(seed, n=900):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ñandú", "la", "DOG", "½"]
    rows = []
    for i in range(n):
        own = rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.choice([0, 1, 3, 10, 40]))
        if i % 97 == 0:
            own = ["dog"] * 6 + own
        rows.append((f"d{i:04}", " ".join(own) if i % 50 else None, f"s{i % 3}", len(own)))
    return rows


SCHEMA = "_id string, content string, data_source string, word_count bigint"
QUERIES = (
    {"match": {"content": "dog"}},
    {"match": {"content": "w0 w7 nandu dog"}},
    {"match": {"content": {"query": "w0 w1 w2", "operator": "and"}}},
    {"filtered": {"filter": {"terms": {"data_source": ["s0", "s2"]}}, "query": {"match": {"content": "w3 W5"}}}},
    '{"query": {"match": {"content": "12 never"}}}',
)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(searchindex, "BLOCK", 16)
    monkeypatch.setattr(searchindex, "FIRST", 3)


@pytest.mark.parametrize("listed", [2000, 0])
def test_pages_equal_scans(spark, tmp_path, small_blocks, monkeypatch, listed):
    monkeypatch.setattr(searchindex, "MOST_LISTED", listed)
    docs = spark.createDataFrame(corpus_of(1), SCHEMA).repartition(3, "_id")
    searchindex.write_segment(docs, str(tmp_path / "i"), "all")
    index = searchindex.SearchIndex(spark, str(tmp_path / "i"))
    for query in QUERIES:
        for offset, page in ((0, 10), (15, 5)) if listed else ((7, 30),):
            got = [tuple(r) for r in searchindex.search(index, docs, query, offset, page).collect()]
            assert got == rows_of(docs, query, offset=offset, page=page), (query, offset)


def test_segments_add_up(spark, tmp_path, small_blocks):
    rows = corpus_of(2, 300)
    docs = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "i")
    for source in ("s0", "s1", "s2"):
        searchindex.write_segment(docs.where(f"data_source = '{source}'"), path, source)
    searchindex.write_segment(docs.where("data_source = 's1'"), path, "s1")  # again: nothing twice
    for query in QUERIES:
        assert [tuple(r) for r in searchindex.search(searchindex.SearchIndex(spark, path), docs, query).collect()] == rows_of(docs, query)
    searchindex.drop_segment(spark, path, "s0")
    rest = docs.where("data_source <> 's0'")
    assert [tuple(r) for r in searchindex.search(searchindex.SearchIndex(spark, path), rest, QUERIES[1]).collect()] == rows_of(rest, QUERIES[1])


def test_nothing_found_and_nothing_indexed(spark, tmp_path, small_blocks):
    docs = spark.createDataFrame([("a", "dog", "s", 1), ("b", None, "s", 0), ("c", "", "s", 0)], SCHEMA)
    searchindex.write_segment(docs, str(tmp_path / "i"), "x")
    index = searchindex.SearchIndex(spark, str(tmp_path / "i"))
    assert index.page({"match": {"content": "cat la"}}).collect() == [] and index.scores({"match": {"content": "la"}}).collect() == []
    assert index.page({"match": {"content": {"query": "dog cat", "operator": "and"}}}).collect() == []
    assert index.docs.count() == 3 and index.totals({"match": {"content": "cat"}}).first()["count"] == 0
    searchindex.write_segment(docs.limit(0), str(tmp_path / "e"), "x")
    assert searchindex.SearchIndex(spark, str(tmp_path / "e")).page({"match": {"content": "dog"}}).collect() == []
    for query in ({"match_all": {}}, {"match": {"title": "x"}}, {"filtered": {"filter": {"range": {"ts": {"gt": 1}}}, "query": {"match": {"content": "x"}}}}):
        with pytest.raises(querydsl.BadQuery):
            index.page(query)


def test_a_page_scores_few_blocks(spark, tmp_path, monkeypatch):
    """Of a frequent word's blocks only those with high peaks are scored, and the files'
    statistics see which terms and blocks are wanted."""
    monkeypatch.setattr(searchindex, "BLOCK", 64)
    rng = random.Random(3)
    filler = [f"x{i}" for i in range(4000)]
    rows = [(f"d{i:05}", " ".join(["common"] * (9 if i % 700 == 5 else 1) + rng.choices(filler, k=60)), "s", 61) for i in range(6000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4, "_id")
    searchindex.write_segment(docs, str(tmp_path / "i"), "all")
    index = searchindex.SearchIndex(spark, str(tmp_path / "i"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    scored = []
    real = searchindex._among
    monkeypatch.setattr(searchindex, "_among", lambda rows, blocks: scored.append(len(blocks)) or real(rows, blocks))
    page = index.page({"match": {"content": "common"}}, page=8)
    assert [r["key"] for r in page.collect()] == [r["_id"] for r in corpus.search(docs, {"match": {"content": "common"}}, page=8).collect()]
    assert max(scored) <= 20 < index.docs.select("block").distinct().count()
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,common)" in plan and "In(block" in plan


def test_building_holds_a_bounded_block(spark, tmp_path, monkeypatch):
    """A task is handed few rows at a time, and the session's own setting comes back."""
    real = searchindex._blocks

    def blocks(batches):
        def counted():
            for batch in batches:
                assert batch.num_rows <= 7
                yield batch

        return real(counted())

    monkeypatch.setattr(searchindex, "_blocks", blocks)
    monkeypatch.setattr(searchindex, "HANDED", 7)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame(corpus_of(4, 200), SCHEMA).repartition(2, "_id")
    searchindex.write_segment(docs, str(tmp_path / "i"), "all")
    assert spark.conf.get(name) == before and searchindex.BLOCK_TOKENS <= 1 << 19
    query = {"match": {"content": "w0 w7 nandu dog"}}
    index = searchindex.SearchIndex(spark, str(tmp_path / "i"))
    got, want = searchindex.search(index, docs, query).collect(), rows_of(docs, query)
    assert [(r[0], r[1], round(r[3], 6)) for r in got] == [(r[0], r[1], round(r[3], 6)) for r in want]

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbarium.functions import dates as D
from verbarium.functions import text as T
from verbarium.operators import querydsl


def one(spark, column, value="", kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_document_id(spark):
    assert one(spark, lambda c: T.document_id(F.lit("d"), c), "1") == "5a94cbefb7a132e9d18ce2fe3fc092"


def test_fold(spark):
    assert one(spark, T.fold_exact, "Ñandú ½ ß æ café") == "Nandu 12   cafe"
    assert one(spark, T.fold, "Ñandú ß æ café") == "Nandu   cafe"


def test_folds_agree_on_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert docs.where(T.fold(F.col("text")) != T.fold_exact(F.col("text"))).count() == 0


def test_sentences_and_tokens(spark):
    text = "Hola mundo. Año_1 nuevo\n\nFin."
    assert one(spark, T.sentences, text) == ["Hola mundo", "Año_1 nuevo", "", "Fin."]
    assert one(spark, lambda c: F.transform(T.sentences(c), T.tokens), text) == [["Hola", "mundo"], ["Año_1", "nuevo"], [], ["Fin"]]


@pytest.mark.parametrize(("text", "words"), [("a b  c\n", 3), ("", 0), (None, 0), ("  ", 0)])
def test_word_count(spark, text, words):
    assert one(spark, T.word_count, text) == words


def test_snippets(spark):
    assert one(spark, T.snippet, "x" * 100) == "x" * 100 + "..."
    assert one(spark, T.snippet, "x" * 99) == "x" * 99
    assert "needle" in one(spark, lambda c: T.snippet(c, F.lit("Needle")), "y " * 200 + "needle" + " z" * 200)


def test_small_functions(spark):
    assert one(spark, T.title_line, "\n\n  First line\nsecond") == "First line"
    assert one(spark, T.basename, "a/2004/name.xml.gz") == "name" and one(spark, T.path_year, "a/2004/name.xml") == "2004"
    assert one(spark, T.clean_srt, "1\r\n00:00:01 --> 00:00:02\r\n- Hola-\r\n\r\n2\r\nmundo") == " Hola mundo"
    assert one(spark, T.story_chapter, "http://f/s/12/3/x") == "12@@3" and one(spark, T.story_chapter, "http://f/s/12") is None
    assert one(spark, lambda c: T.fill_url("http://a/{}/{}", c, F.lit(2)), "1") == "http://a/1/2"
    assert one(spark, T.drop_refs, "a<REF>b</ref>c<ref>d</ref>e") == "ae"
    assert one(spark, T.ucfirst, "éa") == "Éa" and one(spark, T.unescape, "&amp;&#65;&#x42;&ntilde;") == "&ABñ"
    assert one(spark, T.percentage, 0.256, "double") == "26%" and one(spark, T.duration, 3725, "bigint") == "1h 2m 5s"


@pytest.mark.parametrize(
    ("text", "expected"),
    [("12 de marzo de 2014", "2014-03-12 00:00:00"), ("03/04/2015 10:20", "2015-04-03 10:20:00"), ("5 May 2013", "2013-05-05 00:00:00"), ("2014-05-06T07:08:09", "2014-05-06 07:08:09"), ("Lunes 7 de enero de 2013", "2013-01-07 00:00:00"), ("nothing", None), ("", None), (None, None)],
)
def test_fuzzy_dates(spark, text, expected):
    got = one(spark, D.parse_fuzzy, text)
    assert (str(got) if got else None) == expected


@settings(max_examples=20, deadline=None)
@given(st.text(max_size=40))
def test_tokens_hold_no_separators(spark, text):
    text = text.replace("\x00", "")
    for word in one(spark, T.tokens, text):
        assert word and all(c == "_" or c.isalnum() or not c.isascii() for c in word)


def test_query_language(spark):
    docs = spark.createDataFrame([(1, "La niña y el perro", ["es"], 5), (2, "the dog", ["en"], 2)], "id int, content string, tags array<string>, n int")
    ids = lambda q: [r["id"] for r in docs.where(querydsl.predicate(q)).orderBy("id").collect()]
    assert ids(None) == ids("") == ids({"match_all": {}}) == [1, 2]
    assert ids({"match": {"content": "NINA gato"}}) == [1] and ids({"match": {"content": "el la"}}) == []
    assert ids({"term": {"tags": "en"}}) == [2] and ids({"terms": {"n": [5, 7]}}) == [1]
    assert ids('{"range": {"n": {"gte": 2, "lt": 5}}}') == [2]
    assert ids({"bool": {"must_not": {"term": {"n": 2}}}}) == [1]
    assert ids({"bool": {"should": [{"term": {"n": 2}}, {"term": {"n": 5}}]}}) == [1, 2]
    for bad in ({"fuzzy": {}}, "{", {"range": {"n": {"near": 1}}}, {"match": {}}):
        with pytest.raises(querydsl.BadQuery):
            querydsl.predicate(bad)


def test_references_without_a_semicolon_stay(spark):
    from verbarium.operators import ingest

    page = "<h1>a&amp;&amp &lt; &#65; &#66 &ampx; &nosuch; b & c&amp</h1>"
    got = spark.createDataFrame([(page,)], "html string").select(ingest.select_text(F.col("html"), ["h1"])[0][0]).first()[0]
    assert got == "a&&amp < A &#66 &ampx; &nosuch; b & c&amp"


def test_connector_titles_as_their_sql_has_them(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    titles = ["a&amp;&amp", "token = &quot;1&quot;", "x &lt;y&gt; &eacute; &#65; &nbsp;z", "&ampx; & \"q\""]
    rows = [(i, f"https://example.{d}/{i}", f"<title>{s}</title><h1>{s}</h1><p>text</p>") for d in ("org", "net", "com") for i, s in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()["connector_titles"]).fetchall()
    assert sorted(map(tuple, entry.queries()["connector_titles"](spark, str(tmp_path)).collect())) == sorted(want)

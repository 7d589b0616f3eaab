import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from verbarium.llm import recompression
from verbarium.llm.common import words_of


def place(doc, text):
    """Where a document stands: by id, null last, then by the key of its words."""
    (words,) = words_of(pa.array([text], pa.large_string()))
    key = np.frombuffer(recompression._signature(words.keys), dtype=np.uint64)[0] if len(words.keys) else 0
    return doc is None, doc or 0, int(key)


def brute(rows, size):
    docs = sorted({(*place(d, t or ""), tuple((t or "").encode().split())) for d, t in rows})
    seen, gone = set(), {}
    for *_, w in docs:
        cover = [False] * len(w)
        for i in range(len(w) - size + 1):
            if w[i : i + size] in seen:
                cover[i : i + size] = [True] * size
            seen.add(w[i : i + size])
        gone[(*_, w)] = cover
    out = []
    for d, t in rows:
        w = tuple((t or "").encode().split())
        cover = gone[(*place(d, t or ""), w)]
        kept = b" ".join(x for x, g in zip(w, cover, strict=True) if not g)
        out.append((d, len(w), sum(cover), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts(seed, n, vocabulary):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randrange(1, 3) if vocabulary < 20 else f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.randrange(5, 60))] for _ in range(6)]
    out = []
    for _ in range(n):
        t = []
        for _ in range(rng.randrange(0, 6)):
            t += rng.choice(passages)[rng.randrange(3) :] if rng.random() < 0.5 else [word() for _ in range(rng.randrange(0, 50))]
            if rng.random() < 0.1:
                t += [word()] * rng.randrange(1, 60)
        out.append(rng.choice([" ", "\n", " \t"]).join(t))
    return out + rng.sample(out, n // 5)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as sig", "'x' as keys", "2 as id")
    return sorted((tuple(r) for r in recompression.dedup(docs.repartition(3), **options).collect()), key=repr)


@pytest.mark.parametrize(("vocabulary", "size"), [(1000, 20), (10, 20), (10, 6)])
def test_against_all_windows(spark, vocabulary, size, monkeypatch):
    monkeypatch.setattr(recompression, "GATHER", 3000)
    rows = list(enumerate(texts(vocabulary + size, 120, vocabulary)))
    random.Random(1).shuffle(rows)
    rows += [(1000, None), (1001, ""), (1002, "x " * 500), (1003, "x " * 19), (1004, "x " * 19), (None, "x " * 500), rows[0], rows[1]]
    # one id with several texts, and no id with repeats inside, of others and of its own kind
    long = next(t for _, t in rows if t and len(t.split()) > 2 * size)
    rows += [(2000, long), (2000, long + " tail"), (2001, long), (2000, long.replace(" ", "\t")), (None, long + " end"), (None, "y z " * 40), (None, "y z " * 40), (None, None)]
    assert run(spark, rows, size=size) == brute(rows, size)


def test_empty(spark):
    assert run(spark, []) == []


def test_equal_windows_have_equal_keys():
    """Also with other words around them."""
    rng = random.Random(4)
    columns = pa.array(texts(9, 200, 15) + texts(8, 50, 3000))
    (words,) = words_of(columns)
    parse = recompression.Parse(words, 20)
    keys, seen = parse.of_windows(), {}
    for i in np.flatnonzero(parse.is_window).tolist():
        window = words.keys[i : i + 20].tobytes()
        assert seen.setdefault(window, keys[i]) == keys[i]
    assert rng and len(set(seen.values())) > 100


def test_kept_text(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, f"c  {passage}\nd"), (3, "short"), (4, f"a {passage} b")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["kept_text"] for r in recompression.dedup(docs, kept_text=True).collect()}
    assert got == {1: f"a {passage} b", 2: "c d", 3: "short", 4: ""}


def test_kept_text_of_one_id_with_two_texts(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    docs = spark.createDataFrame([(1, passage), (1, passage + " tail"), (2, passage), (None, "head " + passage)], "doc_id bigint, text string")
    got = recompression.dedup(docs, kept_text=True).collect()
    assert len(got) == 4 and sum(r["n_removed"] for r in got) == 75
    assert sorted(r["kept_text"] for r in got if r["doc_id"] == 2 or r["doc_id"] is None) == ["", "head"]


def test_the_largest_id_is_not_a_missing_one(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(2**63 - 1, f"{passage} a"), (None, f"{passage} b"), (None, f"{passage} a"), (1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, recompression.dedup(docs).select("doc_id", "n_words", "n_removed").collect()), key=repr)
    assert got == sorted([(2**63 - 1, 26, 0), (None, 26, 25), (None, 26, 26), (1, 1, 0)], key=repr)
    with pytest.raises(ValueError):
        recompression.dedup(spark.createDataFrame([(2**63 - 1, "a"), (-(2**63), "b")], "doc_id bigint, text string"))

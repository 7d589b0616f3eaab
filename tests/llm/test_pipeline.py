import hashlib
import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from verbarium.llm.queries import tokenizer_path


def test_stages(spark):
    words = [f"w{i}" for i in range(400)]
    item = " ".join(f"leak{i}" for i in range(30))
    rows = [(i, " ".join(words[i * 7 % 300 :][:60] + [f"own{i}_{k}" for k in range(40)]), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0", 1), (101, rows[1][1] + " more", "en", "s1", 1), (102, f"start {item} end", "en", "s2", 1), (103, "", "en", None, 0), (104, None, None, None, None), (None, "no id at all", "en", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = pipeline.one_of_each(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [*range(60), 102, 103, 104]
    assert kept.where("doc_id is null").count() == 1 and kept.columns == list(pipeline.COLUMNS)
    mixed = pipeline.mixed(spark, docs, "")
    assert mixed.columns == list(pipeline.COLUMNS)
    assert mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3


def test_whole(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    out = pipeline.run(spark, data).toPandas()
    assert len(out) and (out.n_tokens >= 1).all() and out.start.min() == 0
    assert out.n_tokens.sum() == (out.start + out.n_tokens).max()


def planted():
    """Clean documents, shouted ones, near copies and leaks: rows, labels and items."""
    rng = random.Random(11)
    some = lambda n: ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 8))) for _ in range(n)]
    items = [(i, " ".join(some(20))) for i in range(4)]
    texts = {i: some(rng.randrange(40, 80)) for i in range(120)}
    labels = [(i, 1) for i in texts]
    for i in range(200, 215):
        texts[i] = [*texts[i - 200], "tail"]
    for i in range(300, 310):
        leak = items[i % 4][1].split()
        leak[3 : 3 + i % 3] = ["changed"] * (i % 3)
        texts[i] = [*some(15), *leak, *some(15)]
    bad = {i: [w.upper() + "!!" for w in some(60)] for i in range(400, 460)}
    labels += [(i, 0) for i in bad]
    rows = [(i, " ".join(w), "en", f"s{i % 3}" if i % 5 else None, 1) for i, w in (texts | bad).items()]
    return rows, labels, items, set(bad)


def plain_groups(texts):
    """The smallest id of each group of near copies."""
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    top = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((top[a], top[b]))
                top = {i: low if x == high else x for i, x in top.items()}
    return set(top.values())


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def plain_times(rows):
    """How often the mix takes each document."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    size = {r[0]: len(r[1].split()) for r in rows}
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    goal, left, free = {}, 1.5 * sum(total.values()), set(sources)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * total[s]}
        goal |= {s: 2 * total[s] if over else weight[s] * level for s in over or free}
        left, free = left - sum(goal[s] for s in over), free - over if over else set()
    times = {}
    for s in sources:
        epochs, rest = divmod(int(goal[s] + 0.5), total[s])
        for i in sorted((r[0] for r in rows if r[3] == s), key=lambda i: int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:13], 16)):
            times[i] = epochs + (rest > 0)
            rest = max(0, rest - size[i])
    return {i: n for i, n in times.items() if n}


def test_stages_against_plain_python(spark, tmp_path):
    rows, labels, items, bad = planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    data = str(tmp_path)
    docs.write.parquet(f"{data}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{data}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{data}/benchmark.parquet")
    kept, by = [], {r[0]: r for r in rows}
    for _, stage in pipeline.STAGES[:-1]:
        docs, _ = pipeline.materialize(stage(spark, docs, data))
        got = [tuple(r) for r in docs.collect()]
        assert all(r == by[r[0]] for r in got)
        kept.append(Counter(r[0] for r in got))
    want = set(by) - bad
    assert kept[0] == Counter(want)
    want = plain_groups({i: by[i][1] for i in want})
    assert not want & set(range(200, 215)) and kept[1] == Counter(want)
    leaks = {i for i in want if any(plain_distance(t.split(), by[i][1].split()) <= len(t.split()) * 15 // 100 for _, t in items)}
    want -= leaks
    assert leaks == set(range(300, 310)) and kept[2] == Counter(want) == Counter(range(120))
    times = plain_times([by[i] for i in want])
    assert kept[3] == Counter(times) and len(set(times.values())) > 1
    tool, at, tokens = Tokenizer.from_file(tokenizer_path()), 0, []
    for i in sorted(kept[3].elements()):
        ids = [*tool.encode(by[i][1], add_special_tokens=False).ids, 0]
        tokens.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, pipeline.run(spark, data).collect()), key=lambda r: r[1]) == tokens

"""Personal data: base spans against the patterns themselves, trees against plain sums,
and what is found in planted texts."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from verbarium.llm import pii

# the patterns as they are stated
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def valid(kind, span):
    digits = [int(c) for c in span if "0" <= c <= "9"]
    if kind == 1:
        return all(int(p) <= 255 for p in span.split("."))
    if kind == 2:
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == 0 or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if valid(k, m[0])]


TEXTS = [
    None, "", "plain words only", "a@b.c@d.e x@y", "a@b@c.d-e.f.", "@@a@b.c..d", "1.2.3.4.5.6.7.8.9", "256.1.1.1 0255.000.1.1", "1.2.3", "4539148803436467 4539148803436467", "4539-1488 0343-6467", "4539148803436468", "+1 (988) 555-2485 x", "+1234567 +12345678", "++1 234 5678", "+1 2", "é+33 1 23 45 67 89\n+1 ((((2",
    "mail é.a@ü.de or josé@x.fr", "x" * 300 + "@y.z", "1 " * 40, "a.b" * 50, "+" * 50, "٣٤٥ 1.2.3.4", "+1 (2) 3-4.5 6 7 8", "0000000000000000", "1.2.3.4@5.6",
]


def test_base_spans():
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("ab1234567890@@.+- ()é", k=rng.randrange(60))) for _ in range(4000)]
    texts += ["".join(rng.choices(["4539148803436467", "12", "@", ".", "x", " ", "-", "+", "255", "256", "00"], k=rng.randrange(12))) for _ in range(4000)]
    for t in texts:
        assert pii.base_spans(t or "") == brute(t), t


def test_long_texts_take_linear_time():
    n = 300_000
    for t in ("a" * n, "1" * n, "1." * n, "@" * n, "+" * n, "a@" * n, "+1 " * n, "1 " * n, "at " * n, "(" * n, ":" * n, "a:" * n, "dot " * n):
        began = time.perf_counter()
        pii.base_spans(t)
        pii.loose_spans(t)
        assert time.perf_counter() - began < 20, t[:4]


@pytest.fixture(scope="module")
def model():
    contexts = [(k, left, "", right) for k in range(4) for left in ("we said ", "and so. ", "on the way, ", "") for right in (" and left", ". Then", "", ", or") for _ in range(8)]
    return pii.learn(contexts)


FOUND = [
    ("write to jane.doe (at) example (dot) com please", "email", "jane.doe (at) example (dot) com"), ("call 415-555-2671 now", "phone", "415-555-2671"), ("or (415) 555-2671.", "phone", "(415) 555-2671"), ("paid 4539.1488.0343.6467 then", "card", "4539.1488.0343.6467"),
    ("at host 10[.]0[.]0[.]1 we", "ip", "10[.]0[.]0[.]1"), ("josé.garcía@exämple.de wrote", "email", "josé.garcía@exämple.de"), ("two 4539148803436467 4539148803436467 in line", "card", "4539148803436467"),
]
CLEAN = ["on 2024-01-15 and 3.14159265 we", "version 1.2.3.4567 is", "order 123456789012345", "look at the dot on it", "550e8400-e29b-41d4-a716-446655440000", "1 2 3 4 5 6 7 8 9 10 11", "sold at 3.50 each", "@jane is here", "1,234,567 in 1990-2000", "12:30:45", "we met at noon. Then it rained"]


def test_found_and_left_alone(model):
    for text, kind, span in FOUND:
        assert any(pii.KINDS[k] == kind and text[a:b] == span and not base for k, a, b, base, _ in pii.chosen([text], model.plain())[0]), text
    for text in CLEAN:
        assert pii.chosen([text], model.plain()) == [[]], text


def test_base_spans_stay_and_nothing_else_overlaps(model):
    rng = random.Random(2)
    parts = ["4539148803436467", "415-555-2671", "a@b.com", "é", "1.2.3.4", "+1 415 555 2671", "x (at) y (dot) com", " ", " ", "-", "7", ", "]
    texts = ["".join(rng.choices(parts, k=8)) for _ in range(300)]
    for text, spans in zip(texts, pii.chosen(texts, model.plain()), strict=True):
        assert [s[:3] for s in spans if s[3]] == brute(text)
        added = sorted(s[1:3] + (s[0],) for s in spans if not s[3])
        assert all(a[1] <= b[0] for a, b in zip(added, added[1:], strict=False))
        for a, b, kind in added:
            assert all(e <= a or b <= s or (k == kind and a <= s and e <= b) for k, s, e in brute(text))
    assert pii.chosen(texts[:40], model.plain()) == [pii.chosen([t], model.plain())[0] for t in texts[:40]]


def test_trees():
    """Boosting lowers the loss, and batches are scored as a plain walk scores rows."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (600, 5)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 3] > 3)).astype(float)
    settings = pii.Settings(trees=25, depth=3)
    trees = pii.grow(x, y, settings)
    which, cut, leaf, first = trees
    got = pii.logits(x, trees)
    for row, logit in zip(x[:50], got[:50], strict=True):
        total = first
        for t in range(25):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(row[which[t, node]] > cut[t, node])
            total += leaf[t, node - 7]
        assert abs(total - logit) < 1e-9
    assert ((got > 0) == (y == 1)).mean() > 0.98
    slope, _ = pii.curve(got, y)
    assert slope > 0
    assert len(set(pii.logits(np.zeros((3, 5)), pii.grow(np.zeros((4, 5)), np.array([0.0, 1, 1, 1]), settings)))) == 1


def test_tables(spark, model):
    texts = TEXTS + [t for t, _, _ in FOUND] + CLEAN + ["word " * 40_000 + "a@b.com"]
    docs = spark.createDataFrame([(i if i else None, t, "e", 1) for i, t in enumerate(texts)] + [(3, texts[3], "e", 1)], "doc_id bigint, text string, spans string, start int").repartition(3)
    got = {r["doc_id"]: r for r in pii.digest(pii.find(docs, model)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r, base = got[i or None], brute(text)
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["spans"] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b, *_ in pii.chosen([text or ""], model.plain())[0])
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert clean[texts.index("1.2.3.4@5.6")] == "[EMAIL]" and clean[None] is None
    assert clean[texts.index("call 415-555-2671 now")] == "call [PHONE] now"
    assert clean[len(texts) - 1] == "word " * 40_000 + "[EMAIL]"
    assert pii.digest(pii.find(docs.limit(0), model)).collect() == []


def test_contexts(spark):
    """The sample is the same however rows are dealt, bounded, and without copies."""
    rows = [(f"go {i} to u{i % 40}@x{i % 3}.com or +1 415 555 {1000 + i % 25} now",) for i in range(300)] + [(None,), ("",)] + [("copy a@b.com here",)] * 100
    docs = spark.createDataFrame(rows, "text string")
    one, two = pii.contexts(docs.repartition(1), 30), pii.contexts(docs.repartition(4), 30)
    assert one == two and len(one) == len(set(one)) == 60
    assert pii.contexts(docs.limit(0), 30) == []
    assert pii.learn([]).plain()[3]

"""Katz backoff against a recursive evaluation by definition."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellmill.llm import katz as K

ROWS = [
    (1, "a b a b c d e the the the of the of a b"),
    (2, "The of the of the of A b c c c d f g h i"),
    (3, None),
    (4, ""),
    (5, "x y z a b the of unseen words here a b"),
    (6, "a b c d e f g a b the of the"),
    (6, "a b c d e f g a b the of the"),
    (7, "b a b a the the of of a a b b c d zz zz zz zz"),
    (None, "the of a b éé \t q"),
]


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def reference(rows, learn, vocabulary):
    """score and contract columns by definition, and P(event | context) of all events."""
    train = [words(t) for i, t in rows if learn(i)]
    uni = Counter(w for t in train for w in t)
    total, kinds = sum(uni.values()), len(uni)
    d1 = K.discounts(Counter(uni.values()))
    disc = lambda c, d: d[c] * c if c <= K.DISCOUNTED else c
    kept = sum(disc(c, d1) for c in uni.values())
    unknown = max(1 - kept / total, 1 / (total + 1))
    p1 = {w: disc(c, d1) * (1 - unknown) / kept for w, c in uni.items()}
    head = vocabulary(uni)
    event = lambda w: w if w in head else "<class>"
    reserved = 1 / (total + 1)
    mass = 1 - sum(p1[w] for w in head)
    e1 = {w: p1[w] * (1 - reserved) for w in head} | {"<class>": mass * (1 - reserved)}
    pairs = Counter()
    for t in train:
        for h, w in zip(["<s>", *map(event, t)], map(event, t)):
            pairs[h, w] += 1
    of = Counter()
    for (h, _), c in pairs.items():
        of[h] += c
    d2 = K.discounts(Counter(pairs.values()))

    def p(w, h):
        if pairs[h, w]:
            return disc(pairs[h, w], d2) / of[h]
        seen = [x for x in e1 if pairs[h, x]]
        return (1 if w == "<reserved>" else e1[w]) * (1 - sum(disc(pairs[h, x], d2) / of[h] for x in seen)) / (1 - sum(e1[x] for x in seen))

    def score(t):
        out, h = 0.0, "<s>"
        for w in words(t):
            out += math.log10(p(event(w), h))
            if w not in head:
                out += math.log10(p1.get(w, unknown) / mass)
            h = event(w)
        return out

    base = lambda t: sum(math.log10((uni[w] + 1) / (total + kinds + 1)) for w in words(t))
    return [(i, len(words(t)), sum(uni[w] > 0 for w in words(t)), total, base(t), score(t)) for i, t in rows], p, e1, of, reserved


@pytest.mark.parametrize(("size", "common"), [(3, K.COMMON), (1 << 16, 4), (1 << 16, K.COMMON)])
def test_matches_the_definition(spark, monkeypatch, size, common):
    monkeypatch.setattr(K, "VOCABULARY", size)
    monkeypatch.setattr(K, "COMMON", common)
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    got = K.katz(df, F.coalesce(F.col("doc_id") != 5, F.lit(True))).drop("row").collect()
    # ties among words of equal count go by hash: take the head that the model took
    import pyarrow as pa

    def vocabulary(uni):
        def key(w):
            return int((K.END if w is None else K.stream(pa.array([w]))[0][0]).view("int64"))

        return set(sorted(uni, key=lambda w: (-uni[w], key(w)))[:size])

    want, p, e1, of, reserved = reference(ROWS, lambda i: i != 5, vocabulary)
    order = lambda r: (r[0] is None, r[0] or 0, r[5])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-9)
    for h in of:
        if h is not None:
            assert sum(p(w, h) for w in e1) + reserved * p("<reserved>", h) == pytest.approx(1, rel=1e-9)


@pytest.mark.parametrize(("head", "common"), [(3, 2), (5, 5), (1 << 16, 4)])
def test_rare_words_keep_their_pairs(spark, monkeypatch, head, common):
    """Words beyond the broadcast head have contexts and events of their own: the result does not depend on its size."""
    monkeypatch.setattr(K, "HEAD", head)
    monkeypatch.setattr(K, "COMMON", common)
    monkeypatch.setattr(K, "CHUNK_TOKENS", 8)
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = K.katz(df, F.coalesce(F.col("doc_id") != 5, F.lit(True))).drop("row").collect()
    want = reference(ROWS, lambda i: i != 5, set)[0]
    order = lambda r: (r[0] is None, r[0] or 0, r[5])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-9)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert K.katz_score(df).collect() == []


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = K.katz_score(docs).collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all(r["score"] < 0 for r in rows)

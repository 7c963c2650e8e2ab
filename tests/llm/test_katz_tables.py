"""Stored Katz tables against the one-pass model and a recursion by definition."""

import itertools
import random
from collections import Counter

import pytest
from test_katz import ROWS, words

from cellmill.llm import katz as K
from cellmill.llm import katz_tables as T


def definition(texts, order):
    """P_n(w | h) by recursion over counts; w may be <reserved>, which keeps some mass unseen."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        padded = [K.START] * (order - 1) + t
        for i in range(len(t)):
            for n in range(1, order + 1):
                grams[n][tuple(padded[i + order - n : i + order])] += 1
    d = [None, *(K.discounts(Counter(g.values())) for g in grams[1:])]
    factor = lambda c, n: (d[n][c] if c <= K.DISCOUNTED else 1.0) * c
    total = sum(grams[1].values())
    kept = sum(factor(c, 1) for c in grams[1].values())
    unknown = max(1 - kept / total, 1 / (total + 1))
    reserved = 1 / (total + 1)
    by = [Counter() for _ in range(order + 1)]
    follow = [{} for _ in range(order + 1)]
    for n in range(2, order + 1):
        for g, c in grams[n].items():
            by[n][g[:-1]] += c
            follow[n].setdefault(g[:-1], []).append(g[-1])

    def p(w, h):
        n = len(h) + 1
        if n == 1:
            if w == "<reserved>":
                return reserved
            c = grams[1][(w,)]
            return (factor(c, 1) * (1 - unknown) / kept if c else unknown) * (1 - reserved)
        if grams[n][(*h, w)]:
            return factor(grams[n][(*h, w)], n) / by[n][h]
        if not by[n][h]:
            return p(w, h[1:])
        seen = follow[n][h]
        alpha = (1 - sum(factor(grams[n][(*h, x)], n) for x in seen) / by[n][h]) / (1 - sum(p(x, h[1:]) for x in seen))
        return alpha * p(w, h[1:])

    return p, [g[0] for g in grams[1]]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_tables_against_definition(spark, tmp_path, order):
    import math

    rng = random.Random(order)
    more = [(20 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))) for i in range(15)]
    rows = ROWS + more
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learnt = [r for r in rows if r[0] is None or r[0] % 3]
    model = T.fit(df.where("doc_id IS NULL OR doc_id % 3 > 0"), str(tmp_path / "model"), order)
    p, vocabulary = definition([words(t) for _, t in learnt], order)
    got = sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 8)) for r in T.score(df, model).collect())
    want = []
    for i, t in rows:
        own, total = words(t), 0.0
        padded = [K.START] * (order - 1) + own
        for k in range(len(own)):
            total += math.log10(p(padded[k + order - 1], tuple(padded[k : k + order - 1])))
        want.append((str(i), len(own), round(total, 8)))
    assert got == sorted(want)
    for h in itertools.islice(itertools.product(["a", "b", "the", K.START], repeat=order - 1), 12):  # exactly normalised: known words, unknown ones and what is reserved
        assert sum(p(w, h) for w in [*vocabulary, "<never>", "<reserved>"]) == pytest.approx(1, abs=1e-9)
    with pytest.raises(Exception, match="exists"):
        T.fit(df, str(tmp_path / "model"), order)


def test_tables_give_what_one_pass_gives(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    one = {(r["doc_id"], r["n_tokens"]): r["score"] for r in K.katz(df, F.lit(True)).collect()}
    model = T.fit(df, str(tmp_path / "m"), 2)
    two = {(r["doc_id"], r["n_tokens"]): r["score"] for r in T.score(df.repartition(2), model).collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)
    stored = spark.read.parquet(str(tmp_path / "m/grams"))
    assert {"n", "bucket"} <= set(stored.columns) and stored.where("n = 2").count() > 20


def test_empty(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    model = T.fit(df.limit(0), str(tmp_path / "m"), 2)
    assert {r["score"] for r in T.score(df, model).collect()} == {0.0} and T.score(df.limit(0), model).collect() == []
    with pytest.raises(ValueError):
        T.fit(df, str(tmp_path / "x"), 0)

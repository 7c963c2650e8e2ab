import math
import random
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest
from cases import ODD, docs, none
from pyspark.sql import functions as F

from cellmill.llm import language_id as L
from cellmill.llm import toxicity as T


def test_language_held_out(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = L.language_id(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert rows and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_language_odd_rows(spark):
    rows = L.language_id(docs(spark)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert by[2] == by[3] == by[4] == "und" and by[5] == "en"


def test_language_without_labels(spark):
    rows = L.language_id(docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}
    assert L.language_id(none(spark)).collect() == []


def grams(text):
    """n-grams that start or end with a letter, words padded by one blank on each side; with how they are hashed."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    spaced = "".join(c if unicodedata.category(o)[0] == "L" else " " for c, o in zip(low, text))
    for w in spaced.split():
        for n in L.LENGTHS:
            padded = w if n == 1 else f" {w} "
            for i in range(len(padded) - n + 1):
                h = 0
                if padded[i] == padded[i + n - 1] == " ":
                    continue
                for c in padded[i : i + n]:
                    h = (h * 0x100000001B3 + (0 if c == " " else ord(c)) + 1) % 2**64
                yield L.LENGTHS.index(n), h * 0x9E3779B97F4A7C15 % 2**64


def test_language_against_definition(spark, monkeypatch):
    """Predictions and scores of a small corpus from counts by hand; long texts come in pieces."""
    rows = [r[:3] for r in ODD if r[0] is not None] + [(20 + i, t, k) for i, (t, k) in enumerate([("ab ba", "y"), ("ba", "x"), ("zé 12 Zé", "x"), ("a", None), ("xyz ab " * 60, None), (" ", "y")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, matrix = L.train(df)
    assert langs == sorted({k for _, t, k in rows if k and t is not None})
    counts = {k: Counter() for k in langs}
    for _, t, k in rows:
        if k and t is not None:
            counts[k].update((n, h >> 49) for n, h in grams(t))
    prior = Counter(k for _, t, k in rows if k and t is not None)
    monkeypatch.setattr(L, "SLICE", 40)
    for _, t, _ in rows:
        if t is None or len(t) > 1000:
            continue
        own = [(n, h >> 49) for n, h in grams(t)]
        name, value = L.score([t], langs, matrix)
        if not own:
            assert name == ["und"] and value[0] == 0
            continue
        sums = []
        for k in langs:
            total = [sum(v for (m, _), v in counts[k].items() if m == n) + 0.1 * L.BUCKETS for n in range(3)]
            sums.append(sum(math.log((counts[k][g] + 0.1) / total[g[0]]) for g in own))
        z = [s * min(1, L.EVIDENCE / len(own)) + math.log(prior[k] / sum(prior.values())) for s, k in zip(sums, langs)]
        best = max(range(len(langs)), key=lambda i: (sums[i] + math.log(prior[langs[i]] / sum(prior.values())), -i))
        assert name == [langs[best]]
        assert value[0] == pytest.approx(math.exp(z[best] - max(z)) / sum(math.exp(x - max(z)) for x in z), rel=1e-3)


def test_very_many_languages(spark, monkeypatch):
    monkeypatch.setattr(L, "CELLS", 1 << 16)
    rows = [(i, chr(0x4E00 + i) * 5, f"l{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, matrix = L.train(df)
    assert len(langs) == 50 and matrix.size <= 1 << 17
    monkeypatch.setattr(L, "LANGUAGES", 7)
    assert L.train(df.unionByName(df.where("doc_id = 9")))[0] == sorted(["l9", "l0", "l1", "l10", "l11", "l12", "l13"])


def test_known_language(spark):
    """Nulls, texts without letters and clashing columns; the stage keeps what it was given."""
    df = docs(spark)
    for c in ("language", "_language", "sure", "lang_pred", "rate", "number"):
        df = df.withColumn(c, F.lit(c))
    out = L.known_language(df)
    assert out.columns == df.columns
    got = out.collect()
    assert {r["doc_id"] for r in got} == {1, 5, 6, 7, 8, 9, None} and all(r["_language"] == "_language" and r["rate"] == "rate" for r in got)
    assert L.known_language(none(spark)).collect() == []


def test_language_ties():
    """Of equal languages the one that sorts first."""
    matrix = np.zeros((len(L.LENGTHS) * L.BUCKETS + 1, 2), np.float32)
    assert L.score(["abc", None], ["de", "en"], matrix)[0] == ["de", "und"]


def test_toxicity_held_out(spark, sf):
    d, labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    rows = T.toxicity(d, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert rows and right >= 0.93 * len(rows)


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (5, 1, 0), (7, None, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = T.toxicity(docs(spark), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert len(T.toxicity(docs(spark), labels.limit(0)).collect()) == len(ODD)
    assert T.toxicity(none(spark), labels).collect() == []


def best(scores, at=0):
    """Maximal segments by definition: the best one, then those left and right of it."""
    found = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
    if found[0] <= 1e-12:
        return []
    i, j = found[3:]
    return best(scores[:i], at) + [(at + i, at + j - 1, round(found[0], 9))] + best(scores[j:], at + j)


def test_segments_against_definition():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(0, 25)
        full = [rng.choice([2.3, 1.1, 3.7]) + rng.random() / 100 if rng.random() < 0.3 else -rng.random() - 0.01 for _ in range(n)]
        got = [(a, b, round(s, 9)) for a, b, s in T.segments(np.array(full))]
        assert got == best(full)


def test_scan_is_linear():
    """Falling, rising and alternating sums take time in proportion to the scores."""
    n = 200_000
    for scores in ([1.0, -2.0] * n, [2.0, -1.0] * n, [1.0 + k / n - (k % 2) * 2.0 for k in range(2 * n)], [3.0, -1.0] * (n // 2) + [1.0, -2.0] * (n // 2)):
        begun = time.process_time()
        T.scan(scores)
        assert time.process_time() - begun < 5


def test_toxicity_against_definition(spark):
    """Odds, law, curve and scores of a small sample, computed word by word."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        y = int(i % 3 == 0)
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randint(5, 40))]
        for _ in range(3 * y):
            words.insert(rng.randrange(len(words)), rng.choice(["foul", "vile"]))
        rows.append((i, " ".join(words), y))
    rows += [(60, "", 0), (61, None, 1), (62, "foul foul vile foul " * 50, 1), (62, "w1 w1 w2", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))

    tokens, texts = [Counter(), Counter()], [Counter(), Counter()]
    for _, t, y in rows:
        tokens[y].update((t or "").split())
        texts[y].update(set((t or "").split()))
    n = [sum(c.values()) for c in tokens]
    every = T.PRIOR * sum(n)
    odds = {}
    for w in tokens[0] | tokens[1]:
        p, q = T.PRIOR * (tokens[0][w] + tokens[1][w]), T.PRIOR * (texts[0][w] + texts[1][w])
        logit = [math.log((tokens[y][w] + p) / (n[y] + every - tokens[y][w] - p)) for y in (0, 1)]
        d = logit[1] - logit[0]
        doubt = T.DOUBT * math.sqrt(sum(1 / (texts[y][w] + q) for y in (0, 1)))
        odds[w] = max(-T.HIGHEST, min(T.HIGHEST, math.copysign(max(0.0, abs(d) - doubt), d)))

    def scored(t):
        words = (t or "").split()
        return words, [(0.0 if k and words[k - 1] == w else odds[w]) - T.DRIFT for k, w in enumerate(words)]

    assert sum(tokens[0][w] / n[0] * math.exp(model.rate * (odds[w] - T.DRIFT)) for w in tokens[0]) == pytest.approx(1, abs=1e-4) or model.rate == 1.0
    found = []
    for _, t, y in rows:
        words, s = scored(t)
        if len(words) > 60:  # too long for the definition
            found.append(None)
            continue
        found.append((best(s), words, s))
    clean = sorted(math.floor(x[2] * 100 + 1e-7) / 100 for f, r in zip(found, rows) if not r[2] and f for x in f[0])
    if clean:
        x0 = max(x for x in clean if sum(v >= x for v in clean) >= len(clean) * (1 - T.TAIL))
        assert model.size == pytest.approx(sum(v >= x0 for v in clean) / n[0] * math.exp(model.rate * x0), rel=0.05)
    got = {(r["doc_id"], r["text"]): r["score"] for r in T.passages(df, model).join(df, "doc_id").where("doc_id < 62").collect()}
    for f, (i, t, _) in zip(found, rows):
        if f is None or i == 62:
            continue
        own = {}
        for a, b, v in f[0]:
            key = tuple(w for w, s in zip(f[1][a : b + 1], f[2][a : b + 1]) if s > 0)
            own[key] = max(own.get(key, 0.0), v)
        total = top = 0.0
        space = math.log(max(model.size * max(len(f[1]), 1), 1.0))
        for r, v in enumerate(sorted(own.values(), reverse=True), 1):
            total += model.rate * v - space
            top = max(top, total + math.log(math.factorial(r)))
        assert got[i, t] == pytest.approx(1 / (1 + math.exp(-(model.slope * math.log1p(top) + model.level))), abs=1e-3)
    long = T.passages(df.where("doc_id = 62 AND length(text) > 50"), model).collect()[0]
    assert long["score"] > 0.5 and len(long["passages"]) >= 1

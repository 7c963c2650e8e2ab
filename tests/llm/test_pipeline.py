"""Each stage of the pipeline on what the one before kept."""

import re

import pytest
from cases import words
from pyspark.sql import functions as F

P = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    out, d = [], spark.read.parquet(f"{sf}/documents.parquet")
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in P.STAGES:
        got = stage(spark, d, sf)
        got.write.parquet(f"{folder}/{name}")
        out.append((d.toPandas(), spark.read.parquet(f"{folder}/{name}").toPandas()))
        d = spark.read.parquet(f"{folder}/{name}")
    return out


def test_columns(stages):
    for a, b in stages[:-1]:
        assert list(a.columns) == list(b.columns)
    assert {"size", "target", "copies"} <= set(stages[-1][1].columns)


def test_language_by_its_model(stages, spark):
    from cellmill.llm import language_id as L

    a, b = stages[0]
    model = L.train(spark.createDataFrame(a[["doc_id", "text", "lang"]]))
    names, sure = L.score(a.text.tolist(), *model)
    assert sorted(b.doc_id) == sorted(i for i, n, x in zip(a.doc_id, names, sure) if n != "und" and x >= 0.5)
    assert len(b) >= 0.99 * len(a)


def test_near_duplicates(stages):
    from test_near_copies import brute

    a, b = stages[1]
    classes = brute(list(zip(a.doc_id.tolist(), a.text.tolist())))
    assert sorted(b.doc_id) == sorted({c for _, c, _ in classes})


def test_repeats_are_cut(stages):
    from test_suffix_dedup import brute

    a, b = stages[2]
    want = brute(list(zip(a.doc_id.tolist(), a.text.tolist())))
    assert sorted(a.doc_id) == sorted(b.doc_id)
    for i, t in zip(b.doc_id, b.text):
        assert len(t.encode()) <= want[i][0] - want[i][1] and len(t.encode()) > want[i][0] - want[i][1] - 8 * (want[i][2] + 1)


def test_benchmark_goes(stages, spark, sf):
    """Exactly the documents go that hold an item by the rule, judged on every diagonal."""
    import numpy as np
    from test_near_copies import held

    from cellmill.llm import decontaminate as D

    a, b = stages[3]
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    number: dict = {}
    code = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], int)
    coded, bad = [code(x) for x in items], set()
    for i, t in zip(a.doc_id, a.text):
        own = words(t)
        doc = code(own)
        for item, c in zip(items, coded):
            if not len(c) or not len(doc):
                continue
            x, y = np.nonzero(doc[:, None] == c[None, :])
            if len(x) and np.bincount(x - y + len(c)).max() >= D.needed(len(c)):
                for d in np.flatnonzero(np.bincount(x - y + len(c)) >= D.needed(len(c))) - len(c):
                    lo, hi = max(0, d), min(len(own), d + len(c))
                    if held(own[lo:hi], item[lo - d : hi - d]) >= D.needed(len(c)) and (len(c) >= D.SHORTEST or own == item):
                        bad.add(i)
    assert bad and sorted(b.doc_id) == sorted(set(a.doc_id) - bad)


def test_mixture(stages):
    a, b = stages[4]
    assert set(b.doc_id) <= set(a.doc_id) and b.copies.between(1, 3).all()
    n = b.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    for _, rows in b.assign(n=n * b.copies).groupby("source"):
        assert abs(rows.n.sum() - rows.target.iloc[0]) <= 2 * rows["size"].max()


def test_run(stages, spark, sf):
    assert sorted(r[0] for r in P.run(spark, sf).select("doc_id").collect()) == sorted(stages[4][1].doc_id)
    assert F is not None

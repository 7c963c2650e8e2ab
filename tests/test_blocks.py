"""Genes in one array a cell: the same draws, counts and masks as their definitions, and no shuffle of places."""

import math
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmill import queries as own
from cellmill.functions.digests import md5_pairs
from cellmill.operators import pairs as pa
from cellmill.operators import sampling as sa


@pytest.mark.parametrize("name", ["d12_missing_token_policy", "d8_sampled_genes", "prj12_valid_mask", "d9_process_batch", "join10_tokens", "p7_masked_values", "p6_prepend_cls", "d10_loader_batches"])
def test_places_are_not_shuffled(spark, sf, name):
    plan = own.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.find("MapInArrow") < plan.find("Exchange")


def test_md5_of_pairs():
    for first, a, b in (("11|", [0, 9, 10, 99, 123456789012], [0, 7, 10, 130, 99999]), ("x" * 60, [1, 2], [3, 4]), ("", [-1, 5], [2, 2])):
        a, b = np.array(a), np.array(b)
        want = lambda x, y: md5(f"{first}{x}|k|{y}".encode()).hexdigest()  # noqa: B023, E731
        high, low = md5_pairs(first, a, "|k|", b)
        assert [f"{h:016x}{l:016x}" for h, l in zip(high.tolist(), low.tolist())] == [want(x, y) for x, y in zip(a, b)]
        high, low = md5_pairs(first, a[:, None], "|k|", b[None, :])
        assert [[f"{h:016x}{l:016x}" for h, l in zip(*r)] for r in zip(high.tolist(), low.tolist())] == [[want(x, y) for y in b] for x in a]


def _by_definition(cell, size, hot, shut, need, weight):
    """sample_arrays in mode expressed, cell by cell."""
    key = lambda *x: md5("|".join(map(str, (5, cell, *x))).encode()).hexdigest()
    u = lambda *x: (int(key(*x)[:8], 16) + 1) / 4294967297.0
    out = set(hot) | set(shut)
    left = size - len(out)
    tried = [n for n in dict.fromkeys(int(key(0, i)[:15], 16) % size for i in range(2 * need + 64)) if n not in out]
    if len(tried) < min(need, left):
        tried = [n for n in sorted(range(size), key=lambda n: (key(0, "all", n), n)) if n not in out]
    found, at = [], 0.0
    for i, n in enumerate(tried[: min(need, left)], 1):
        at += -math.log(u(0, "key", i)) / (left - i + 1)
        found.append((round(at, 9), n))
    found += [(round(-math.log(u("hot", n)) / (1 + weight), 9), n) for n in set(hot) - set(shut)]
    return [n for _, n in sorted(found)][:need]


@pytest.mark.parametrize("size", [5, 20, 60, 5000])
def test_arrays_are_drawn_as_defined(spark, size):
    rows = [(i, i % 2, [0, 2, 3], [4, i % 3, 1]) for i in range(95, 125)] + [(10**9, 1, [], []), (7, 9, [0], [1])]  # no genes are known of dataset 9
    frame = spark.createDataFrame(rows, "global_row_index long, dataset_index int, expressed_gene_indices array<int>, expression_counts array<int>")
    genes = spark.createDataFrame([(d, g, 7 * g + d, not (d and g in (1, 3))) for d in range(2) for g in range(size)], "dataset_index int, origin_index int, global_feature_id long, able boolean")
    got = {r["global_row_index"]: r["genes"] for r in sa.sample_arrays(frame, genes, 8, 5).collect()}
    want = {c: [7 * g + d for g in _by_definition(c, size, [g for g, n in zip(e, k) if n > 0], (1, 3) if d else (), 8, 3.0)] for c, d, e, k in rows if d < 2}
    assert got == want


def test_processed_arrays_are_processed_rows(spark):
    asked = [(0, 0, [0, 2], [4, 1], [4, 1, None, 9, -5]), (1, 1, [], [], [2, 3]), (2, 1, [0, 1], [7, 9], None), (3, 1, [1, 0], [7, 9], [2, 2, 0, 4, 3, 2]), (4, 8, [0], [1], [2])]
    rows = spark.createDataFrame(asked, "global_row_index long, dataset_index int, expressed_gene_indices array<int>, expression_counts array<int>, genes array<long>")
    genes = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (0, 2, 4), (1, 0, 2), (1, 1, 2), (1, 2, 3)], "dataset_index int, origin_index int, global_feature_id long")
    counts = spark.createDataFrame([(0, 1, 0, 4), (0, 4, 2, 1), (2, 2, 0, 7), (2, 2, 1, 9), (3, 2, 1, 7), (3, 2, 0, 9)], "global_row_index long, global_feature_id long, origin_index int, count int")
    plain = sa.process(rows, rows.select("global_row_index", F.posexplode("genes").alias("seq", "global_feature_id")), counts, genes, 5)
    arrays = sa.process_arrays(rows, genes, 5)
    table = lambda df, *names: sorted(map(tuple, df.select("global_row_index", "seq", *names).collect()))
    want = {r["global_row_index"]: (r["genes"], r["counts"], r["mask"]) for r in sa.collate(plain).collect()}
    assert {r["global_row_index"]: (r["genes"], r["counts"], r["mask"]) for r in arrays.collect()} == want
    assert want[3][1] == [9, 9, -1, -1, 0]
    tokens = spark.createDataFrame([(1, 5, True), (2, None, False), (4, 8, False), (3, 11, True)], "global_id long, token_id long, tokenizable boolean")
    for policy in ("pad", "exclude"):
        names = ("global_feature_id", "count", "valid", "token_id")
        assert table(sa.tokenize_arrays(arrays, tokens, policy=policy), *names) == table(sa.tokenize(plain, tokens, policy=policy), *names)
    with pytest.raises(ValueError):
        sa.tokenize_arrays(arrays, tokens, policy="other")
    names = ("global_feature_id", "count", "valid", "masked", "value")
    assert table(pa.mask_arrays(arrays, 0.5, 9), *names) == table(pa.mask(plain, 0.5, 9), *names)
    uncut = {r["global_row_index"]: r["counts"] for r in sa.process_arrays(rows, genes, None, pad=-2).collect()}
    assert uncut == {0: [1, 4, -2, -2, -2], 1: [0, 0], 2: [], 3: [9, 9, -2, -2, 0, 9], 4: [-2]}


def _fetched(spark, monkeypatch):
    """Numbers of rows that the driver is given from now on."""
    seen, kind = [], type(spark.range(0))
    plain = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: seen.append((got := plain(self)).num_rows) or got)
    return seen


def test_genes_reach_the_driver_packed(spark, monkeypatch):
    n = 150_000
    genes = spark.range(2 * n).selectExpr("cast(id % 2 as int) AS dataset_index", "cast(id div 2 as int) * 3 AS origin_index", "(id div 2) * 2 AS global_feature_id")  # every third local and second global number
    rows = spark.createDataFrame([(5, 1, [3 * (n - 1), 1, 65_536 * 3], [7, 8, 9], [2 * (n - 1), 1, 65_536 * 2, 0, 2 * n]), (6, 7, [0], [1], [0])], "global_row_index long, dataset_index int, expressed_gene_indices array<int>, expression_counts array<int>, genes array<long>")
    seen = _fetched(spark, monkeypatch)
    arrays = sa.process_arrays(rows, genes, 5)
    assert 0 < sum(seen) <= 20
    got = sorted(map(tuple, pa.mask_arrays(arrays, 0.0, 9).select("global_row_index", "seq", "count", "valid").collect()))
    assert [x[2:] for x in got] == [(7, True), (-1, False), (9, True), (0, True), (-1, False)] + [(-1, False)] * 5


def test_tokens_reach_the_driver_packed(spark, monkeypatch):
    n = 150_000
    rows = spark.createDataFrame([(5, 0, [0, 1, 2 * (n - 1), 3, 4, 2 * n], [4, 0, 1, 1, 0, 3], [True, True, True, True, False, True])], "global_row_index long, dataset_index int, genes array<long>, counts array<int>, mask array<boolean>")
    tokens = spark.range(n).selectExpr("id * 2 AS global_id", f"if(id = 1, null, {n} - id) AS token_id", "id <> 2 AS tokenizable")
    seen = _fetched(spark, monkeypatch)
    got = sa.tokenize_arrays(rows, tokens, policy="pad")
    assert 0 < sum(seen) <= 10
    assert [r["token_id"] for r in got.orderBy("seq").collect()] == [n, 0, 1, 0, 0, 0]
    assert [r["seq"] for r in sa.tokenize_arrays(rows, tokens).orderBy("seq").collect()] == [0, 2, 4]


def test_wide_numbers_are_kept(spark):
    from cellmill.operators import blocks as bl

    got = bl._numbers(spark.createDataFrame([(0, 5), (2, 1 << 40), (70_000, -3)], "a int, v long"), "a", "v")
    assert list(got) == [0] and len(got[0]) == 70_001
    assert {i: int(got[0][i]) for i in np.flatnonzero(got[0] != bl.NONE)} == {0: 5, 2: 1 << 40, 70_000: -3}
    assert bl._numbers(spark.createDataFrame([], "a int, v long"), "a", "v") == {}


def test_paired_places_are_not_rows(spark, sf):
    from cellmill.operators import loaders as lo
    from cellmill.plans.views import Corpus
    from cellmill.queries.samplers import _CONFIG, _loader

    rows = lo.PairedLoader(_loader(Corpus(spark, sf), mode="expressed"), _CONFIG).examples()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 3 and "Generate" not in plan and "Window" not in plan
    one = rows.first()
    assert len(one["genes"]) == len(one["source_values"]) == len(one["target_values"]) == len(one["masked"]) == 16 and sum(one["masked"]) == 2

import itertools
import random
import re

import numpy as np
import pytest
from cases import docs, none
from pyspark.sql import functions as F

from cellmill.llm import mixing as M


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(sums):
    """Targets by rounds of sharing out the excess."""
    order = sorted(sums, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sums.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sums[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sums[s] for s in over}


def check(spark, df):
    rows = M.mixing(df).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, M.mixing(df.repartition(5)).collect()), key=str)
    given = df.collect()
    assert len(rows) == len(given)
    sums, taken, longest = {}, {}, {}
    for r in given:
        sums[r["source"]] = sums.get(r["source"], 0) + size(r["text"])
        longest[r["source"]] = max(longest.get(r["source"], 0), size(r["text"]))
    want = filled(sums)
    for r in rows:
        assert r["source_size"] == sums[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    return taken, want, longest


def test_odd_rows(spark):
    taken, want, longest = check(spark, docs(spark))
    for s in taken:
        assert abs(taken[s] - want[s]) <= 2 * longest[s]


def test_many(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 60), None, rng.choice("abbbbbbcd"), 0) for i in range(600)]
    taken, want, _ = check(spark, docs(spark, rows))
    for s in taken:
        assert abs(taken[s] - want[s]) <= 2


def test_empty(spark):
    assert M.mixing(none(spark)).collect() == []


def test_knapsack():
    rng = random.Random(2)
    for _ in range(200):
        lengths = rng.sample(range(2, 12), 3)
        counts = [rng.randint(1, 3) for _ in lengths]
        goal = rng.randint(1, 40)
        got = M.knapsack(lengths, counts, goal)
        assert all(got.get(x, 0) <= c for x, c in zip(lengths, counts))
        sums = {sum(x * n for x, n in zip(lengths, ns)) for ns in itertools.product(*(range(c + 1) for c in counts))}
        assert sum(x * n for x, n in got.items()) in [s for s in sums if abs(s - goal) == min(abs(x - goal) for x in sums)]


def test_fit_takes_the_nearest():
    whole, extra = M.fit(np.array([290000, 300000]), np.array([1, 1]), 580000.0, "x")
    assert whole == 0 and extra.tolist() == [1, 1]
    rng = random.Random(9)
    for _ in range(40):
        sizes = np.array(sorted({rng.choice([rng.randint(1, 50), rng.randint(10_000, 400_000)]) for _ in range(6)}))
        counts = np.array([rng.randint(1, 4) for _ in sizes])
        target = rng.random() * 3 * float((sizes * counts).sum())
        whole, extra = M.fit(sizes, counts, target, "x")
        assert ((extra >= 0) & (extra <= counts)).all() and 0 <= whole <= 3
        assert abs((sizes * (whole * counts + extra)).sum() - target) <= sizes.max()


def test_stage_keeps_columns(spark):
    """Columns with the names of helpers stay; rows of one id and different texts are taken one by one."""
    rows = [(None, "w " * (1 + i % 7) + f"x{i}", "en", "ab"[i % 2], i) for i in range(80)] + [(3, None, None, None, 1)]
    df = docs(spark, rows)
    for c in ("n", "cut", "extra", "whole", "s1", "z1", "h", "_h", "_s1", "x", "part", "rank", "cap"):
        df = df.withColumn(c, F.lit(c))
    out = M.mix(df)
    assert out.columns == [*df.columns, "size", "source_size", "target", "copies"]
    got = out.collect()
    assert len(got) == 81 and all(r[c] == c for r in got for c in ("n", "cut", "s1", "h", "_h", "x"))
    for s in "ab":
        some = [r for r in got if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in some) - some[0]["target"]) <= 1
    assert M.mix(df.limit(0)).collect() == []

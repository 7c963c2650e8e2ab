import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from cases import ODD, docs, none, words

from cellmill.llm import decontaminate as D
from cellmill.llm import jaccard_join as J
from cellmill.llm import spotsigs as S


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset([text or ""])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), collections.Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    return sorted(((d, min((x for x in ids[find(i)] if x is not None), default=None), links[i]) for i, (d, _) in enumerate(rows)), key=str)


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(99)}"
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize("block", [J.BLOCK_TEXTS, 2])
def test_join(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK_TEXTS", block)
    for rows in ([(i, t) for i, t, *_ in ODD], made(20, 3)):
        got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == brute(rows)


def test_join_empty_and_stage(spark):
    assert J.jaccard_join(none(spark)).collect() == []
    out = J.one_of_each(docs(spark))
    assert out.columns == docs(spark).columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(["1", "2", "4", "5", "6", "7", "9", "None"])


def test_stage_decides_by_row(spark):
    """Rows that share an id, or have none, are judged by their own texts; columns with a helper's name stay."""
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    near = text[0] + " more"
    rows = [(1, text[0], 7), (None, near, 7), (None, text[1], 7), (2, text[2], 7), (2, near, 7), (2, text[2], 8), (3, text[3], 7), (None, text[1], 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int")
    for c in ("t", "d", "h", "rows", "rep", "_t"):
        df = df.withColumn(c, F.lit(c))
    out = J.one_of_each(df.repartition(3))
    got = out.collect()
    assert out.columns == df.columns and {r["_t"] for r in got} == {"_t"}
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(1, text[0]), (None, text[1]), (2, text[2]), (3, text[3])], key=str)
    links = {(r["doc_id"], r["class_id"], r["n_links"]) for r in J.jaccard_join(df).collect()}
    assert links == {(1, 1, 2), (None, 1, 2), (2, 1, 2), (None, None, 1), (2, 2, 1), (3, 3, 0)}
    assert J.one_of_each(df.limit(0)).collect() == []


def test_pruning_floor():
    floors = J.least_matches()
    assert all(floors[n] < 0.8 * n for n in floors) and floors[150] > 80


def test_spotsigs(spark):
    rows = [(i, t) for i, t, *_ in ODD if i is not None and i != 1] + [(1, ODD[0][1])] + made(6, 4)[10:]
    rows = list({r[0]: r for r in rows}.values())
    got = {r["doc_id"]: r for r in S.spotsigs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    cut = lambda p: {p[k : k + 8] for k in range(0, len(p), 8)}
    for (i, text), (j, after) in zip(order, order[1:] + order[:1]):
        text, after, r = text or "", after or "", got[i]
        q = len(text) // 4
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()
        for near, other in ((r["near_edited"], r["edited_fingerprint"]), (r["near_next"], got[j]["fingerprint"])):
            a, b = cut(r["fingerprint"]), cut(other)
            short = min(len(a), len(b)) < S.FLOOR * max(len(a), len(b))
            assert near == pytest.approx(0.0 if short else len(a & b) / len(a | b))
    assert got[7]["fingerprint"] == got[8]["fingerprint"] and got[2]["fingerprint"] == got[3]["fingerprint"]


def test_spotsigs_one_and_none(spark):
    assert S.spotsigs(none(spark)).collect() == []
    r = S.spotsigs(spark.createDataFrame([(4, "the cat sat")], "doc_id long, text string")).collect()
    assert r[0]["near_next"] == 1.0
    assert len(S.spotsigs(docs(spark)).collect()) == len(ODD)


def signatures(text):
    """The signature set by definition: hashed chains of words after anchors; a # stands for the anchors between two words of a chain."""
    import regex
    import xxhash

    tokens, open_ = [], False
    for w in regex.findall(r"[\p{L}\p{N}]+", text.lower()):
        if w in S.ANCHORS:
            open_ = True
        else:
            tokens.append(("#" if open_ else "") + w)
            open_ = False
    if open_:
        tokens.append("#")
    hashed = lambda chains: {xxhash.xxh64_intdigest(c.encode(), seed=42) & 0x7FFFFFFF for c in chains}
    chains = ["  ".join([t[1:], *tokens[k + 1 : k + S.CHAIN]]) for k, t in enumerate(tokens) if t.startswith("#") and len(t) > 1]
    if chains:
        return hashed(chains)
    every = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    return hashed("  ".join(every[k : k + S.CHAIN]) for k in range(len(every))) if every else hashed([text])


def test_chains(spark):
    row = S.with_signatures(spark.createDataFrame([("the cat of the dog sat on mats",), ("CAT dog, dog sat mats!",)], "t string"), "t", "s").collect()
    assert len(row[0]["s"]) == 3 and len(row[1]["s"]) == 5


def test_signatures_against_definition(spark):
    rng = random.Random(12)
    pool = [*rng.sample(S.ANCHORS, 8), "cat", "Dog", "zürich", "x1", "42", "éa", "#", "--", "_"]
    texts = [t or "" for _, t, *_ in ODD] + ["".join(rng.choice(pool) + rng.choice([" ", ", ", "  ", "\n", "#"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in S.with_signatures(rows, "t", "s").collect():
        assert r["s"] == sorted(signatures(r["t"])), r["t"]


def held(text, item, equal=D.EQUAL, share=D.SHARE):
    """Most equal words of a stretch that counts, over all places of the item and all stretches; 0 if none counts."""
    need, best = D.needed(len(item), equal, share), 0
    if len(item) < D.SHORTEST:
        return len(item) if item and text == item else 0
    for d in range(1 - len(item), len(text)):
        same = [0 <= d + k < len(text) and text[d + k] == w for k, w in enumerate(item)]
        for a in range(len(item)):
            for b in range(a + need, len(item) + 1):
                n = sum(same[a:b])
                if n >= need and n >= share * (b - a) - 1e-9:
                    best = max(best, n)
    return best


def test_masks_lose_nothing():
    """Every placement of the substitutions that the rule allows leaves a seed."""
    for n in range(D.SHORTEST, 21):
        need = D.needed(n) if n <= 17 else -(-7 * n // 10)
        bad = np.array(list(itertools.combinations(range(n), n - need)), int)
        same = np.ones((len(bad), n), bool)
        if n > need:
            np.put_along_axis(same, bad, False, axis=1)
        found = np.zeros(len(bad), bool)
        for m in D.MASKS if n > D.SHORTEST else ("1" * n,):
            at = np.flatnonzero([x == "1" for x in m])
            for k in range(n - len(m) + 1):
                found |= same[:, at + k].all(axis=1)
        assert found.all(), n


def test_decontamination_against_definition(spark):
    rng = random.Random(6)
    items = [[f"w{rng.randrange(60)}" for _ in range(n)] for n in (1, 2, 4, 5, 5, 6, 7, 8, 9, 10, 12, 13, 15, 17, 18, 20, 25, 31)]
    rows = []
    for i in range(150):
        item = rng.choice(items)
        a = rng.randrange(len(item)) if rng.random() < 0.3 else 0
        part = [w if rng.random() > rng.choice([0.0, 0.2, 0.3, 0.4]) else f"z{rng.randrange(9)}" for w in item[a:]]
        pad = lambda: [f"w{rng.randrange(60)}" for _ in range(rng.choice([0, 0, 3, 30]))]
        rows.append((i, " ".join(pad() + part + pad())))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["equal"] for r in D.contaminated(df, bench).collect()}
    want = {(i, k): n for i, t in rows for k, x in enumerate(items) if (n := held(t.split(), x))}
    assert got == want and len(want) > 60


def test_decontamination(spark):
    rng = random.Random(5)
    item = [f"b{rng.randrange(9999)}" for _ in range(40)]
    short = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    changed = [w if k % 7 else "sub" for k, w in enumerate(item)]
    noise = lambda n: [f"n{rng.randrange(99999)}" for _ in range(n)]
    rows = [
        (1, " ".join(noise(50) + item + noise(30))), (2, " ".join(noise(9) + changed)), (3, " ".join(noise(200))), (4, " ".join(noise(5) + short + noise(5)).upper()),
        (5, None), (6, ""), (7, " ".join(item[:6] + noise(50))), (8, " ".join(noise(200_000) + item[10:35])), (1, " ".join(item)), (None, " ".join(item)), (9, "A  b!"), (10, "a b c"), (None, "other words"), (1, "not this"),
    ]
    bench = spark.createDataFrame([(100, " ".join(item), 1), (101, " ".join(short), 1), (102, None, 1), (103, "a b", 1), (100, " ".join(item), 1)], "item_id long, text string, doc_id int")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]): r for r in D.contaminated(df, bench).collect()}
    assert set(got) == {(1, 100), (2, 100), (4, 101), (8, 100), (None, 100), (9, 103)}
    assert got[1, 100]["equal"] == 40 and got[1, 100]["coverage"] == 1.0 and got[8, 100]["equal"] == 25
    for c in ("t", "d", "h", "_t", "item_id", "equal", "end_word"):
        df = df.withColumn(c, F.lit(c))
    out = D.clean(df, bench)
    assert out.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"] in ("not this", "other words")) for r in out.collect()) == [("1", True), ("10", False), ("3", False), ("5", False), ("6", False), ("7", False), ("None", True)]
    assert D.contaminated(df.limit(0), bench).collect() == [] and D.contaminated(df, bench.limit(0)).collect() == []
    assert D.clean(df.limit(0), bench).collect() == [] and D.clean(df, bench.limit(0)).count() == len(rows)


def test_decontamination_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"k{i}x{j}" for j in range(30))) for i in range(20)], "item_id long, text string")
    df = bench.selectExpr("item_id + 1000 AS doc_id", "concat('q ', text) AS text")
    whole = sorted(map(tuple, D.contaminated(df, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 700)
    assert sorted(map(tuple, D.contaminated(df, bench).collect())) == whole and len(whole) == 20

import hashlib
import random

import pytest
from cases import ODD, docs, none

from cellmill.llm import suffix_dedup as S


def brute(rows, length=S.LENGTH):
    seen, out = {}, {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data, gone = (text or "").encode(), bytearray(len((text or "").encode()))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if seen.setdefault(w, (key, i)) != (key, i):
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[key] = (len(data), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def same(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = S.suffix_dedup(df).collect()
    assert len(got) == len(rows)
    assert {r[0]: tuple(r)[1:] for r in got} == brute(rows)


def test_odd_rows(spark):
    same(spark, [(i, t) for i, t, *_ in ODD])


@pytest.mark.parametrize("most", [S.MOST, 3])
def test_repeats(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MOST", most)
    rng = random.Random(4)
    base = "".join(rng.choice("abcd é") for _ in range(2500))
    rows = [(i, base[rng.randrange(2000) :][: rng.randrange(900)] + "".join(rng.choice("ab") for _ in range(rng.randrange(200))) + base[rng.randrange(2400) :][:300]) for i in range(25)]
    rows += [(100, "a" * 700), (101, "ab" * 400), (102, "x" * 99), (103, "x" * 99), (104, "\0" * 300), (105, "ab\0" * 150), (106, "one line of text, number 1\n" * 20)]
    for i in range(110, 130):
        t = list(base[:900])
        for _ in range(4):
            t[rng.randrange(len(t))] = "Z"
        rows.append((i, "".join(t)))
    rng.shuffle(rows)
    same(spark, rows)


def test_same_id_and_different_texts(spark, monkeypatch):
    """Rows of one id, or of none, lose only what their own texts repeat; very long texts come in pieces."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(S, "PIECE", 1000)
    rng = random.Random(8)
    a, b, c, d = ("".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (400, 400, 300, 5000))
    rows = [(1, a), (5, b), (5, a), (5, b), (None, c), (None, b[:200]), (None, c), (7, d), (8, d[700:4100] + c), (9, d[:90] + a[50:350])]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars int").repartition(3)
    order = {}  # a document is an id and a text; texts of one id are in order of their hash
    hashes = dict(df.select("text", F.xxhash64("text")).collect())
    for i, t in rows:
        order[(i is not None, i or 0, hashes[t])] = t
    want = {(k[1] if k[0] else None, order[k]): v for k, v in brute([((n,), order[k]) for n, k in enumerate(sorted(order))]).items() for k in [sorted(order)[k[0]]]}
    got = S.suffix_dedup(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *want[i, t]) for i, t in rows), key=str)
    for name in ("doc", "t", "d", "h", "_spans", "_doc", "spans"):
        df = df.withColumn(name, F.lit(1))
    out = S.without_repeats(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert r["n_chars"] == len(r["text"]) and r["_spans"] == r["doc"] == 1
    assert sorted(len(r["text"]) for r in out.where("doc_id = 5").collect())[-1] >= 200


def test_stage_keeps_columns(spark):
    df = docs(spark).withColumnRenamed("score", "n_chars")
    out = S.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(ODD)
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)


def test_empty(spark):
    assert S.suffix_dedup(none(spark)).collect() == []


def test_groups_are_maximal_repeats():
    """Every string of the least length that two contexts share at one offset is in a group with exactly its occurrences."""
    rng = random.Random(7)
    for _ in range(60):
        length = 12
        gram = "MIDDLE"
        contexts = ["".join(rng.choice("ab") for _ in range(8)) + gram + "".join(rng.choice("ab") for _ in range(10)) for _ in range(6)]
        data = [c.encode() for c in contexts]
        got = {}
        for some, _, least, most in S.groups(data, [8] * 6, [0] * 6, length):
            for o in range(least, most + 1):
                assert len({data[i][8 - o : 8 - o + length] for i in some}) == 1
                got.setdefault((o, data[some[0]][8 - o : 8 - o + length]), set()).update(some)
        want = {}
        for o in range(9):
            for i, d in enumerate(data):
                want.setdefault((o, d[8 - o : 8 - o + length]), set()).add(i)
        assert got == {k: v for k, v in want.items() if len(v) > 1 and len(k[1]) == length}

"""Every operator on a text of some megabytes beside short ones, with columns whose names operators use themselves."""

import random

import pytest
from cases import docs
from pyspark.sql import functions as F

from cellmill.llm import decontaminate as D
from cellmill.llm import jaccard_join as J
from cellmill.llm import katz as K
from cellmill.llm import language_id as L
from cellmill.llm import licenses as C
from cellmill.llm import mixing as M
from cellmill.llm import spotsigs as P
from cellmill.llm import suffix_dedup as S
from cellmill.llm import toxicity as T

BYTES = 3 << 20
CLASHES = ("t", "d", "h", "k", "x", "w", "row", "key", "n", "c", "size", "part", "rows", "next", "own", "text_sum", "bands", "copies", "known", "head", "passages", "train", "held", "spans", "_t", "rep")


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(40_000)]
    text = " ".join(rng.choice(words) for _ in range(BYTES // 7))
    passage = text[1_500_000:1_500_400]
    rows = [(1, text, "en", "a", 1), (2, passage, "en", "a", 1), (3, "under the MIT license " + passage, "de", "b", 1), (4, text + " and more", "en", "b", 1), (4, "foul vile words", "de", None, 1), (None, None, "en", "a", 1)]
    df = docs(spark, rows)
    for c in CLASHES:
        df = df.withColumn(c, F.lit(c))
    return rows, df.persist()


def test_mixing(long):
    rows, df = long
    got = {(r["doc_id"], r["size"]): r for r in M.mixing(df).collect()}
    assert {s for _, s in got} >= {len(rows[0][1].split()), len(rows[1][1].split()), 0} and len(got) == 6


def test_licenses(long):
    got = [r for r in C.license_scan(long[1]).collect() if r["doc_id"] == 3]
    assert got[0]["base_labels"] == "mit" and got[0]["first_word"] == 0


def test_suffix(long):
    rows, df = long
    got = {(r["doc_id"], r["n_bytes"]): r for r in S.suffix_dedup(df).collect()}
    whole = len(rows[0][1])
    assert got[1, whole]["n_removed"] == 0 and got[2, 400]["n_removed"] == 400 and got[4, whole + 9]["n_removed"] >= whole
    out = S.without_repeats(df)
    assert out.columns == df.columns and {r["spans"] for r in out.select("spans").collect()} == {"spans"}


def test_katz(long):
    rows, df = long
    got = K.katz_score(df).collect()
    assert len(got) == 6 and sorted(r["n_tokens"] for r in got) == sorted(len((t or "").split()) + 1 for _, t, *_ in rows)


def test_language(long):
    assert {r["lang_pred"] for r in L.language_id(long[1]).collect() if r["doc_id"] in (1, 2)} <= {"en", "de"}


def test_toxicity(long, spark):
    labels = spark.createDataFrame([(1, 0, 5), (2, 0, 5), (4, 1, 5)], "doc_id long, toxic int, x int")
    got = T.toxicity(long[1], labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    again = T.toxicity(long[1].repartition(2), labels).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_decontamination(long, spark):
    rows, df = long
    words = rows[0][1].split()
    bench = spark.createDataFrame([(7, " ".join(words[200_000:200_020])), (8, " ".join(words[-30:]))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["equal"], r["first_word"]) for r in D.contaminated(df, bench).collect()}
    assert {(1, 7, 20, 200_000), (4, 7, 20, 200_000), (1, 8, 30, len(words) - 30)} <= got
    assert D.clean(df, bench).columns == df.columns


def test_join(long):
    rows, df = long
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in J.jaccard_join(df).collect()}
    assert (1, 1, 1) in got and (4, 1, 1) in got and (None, None, 0) in got
    out = J.one_of_each(df)
    assert out.columns == df.columns and out.where("length(text) > 1000000").count() == 1


def test_spotsigs(long):
    rows, df = long
    got = P.spotsigs(df).collect()
    assert len(got) == 6 and {r["n_chars"] for r in got} == {len(t or "") for _, t, *_ in rows}

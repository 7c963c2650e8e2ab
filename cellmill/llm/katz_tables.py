"""Katz backoff of any order as stored tables: fitted once, written, and read to score other documents.

The query of this operator scores the corpus that it learns from in one pass of
pairs (katz.py); this is the general form. Two tables are written as Parquet,
partitioned by order and by a bucket of the context's hash:

  grams     n, context, event, back (context without its first word), c, p
  contexts  n, context, alpha

p is log10 of the discounted probability of a seen n-gram (Good-Turing factors
of its order), alpha log10 of the backoff weight, which gives what discounting
took to the words that the context was not seen with, exactly:

  P_n(w | h) = p if (h, w) was seen, else alpha(h) P_(n-1)(w | h'); an unknown
  context has a weight of 1, and unknown words share the unknown mass.

Scoring goes down the orders by that recursion, a join a level; n-grams that
repeat in a text are looked up once. Hot contexts are pre-aggregated before
the shuffle when counted, and split by Spark's skew join when looked up.

Defined cases: a null text is empty (its end token is scored); rows that
repeat an id are scored one by one; nothing to learn from gives a score of 0;
columns other than doc_id and text do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, slices, text_column
from .katz import DISCOUNTED, SLICE, START, Unigrams, discounts, stream

BUCKETS = 64


@dataclass
class Tables:
    """Where a fitted model is, its order, and log10 of the unknown mass."""

    folder: str
    order: int
    unknown: float
    d: dict[int, list[float]] = field(default_factory=dict)

    def grams(self, spark: SparkSession, n: int) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/grams").where(F.col("n") == n)

    def contexts(self, spark: SparkSession, n: int) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/contexts").where(F.col("n") == n)


def context_hashes(w: np.ndarray, offs: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 1 to order, the hash of the n - 1 tokens before each token (starts before the first)."""
    place = np.arange(len(w)) - np.repeat(offs[:-1], np.diff(offs))
    before = []
    for k in range(1, order):
        prev = np.concatenate([np.zeros(min(k, len(w)), np.uint64), w[:-k]])
        before.append(np.where(place >= k, prev, START))
    out = [np.zeros(len(w), np.uint64)]
    for n in range(2, order + 1):
        h = np.zeros(len(w), np.uint64)
        for k in range(n - 1, 0, -1):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + before[k - 1] + np.uint64(n))
        out.append(h)
    return out


def _unique(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one of each distinct row of keys, and how often it occurs."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def count_grams(docs: DataFrame, order: int) -> DataFrame:
    """n, context, event, back, c of all n-grams up to `order` of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            for a, b in slices(texts, SLICE):
                w, offs = stream(texts[a:b])
                found = context_hashes(w, offs, order)
                for n, context in enumerate(found, 1):
                    at, c = _unique(w, context)
                    back = found[n - 2][at] if n > 1 else np.zeros(len(at), np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), *(pa.array(x.view(np.int64)) for x in (context[at], w[at], back)), pa.array(c.astype(np.int64))], names=["n", "context", "event", "back", "c"])

    return docs.select("text").mapInArrow(run, "n int, context long, event long, back long, c long").groupBy("n", "context", "event", "back").agg(F.sum("c").alias("c"))


def _factor(c: Column, d: np.ndarray) -> Column:
    """The discount of a count."""
    table = F.array(*(F.lit(float(x)) for x in d[1:]))
    return F.when(c <= DISCOUNTED, F.get(table, (F.least(c, F.lit(DISCOUNTED)) - 1).cast("int"))).otherwise(1.0)


def _write(df: DataFrame, key: Column, path: str) -> None:
    df.withColumn("bucket", F.pmod(key, F.lit(BUCKETS)).cast("int")).repartition("n", "bucket").write.mode("append").partitionBy("n", "bucket").parquet(path)


def fit(docs: DataFrame, folder: str, order: int = 3) -> Tables:
    """Counts, discounts and backoff weights of docs (text), written below a folder that must be new. Only counts of counts come to the driver."""
    if order < 1:
        raise ValueError("order must be above 0")
    spark = docs.sparkSession
    raw = f"{folder}/counts"
    count_grams(docs, order).write.partitionBy("n").parquet(raw)
    counts = spark.read.schema("context long, event long, back long, c long, n int").parquet(raw)
    some = counts.groupBy("n", F.least("c", F.lit(DISCOUNTED + 2)).alias("r")).agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("s")).collect()  # a few rows an order
    of = {n: {r["r"]: r["k"] for r in some if r["n"] == n and r["r"] <= DISCOUNTED + 1} for n in range(1, order + 1)}
    total, kinds = sum(r["s"] for r in some if r["n"] == 1), sum(r["k"] for r in some if r["n"] == 1)
    if not total:
        return Tables(folder, order, 0.0)
    uni = Unigrams(np.zeros(0, np.uint64), np.zeros(0, np.int64), total, kinds, of[1])
    out = Tables(folder, order, math.log10(uni.unknown * (1 - uni.reserved)), {n: discounts(of[n]).tolist() for n in of})
    c = F.col("c")
    one = counts.where("n = 1")
    p = _factor(c, uni.d) * c * uni.scale * (1 - uni.reserved)
    _write(one.select("n", "context", "event", "back", "c", F.log10(p).alias("p")), F.col("event"), f"{folder}/grams")
    for n in range(2, order + 1):
        rows = counts.where(F.col("n") == n).withColumn("kept", _factor(c, np.array(out.d[n])) * c)
        lower = out.grams(spark, n - 1).select(F.col("context").alias("back"), "event", F.pow(F.lit(10.0), "p").alias("below"))
        sums = rows.join(lower, ["back", "event"]).groupBy("context").agg(F.sum("c").alias("total"), F.sum("kept").alias("mass"), F.sum("below").alias("share"))
        alpha = F.log10(F.greatest(1 - F.col("mass") / F.col("total"), F.lit(1e-300)) / F.greatest(1 - F.col("share"), F.lit(1e-300)))
        _write(sums.select(F.lit(n).alias("n"), "context", "total", alpha.alias("alpha")), F.col("context"), f"{folder}/contexts")
        totals = out.contexts(spark, n).select("context", "total")
        _write(rows.join(totals, "context").select("n", "context", "event", "back", "c", F.log10(F.col("kept") / F.col("total")).alias("p")), F.col("context"), f"{folder}/grams")
    return out


def score(docs: DataFrame, model: Tables) -> DataFrame:
    """doc_id, n_tokens, score (log10 probability) of every row of docs."""
    spark, order = docs.sparkSession, model.order
    if not model.d:  # nothing was learned
        return docs.select("doc_id", (F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")) + 1).cast("long").alias("n_tokens"), F.lit(0.0).alias("score"))
    names = [f"h{n}" for n in range(2, order + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, row, ids = text_column(batch), batch.column(0).to_numpy(), batch.column(1)
            for a, b in slices(texts, SLICE):
                w, offs = stream(texts[a:b])
                text = np.repeat(np.arange(b - a), np.diff(offs))
                found = context_hashes(w, offs, order)
                at, c = _unique(w, found[-1], text)
                cols = [pa.array(row[a:b][text[at]]), ids[a:b].take(pa.array(text[at])), pa.array(w[at].view(np.int64)), pa.array(c.astype(np.int64)), *(pa.array(h[at].view(np.int64)) for h in found[1:])]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "event", "times", *names])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, "row long, doc_id long, event long, times long" + "".join(f", {h} long" for h in names))

    def probability(rows: DataFrame, n: int) -> DataFrame:
        """rows with p<n>, log10 P_n of the event after its context."""
        if n == 1:
            one = model.grams(spark, 1).select("event", F.col("p").alias("p1"))
            return rows.join(one, "event", "left").withColumn("p1", F.coalesce("p1", F.lit(model.unknown)))
        seen = model.grams(spark, n).select(F.col("context").alias(f"h{n}"), "event", F.col("p").alias(f"s{n}"))
        weight = model.contexts(spark, n).select(F.col("context").alias(f"h{n}"), F.col("alpha").alias(f"a{n}"))
        lower = probability(rows, n - 1).join(seen, [f"h{n}", "event"], "left").join(weight, f"h{n}", "left")
        return lower.withColumn(f"p{n}", F.coalesce(f"s{n}", F.coalesce(f"a{n}", F.lit(0.0)) + F.col(f"p{n - 1}"))).drop(f"s{n}", f"a{n}", f"p{n - 1}")

    whole = probability(rows, order)
    return whole.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.col(f"p{order}")).alias("score")).drop("row")

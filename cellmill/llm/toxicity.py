"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme values.

1. Tokens (words, hashed into BUCKETS) are counted in toxic and in clean
   labelled texts. A token's log-odds have an informative Dirichlet prior (the
   shares of all labelled text, worth PRIOR of it) and are drawn towards 0 by
   DOUBT standard deviations, which follow from the number of texts that hold
   the token, as tokens of one text come in bursts. Each token scores its
   log-odds less DRIFT; one that repeats the token before it scores -DRIFT.
2. A linear scan finds all maximal scoring segments of a text.
3. The extreme-value law of such scores in clean text (Karlin and Altschul):
   lambda solves the moment equation of the clean texts' token scores, K is
   estimated from the number of their segments above the quantile TAIL. A
   segment is significant if fewer than one as good is expected by chance.
4. The best sum statistic of a text's segments (of those of the same scored
   tokens, the best one) is put on a logistic curve fitted on the same sample.

The classifier is fitted on at most SAMPLE labelled documents (those of the
smallest hashes), a bound that lets their ids be broadcast; the table of
BUCKETS scores has a fixed size.

Defined cases: a null text is empty; an empty text has no segment and gets
the curve's value at 0; several labels of one id count as toxic if any is;
rows that repeat an id are learned from and scored one by one; without
labelled texts of both classes every score is 0; of segments with equal scores
the first and shortest counts; a very long text is hashed in chunks and its
scan keeps its positive runs only; columns other than doc_id, text and toxic
do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, held_out, raw, slices, text_column, tokens

SAMPLE, BITS, PRIOR, DOUBT, DRIFT, HIGHEST, TAIL = 24_000, 20, 0.02, 1.0, 1.0, 8.0, 0.99
BUCKETS = 1 << BITS


def buckets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word (lower-cased runs of letters, digits and non-ASCII characters), and n + 1 offsets of the texts."""
    h, _, starts = tokens(*raw(texts))
    return (h >> np.uint64(64 - BITS)).astype(np.int64), starts


def log_odds(clean: np.ndarray, toxic: np.ndarray, clean_texts: np.ndarray, toxic_texts: np.ndarray) -> np.ndarray:
    """Log-odds of each bucket's token under toxic against clean text, by the prior, drawn towards 0 by DOUBT deviations; 0 for what was not seen."""
    n0, n1 = clean.sum(), toxic.sum()
    prior = PRIOR * (clean + toxic)
    all_ = prior.sum()
    out = np.zeros(len(clean))
    seen = prior > 0
    a, b, p = toxic[seen] + prior[seen], clean[seen] + prior[seen], prior[seen]
    delta = np.log(a / np.maximum(n1 + all_ - a, p)) - np.log(b / np.maximum(n0 + all_ - b, p))
    texts = PRIOR * (clean_texts + toxic_texts)[seen]
    doubt = DOUBT * np.sqrt(1 / (toxic_texts[seen] + texts) + 1 / (clean_texts[seen] + texts))
    out[seen] = np.sign(delta) * np.maximum(0.0, np.abs(delta) - doubt)
    return np.clip(out, -HIGHEST, HIGHEST)


def scan(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence of scores.

    Every segment keeps where its sum starts and ends, and a link to the
    nearest one before it whose sum starts lower; the search for that follows
    links, so each segment is passed over once and the scan is linear.
    """
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []
    high: list[float] = []
    link: list[int] = []
    total = 0.0
    for p, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        a, l, r, j = p, before, total, len(first) - 1  # noqa: E741
        while True:
            while j >= 0 and low[j] >= l:
                j = link[j]
            if j < 0 or high[j] >= r:
                first.append(a)
                last.append(p)
                low.append(l)
                high.append(r)
                link.append(j)
                break
            a, l, up = first[j], low[j], link[j]  # noqa: E741
            del first[j:], last[j:], low[j:], high[j:], link[j:]
            j = up
    return [(a, b, r - l) for a, b, l, r in zip(first, last, low, high, strict=True)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last token, score) of a text's token scores; only runs of one sign are scanned."""
    up = scores > 0
    if not up.any():
        return []
    run = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
    ends = np.append(run[1:], len(scores)) - 1
    return [(int(run[a]), int(ends[b]), s) for a, b, s in scan(np.add.reduceat(scores, run).tolist())]


def statistic(found: list[float], n: int, rate: float, size: float) -> float:
    """The best Karlin-Altschul sum statistic of the segment scores of a text of n tokens; 0 without any."""
    best = total = 0.0
    space = math.log(max(size * max(n, 1), 1.0))
    for r, s in enumerate(sorted((rate * x for x in found), reverse=True), 1):
        total += s - space
        best = max(best, total + math.lgamma(r + 1))
    return best


class Model:
    """Token scores by bucket (without DRIFT), rate and size (lambda and K) of the extreme-value law, and the curve's two parameters."""

    def __init__(self, odds: np.ndarray | None = None, rate: float = 1.0, size: float = 1.0, slope: float = 0.0, level: float = -1e9) -> None:
        self.odds, self.rate, self.size, self.slope, self.level = odds, rate, size, slope, level

    def found(self, texts: pa.Array) -> Iterator[tuple[list[tuple[int, int, float]], list[float], int]]:
        """Of each text its segments, the scores of distinct ones, and the number of its tokens."""
        for a, b in slices(texts):
            if self.odds is None:
                yield from (([], [], 0) for _ in range(b - a))
                continue
            bucket, starts = buckets_of(texts[a:b])
            scores = self.odds[bucket].astype(np.float64)
            scores[1:][bucket[1:] == bucket[:-1]] = 0.0
            scores -= DRIFT
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                found, best = segments(scores[i:j]), {}
                for x in found:
                    own = slice(i + x[0], i + x[1] + 1)
                    key = bucket[own][scores[own] > 0].tobytes()
                    best[key] = max(best.get(key, 0.0), x[2])
                yield found, list(best.values()), j - i

    def significant(self, found: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float]]:
        """Segments of which fewer than one as good is expected in a clean text of n tokens."""
        space = math.log(max(self.size * max(n, 1), 1.0))
        return [x for x in found if self.rate * x[2] > space]

    def statistic(self, scores: list[float], n: int) -> float:
        return statistic(scores, n, self.rate, self.size)

    def probability(self, x: float) -> float:
        if self.odds is None:
            return 0.0
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * math.log1p(x) + self.level))))


def rate_of(odds: np.ndarray, clean: np.ndarray) -> float:
    """lambda: the positive root of the moment equation, sum of share times exp(lambda score) = 1, over the clean texts' tokens."""
    some = clean > 0
    share, score = clean[some] / clean.sum(), odds[some] - DRIFT
    if (share * score).sum() >= 0 or score.max() <= 0:  # no positive score, or no negative mean: the law does not hold
        return 1.0
    grows = lambda x: float((share * np.exp(x * score)).sum()) > 1
    high = 1.0
    while not grows(high) and high < 1e3:
        high *= 2
    low = high / 1e9
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if grows(mid) else (mid, high)
    return low


def size_of(score: np.ndarray, count: np.ndarray, tokens_n: int, rate: float) -> float:
    """K, so that K n exp(-lambda x) segments of x or more, the quantile TAIL, are expected in n clean tokens. score ascends."""
    if not len(score) or not tokens_n:
        return 1.0
    above = np.cumsum(count[::-1])[::-1]
    k = int(np.flatnonzero(above >= above[0] * (1 - TAIL))[-1])
    return float(above[k] / tokens_n * math.exp(min(700.0, rate * score[k])))


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and level of a logistic curve by damped Newton steps."""
    scale = max(1e-9, float(np.abs(x).max(initial=0.0)))
    a = np.column_stack([x / scale, np.ones(len(x))])
    t = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ t, -40, 40)))
        g = a.T @ (p - y) + ridge * t
        h = (a * (p * (1 - p))[:, None]).T @ a + np.eye(2) * ridge
        step = np.linalg.solve(h, g)
        t -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return float(t[0] / scale), float(t[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toArrow()
    if not ids.num_rows:
        return Model()
    picked = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(spark.createDataFrame(ids)), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    picked = checkpointed(picked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, BUCKETS), np.int64)  # tokens of clean and toxic texts, and clean and toxic texts
        for batch in batches:
            texts, y = text_column(batch), batch.column(1).to_numpy().astype(np.int64)
            for a, b in slices(texts):
                bucket, starts = buckets_of(texts[a:b])
                text = np.repeat(np.arange(b - a), np.diff(starts))
                both, times = np.unique(text * BUCKETS + bucket, return_counts=True)
                which, at = y[a:b][both // BUCKETS], both % BUCKETS
                np.add.at(total, (which, at), times)
                np.add.at(total, (which + 2, at), 1)
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(c) for c in total[:, some])], names=["bucket", "c0", "c1", "c2", "c3"])

    kinds = "bucket int, c0 long, c1 long, c2 long, c3 long"
    counted = picked.mapInArrow(count, kinds).groupBy("bucket").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(4))).toArrow()  # BUCKETS rows at most
    counts = np.zeros((4, BUCKETS))
    for k in range(4):
        counts[k, counted["bucket"].to_numpy()] = counted[f"c{k}"].to_numpy()
    clean = counts[0]
    if not clean.any() or not counts[1].any():
        return Model()
    odds = log_odds(*counts)
    model = Model(odds.astype(np.float32), rate_of(odds, clean))
    shared = spark.sparkContext.broadcast(model)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in batches:
            for found, _, _ in shared.value.found(text_column(batch)):
                for x in found:
                    k = math.floor(x[2] * 100)
                    counts[k] = counts.get(k, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["score", "n"])

    rows = picked.where("toxic = 0").mapInArrow(histogram, "score long, n long").groupBy("score").agg(F.sum("n").alias("n")).orderBy("score").toArrow()
    model.size = size_of(rows["score"].to_numpy() / 100, rows["n"].to_numpy(), int(clean.sum()), model.rate)
    shared = spark.sparkContext.broadcast(model)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = [m.statistic(own, n) for _, own, n in m.found(text_column(batch))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], names=["x", "y"])

    rows = picked.mapInArrow(rated, "x double, y int").toArrow()  # two numbers a document of the sample
    model.slope, model.level = curve(np.log1p(rows["x"].to_numpy()), rows["y"].to_numpy().astype(float))
    return model


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and every significant passage: (first, last word, score) of each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            score, spans = [], []
            for found, own, n in m.found(text_column(batch)):
                score.append(m.probability(m.statistic(own, n)))
                spans.append([{"first": a, "last": b, "score": s} for a, b, s in m.significant(found, n)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, passages array<struct<first: long, last: long, score: double>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: labels of the held-out fifth are not learned from."""
    docs = docs.select("doc_id", "text")
    away = held_out(F.col("doc_id"), 5, 0)
    model = train(docs, labels.select("doc_id", "toxic").where(~away))
    return passages(docs, model).select("doc_id", away.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")

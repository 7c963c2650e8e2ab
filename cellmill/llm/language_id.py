"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled texts in Spark: about
SAMPLE texts of each of at most LANGUAGES languages (the most frequent ones).
The log-probability matrix (buckets x languages, CELLS at most: very many
languages get fewer buckets) is broadcast, and batches are scored in numpy by
gathering rows of it and summing them by text.

Defined cases: a null text or one without a letter is ``und`` with score 0;
so is every text if nothing is labelled. Ties go to the language that sorts
first. Rows are scored one by one, so repeated rows and ids repeat results.
Texts are scored whole, SLICE characters at a time, cut at blanks (a word of
more characters is cut). All other columns are kept, but for those that the
result replaces.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, held_out, slices

#: n-gram lengths, buckets of each length, and about how many texts of each language are learned from.
LENGTHS, BUCKETS, SAMPLE = (1, 2, 3), 1 << 15, 3000
#: Languages that are learned, and entries of the matrix and of what is gathered from it at once, at most.
LANGUAGES, CELLS = 4096, 1 << 24
#: A posterior weighs at most so many n-grams, else every longer text has a score of 1.
EVIDENCE = 60
#: Characters of text that are scored at once.
SLICE = 1 << 18
_fold: list[np.ndarray] = []


def fold() -> np.ndarray:
    """Code point to lower-case letter, 0 for all that are no letters."""
    if not _fold:
        out = np.zeros(sys.maxunicode + 1, np.uint32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if unicodedata.category(c)[0] == "L":
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _fold.append(out)
    return _fold[0]


def pieces(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """All of the texts in groups of about SLICE characters: pieces, and the index of the text of each."""
    some: list[str] = []
    owner: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        at, text = 0, text or ""
        while True:
            to = len(text)
            if to - at > SLICE:
                blank = text.rfind(" ", at, at + SLICE)
                to = blank if blank > at else at + SLICE
            some.append(text[at:to])
            owner.append(i)
            size += to - at + 1
            at = to
            if size >= SLICE:
                yield some, np.array(owner)
                some, owner, size = [], [], 0
            if at >= len(text):
                break
    if some:
        yield some, np.array(owner)


def features(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (rows of the matrix) of all texts and the index of the text of each. Words are padded with one blank; n-grams start or end with a letter."""
    joined = " " + " ".join(t or "" for t in texts) + " "
    points = fold()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    owner = np.searchsorted(ends, np.arange(len(points)), side="left")  # a blank belongs to the text before it
    keep = points > 0
    keep[1:] |= points[:-1] > 0  # one blank after each word
    keep[0] = True
    x, owner = points[keep].astype(np.uint64), owner[keep]
    rows, whose = [], []
    for k, n in enumerate(LENGTHS):
        if len(x) < n:
            continue
        h = np.zeros(len(x) - n + 1, np.uint64)
        inner = np.ones(len(h), bool)
        for j in range(n):
            c = x[j : len(x) - n + 1 + j]
            h = h * np.uint64(0x100000001B3) + c + np.uint64(1)
            if 0 < j < n - 1:
                inner &= c > 0  # never over two words
        inner &= x[n - 1 :] > 0 if n == 1 else (x[: len(h)] > 0) | (x[n - 1 :] > 0)
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - buckets.bit_length())
        mine = owner[: len(h)] if n == 1 else np.where(x[: len(h)] > 0, owner[: len(h)], owner[1 : len(h) + 1])  # of the first letter
        rows.append((h[inner] + np.uint64(k * buckets)).astype(np.int64))
        whose.append(mine[inner])
    return (np.concatenate(rows), np.concatenate(whose)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def buckets_for(langs: int) -> int:
    """Buckets of each n-gram length, a power of two, so that the matrix has CELLS entries at most."""
    return min(BUCKETS, 1 << ((CELLS // (len(LENGTHS) * max(1, langs))).bit_length() - 1))


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log probabilities; the last row holds log priors. docs: text, lang, and an id to sample by."""
    spark = docs.sparkSession
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    found = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    langs = sorted(found)
    buckets = buckets_for(len(langs))
    if not langs:
        return [], np.zeros((len(LENGTHS) * buckets + 1, 0), np.float32)
    rates = spark.createDataFrame([(k, number, min(1.0, sample / found[k]) * 1e6) for number, k in enumerate(langs)], "lang string, number int, rate double")
    taken = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_000)) < F.col("rate")
    chosen = labelled.join(F.broadcast(rates), "lang").where(taken).select("text", "number")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), len(LENGTHS) * buckets), np.int64)
        for batch in batches:
            number = batch.column(1).to_numpy()
            for a, b in slices(batch.column(0), SLICE):
                for some, owner in pieces(batch.column(0)[a:b].to_pylist()):
                    rows, whose = features(some, buckets)
                    flat, n = np.unique(number[a:b][owner[np.minimum(whose, len(some) - 1)]].astype(np.int64) * total.shape[1] + rows, return_counts=True)
                    total.ravel()[flat] += n
        k, row = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(row.astype(np.int32)), pa.array(total[k, row])], names=["k", "row", "n"])

    counted = chosen.mapInArrow(count, "k int, row int, n long").groupBy("k", "row").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    counts = np.full((len(LENGTHS) * buckets, len(langs)), 0.1, np.float32)
    counts[counted["row"].to_numpy(), counted["k"].to_numpy()] += counted["n"].to_numpy()
    for k in range(len(LENGTHS)):
        part = slice(k * buckets, (k + 1) * buckets)
        counts[part] = np.log(counts[part]) - np.log(counts[part].sum(axis=0, dtype=np.float64))
    prior = np.log(np.array([found[k] for k in langs]) / sum(found.values()))
    return langs, np.vstack([counts, prior]).astype(np.float32)


def score(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    buckets = (len(matrix) - 1) // len(LENGTHS)
    count, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(langs)))
    step = max(1, CELLS // 8 // max(1, len(langs)))
    for some, owner in pieces(texts):
        rows, whose = features(some, buckets)
        inside = whose < len(some)
        rows, whose = rows[inside], owner[whose[inside]]
        order = np.argsort(whose, kind="stable")
        rows, whose = rows[order], whose[order]
        count += np.bincount(whose, minlength=len(texts))
        for at in range(0, len(rows) if langs else 0, step):
            own = whose[at : at + step]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sums[own[first]] += np.add.reduceat(matrix[rows[at : at + step]], first, axis=0, dtype=np.float64)
    best, value = ["und"] * len(texts), np.zeros(len(texts))
    some = np.flatnonzero(count)
    if len(some) and langs:
        sums = sums[some]
        z = sums * np.minimum(1.0, EVIDENCE / count[some])[:, None] + matrix[-1]
        top = (sums + matrix[-1]).argmax(axis=1)
        z -= z.max(axis=1, keepdims=True)
        post = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        for i, j, p in zip(some.tolist(), top.tolist(), post[np.arange(len(some)), top].tolist(), strict=True):
            best[i], value[i] = langs[j], p
    return best, value


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with a predicted language and its score under `names` (older columns of these names go); all others are kept."""
    langs, shared = model[0], docs.sparkSession.sparkContext.broadcast(model[1])
    kept = docs.drop(*names)
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, values = [], []
            for a, b in slices(batch.column(at), SLICE):
                x, y = score(batch.column(at)[a:b].to_pylist(), langs, shared.value)
                best += x
                values.append(y)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(np.concatenate(values) if values else np.zeros(0))], names=[*batch.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{kinds}, `{names[0]}` string, `{names[1]}` double")


def language_id(docs: DataFrame) -> DataFrame:
    """The contract's rows: learn from ids outside the held-out fifth, predict for all."""
    docs = docs.select("doc_id", "text", "lang")
    away = held_out(F.col("doc_id"), 5, 0)
    model = train(docs.where(~away))
    return identify(docs.select("doc_id", "text", away.alias("held_out")), model).drop("text")


def known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs whose language is recognised (not und, score of `least` or more), learned from their own labels; all columns are kept."""
    language, sure = free_names(docs.columns, "language", "sure")
    rows = identify(docs, train(docs), (language, sure))
    return rows.where((F.col(language) != "und") & (F.col(sure) >= least)).drop(language, sure)

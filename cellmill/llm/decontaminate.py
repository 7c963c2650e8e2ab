"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select WEIGHT of some neighbouring words, so that a seed survives
substitutions at the places a mask ignores. Seeds of benchmark items are put
into a sorted table; all seeds of every document are joined to it, and around
each hit the item is laid over the document and compared word by word.

A document holds an item if some contiguous stretch of the overlap has a share
of SHARE equal words and `needed` of them: EQUAL, of items of fewer words the
share of all, SHORTEST at least. The masks lose nothing: for every item length
from SHORTEST words and every placement of substitutions that the rule allows
within the shortest such stretch, one of them lies on equal words only (tests
go through all placements). Items of fewer than SHORTEST words say nothing
inside a longer text; they count where they are the whole text.

The benchmark is broadcast in blocks of at most BLOCK_BYTES of text, so a
larger benchmark takes more passes, not more memory.

Defined cases: null texts are empty; items without words say nothing; rows
that repeat an id are judged one by one, of one id and item the best overlap
is kept (ties: the last place); long texts are looked up STEP words at a time;
no rows give no rows; the stage keeps all columns and judges each row by its
own text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_names, mix, raw, slices, text_column, text_hash, tokens

# The masks; 1 is a word that must be equal. All placements for 5 to 17 words have one that fits.
MASKS = ("10111", "111001", "1001011", "10100011", "1100101")
SHORTEST, BLOCK_BYTES = 5, 16 << 20
#: Equal words and share of equal words that count.
EQUAL, SHARE = 12, 0.7
#: Words of documents that are looked up, and places that are compared at once; ids that are broadcast at most.
STEP, COMPARED, FEW = 1 << 17, 1 << 21, 1_000_000


def needed(n: int, equal: int = EQUAL, share: float = SHARE) -> int:
    """Equal words that an item of n words must have in one stretch."""
    return min(n, equal, max(SHORTEST, math.ceil(share * n - 1e-9)))


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked words from each place on."""
    n = len(words) - len(mask) + 1
    h = np.full(max(0, n), len(mask) * 1000003 + int(mask, 2), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1" and n > 0:
            h = (h ^ words[j : j + n]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
    return mix(h)


class Table:
    """Seeds of a block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str], equal: int = EQUAL, share: float = SHARE) -> None:
        data, offs = raw(pa.array(texts, pa.string()))
        h, _, starts = tokens(data, offs)
        self.ids, self.words, self.starts = ids, h, starts
        self.length = np.diff(starts)
        self.needed = np.array([needed(n, equal, share) for n in self.length.tolist()], np.int64)
        self.masks = [*MASKS, *("1" * n for n in range(1, SHORTEST + 1) if (self.length == n).any())]
        hashes, item, place = [], [], []
        for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            for m in self.masks:
                if b - a == len(m) if "0" not in m else b - a > SHORTEST:
                    own = seeds(h[a:b], m)
                    hashes.append(own)
                    item.append(np.full(len(own), i))
                    place.append(np.arange(len(own)))
        hashes, item, place = (np.concatenate(c) if c else np.zeros(0, k) for c, k in ((hashes, np.uint64), (item, np.int64), (place, np.int64)))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]
        self.bits = max(16, min(26, int(len(hashes) * 16).bit_length()))
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, starts: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Distinct (text, item, diagonal) of seeds that start at words lo to hi: an item's first word would be at word `diagonal`."""
        out = []
        for m in self.masks:
            h = seeds(words[lo : hi + len(m) - 1], m)
            at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
            text = np.searchsorted(starts, at + lo, side="right") - 1
            inside = at + lo + len(m) <= starts[text + 1]
            if len(m) < SHORTEST:
                inside &= starts[text + 1] - starts[text] == len(m)  # short items count as whole texts only
            at, text = at[inside], text[inside]
            a, b = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            n = b - a
            k = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append(np.column_stack([np.repeat(text, n), self.item[k], np.repeat(at + lo, n) - self.place[k]]))
        return np.unique(np.concatenate(out), axis=0)

    def likely(self, words: np.ndarray, starts: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Those hits whose item has enough equal words anywhere on the diagonal."""
        ends = np.cumsum(self.length[hits[:, 1]]) if len(hits) else np.zeros(0, np.int64)
        at = 0
        while at < len(hits):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + COMPARED, side="right")))
            text, item, diagonal = hits[at:to].T
            n = self.length[item]
            first = np.cumsum(n) - n
            step = np.arange(n.sum()) - np.repeat(first, n)
            p = np.repeat(diagonal, n) + step
            inside = (p >= np.repeat(starts[text], n)) & (p < np.repeat(starts[text + 1], n))
            same = inside & (words[np.where(inside, p, 0)] == self.words[np.repeat(self.starts[item], n) + step])
            enough = np.add.reduceat(same.astype(np.int64), first) >= self.needed[item]
            yield from hits[at:to][enough].tolist()
            at = to


def overlap(same: np.ndarray, share: float = SHARE) -> tuple[int, int, int]:
    """Equal words, first and last place (past the end) of the stretch with most equal words among those of `share` equal words or more."""
    if not same.any():
        return 0, 0, 0
    sums = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - share, -share))])
    equal = np.concatenate([[0], np.cumsum(same)])
    least = np.minimum.accumulate(sums)
    start = np.searchsorted(-least, -sums - 1e-9, side="left")  # the first place whose sum is no larger
    end = int((equal - equal[start]).argmax())
    at = np.flatnonzero(same[start[end] : end]) + start[end]
    return len(at), int(at[0]), int(at[-1]) + 1


def found_in(docs: DataFrame, benchmark: DataFrame, equal: int, share: float) -> DataFrame:
    """doc_id, t (hash of the text), item_id, equal, coverage, first_word, end_word of each overlap that counts."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = size // BLOCK_BYTES + 1
    rows = docs.select("doc_id", text_hash().alias("t"), "text")

    def one(k: int) -> DataFrame:
        block = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        shared = spark.sparkContext.broadcast(Table(block["item_id"].to_pylist(), block["text"].to_pylist(), equal, share))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for batch in batches:
                texts, ids, ties = text_column(batch), batch.column(0), batch.column(1)
                best: dict[tuple, tuple] = {}
                for lo, hi in slices(texts):
                    h, _, starts = tokens(*raw(texts[lo:hi]))
                    for at in range(0, len(h), STEP):
                        for t, i, d in table.likely(h, starts, table.hits(h, starts, at, min(at + STEP, len(h)))):
                            own, n = int(starts[t]), int(table.length[i])
                            a, b = max(own, d), min(int(starts[t + 1]), d + n)
                            item = int(table.starts[i]) - d
                            same, first, end = overlap(h[a:b] == table.words[item + a : item + b], share)
                            if same >= table.needed[i]:
                                key = (lo + t, table.ids[i])
                                best[key] = max(best.get(key, (0, 0.0, 0, 0)), (same, same / n, a + first - own, a + end - own))
                row = pa.array([r for r, _ in best], pa.int64())
                cols = list(zip(*((i, *v) for (_, i), v in best.items()), strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([ids.take(row), ties.take(row), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "t", "item_id", "equal", "coverage", "first_word", "end_word"])

        return rows.mapInArrow(run, "doc_id long, t long, item_id long, equal long, coverage double, first_word long, end_word long")

    return reduce(DataFrame.unionAll, [one(k) for k in range(blocks)])


def contaminated(docs: DataFrame, benchmark: DataFrame, equal: int = EQUAL, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, equal, coverage (equal words of the item's words), first_word and end_word: the best overlap of each document and item."""
    found = found_in(docs, benchmark, equal, share)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("equal", "coverage", "first_word", "end_word")).alias("x")).select("doc_id", "item_id", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame, equal: int = EQUAL, share: float = SHARE) -> DataFrame:
    """docs without the rows whose text holds a benchmark passage, with all their columns."""
    t, d, h = free_names(docs.columns, "t", "d", "h")
    bad = found_in(docs, benchmark, equal, share).select(F.col("doc_id").alias(d), F.col("t").alias(h)).distinct()
    bad = checkpointed(bad.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism))  # two numbers a document that goes
    bad = F.broadcast(bad) if bad.count() <= FEW else bad
    whole = docs.withColumn(t, text_hash())
    return whole.join(bad, whole["doc_id"].eqNullSafe(bad[d]) & (whole[t] == bad[h]), "left_anti").drop(t)

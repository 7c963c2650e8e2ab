"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles; a link is a Jaccard likeness of 0.8
or more.

1. One pass gives each text a content hash (exact copies collapse into one
   representative) and the keys of BANDS bands of ROWS MinHash values. At a
   likeness of 0.8 a pair shares no band with a probability under 1e-5.
2. Texts that share a band key are tied by star edges to the least of them;
   connected components of those edges are the groups within which links can
   be. A group's texts are dealt out in small blocks, and each pair of blocks
   is one unit of work, so no task holds an unbounded group and no pair of a
   group is emitted as a row.
3. Within a unit, pairs that share a band compare MinHash values in steps. A
   pair is dropped once the posterior probability (uniform prior) that its
   likeness reaches the threshold falls below TOLERANCE; the rest is verified
   on the whole shingle sets. A unit returns the number of links of each text
   and a star of each class it sees.
4. Components of the stars are the classes.

Result: doc_id, class_id (the least doc_id of the class), n_links (other
documents that are linked to it, copies counted), n_copies (of its text).

Defined cases: words are lower-cased runs of letters, digits and non-ASCII
characters; a text of fewer than five words is one shingle; a text without
words is like its exact copies only; a null text is empty; a null id sorts
last and names no class if another id is there; rows that repeat an id are
separate documents with that id, told apart by a hash of their texts. Columns
other than doc_id and text do not matter, and the stage keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_names, free_shuffles, kept, mix, raw, shingle_hashes, slices, text_column, text_hash, tokens
from .graph import components

SHINGLE, LIKENESS, BANDS, ROWS, STEP, TOLERANCE = 5, 0.8, 30, 5, 30, 1e-7
#: Texts and shingles that a block holds on average at most; blocks of large groups hold up to LARGER times as much, as each text goes along with every other block of its group.
BLOCK_TEXTS, BLOCK_SHINGLES, LARGER = 256, 64_000, 16
_rng = np.random.default_rng(5)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts and n + 1 offsets; every text has one at least."""
    data, offs = raw(texts)
    words, _, starts = tokens(data, offs)
    h, at = shingle_hashes(words, starts, SHINGLE)
    empty = np.flatnonzero(np.diff(at) == 0)
    if len(empty):
        import xxhash

        own = np.array([xxhash.xxh64_intdigest(data[offs[i] : offs[i + 1]].tobytes(), seed=9) for i in empty], np.uint64)
        h = np.insert(h, at[empty], own)
        at = at + np.concatenate([[0], np.cumsum(np.isin(np.arange(len(at) - 1), empty))])
    return h, at


def minhashes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of BANDS * ROWS MinHash values (32 bits) a text."""
    out = np.empty((len(at) - 1, BANDS * ROWS), np.uint32)
    if not len(out):
        return out
    for j in range(BANDS * ROWS):
        least = np.minimum.reduceat(h * _A[j] + _B[j], at[:-1])
        out[:, j] = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key.view(np.int64)


def content_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Order-free hash of a text's shingles, repeats counted."""
    if len(at) < 2:
        return np.zeros(0, np.int64)
    return mix(np.add.reduceat(mix(h), at[:-1]) + np.diff(at).astype(np.uint64)).view(np.int64)


def least_matches(threshold: float = LIKENESS, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values, the fewest matches with which the posterior of reaching the threshold is above the tolerance."""
    grid = (np.arange(200_000) + 0.5) / 200_000
    above, out = grid >= threshold, {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[above].sum() > tolerance * p.sum():
                out[n] = m
                break
    return out


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), k (content), n (shingles), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, (ids, t) = text_column(batch), batch.columns[:2]
            for a, b in slices(texts):
                h, at = shingles(texts[a:b])
                keys = band_keys(minhashes(h, at))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids[a:b], t[a:b], pa.array(content_keys(h, at)), pa.array(np.diff(at)), bands], names=["doc_id", "t", "k", "n", "bands"])

    return docs.select("doc_id", text_hash().alias("t"), "text").mapInArrow(run, "doc_id long, t long, k long, n long, bands array<long>")


def linked(first: list[int], second: list[int], sets: list[np.ndarray], signature: np.ndarray, copies: np.ndarray, floors: dict[int, int]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each text, and of each linked text its root among them, of the pairs of one block (first is second) or two."""
    links = np.zeros(len(sets), np.int64)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    bands = band_keys(signature)
    size = np.array([len(s) for s in sets])
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    offs = np.concatenate([[0], np.cumsum(size)])
    flag = np.zeros(len(vocabulary), bool)
    other = np.array(second, np.int64)
    for x, i in enumerate(first):
        js = other[x + 1 :] if first is second else other
        js = js[(bands[js] == bands[i]).any(axis=1)]
        js = js[np.minimum(size[js], size[i]) >= LIKENESS * np.maximum(size[js], size[i])]
        same = np.zeros(len(js), np.int64)
        for n, least in floors.items():
            same += (signature[js, n - STEP : n] == signature[i, n - STEP : n]).sum(axis=1)
            js, same = js[same >= least], same[same >= least]
        if not len(js):
            continue
        flag[ids[offs[i] : offs[i + 1]]] = True
        many = size[js]
        at = np.repeat(offs[js] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        common = np.add.reduceat(flag[ids[at]].astype(np.int64), np.cumsum(many) - many)
        flag[ids[offs[i] : offs[i + 1]]] = False
        js = js[common >= LIKENESS * (many + size[i] - common) - 1e-9]
        links[i] += copies[js].sum()
        links[js] += copies[i]
        for j in js.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return links, [(i, find(i)) for i in np.flatnonzero(links).tolist()]


def verify(units: DataFrame) -> DataFrame:
    """a, b, links: links of text a (b null), or the root b of a's class in this unit. units: text, k, copies, comp, i, j, own; sorted by comp, i, j, k."""
    floors = least_matches()

    def solve(rows: list[tuple], i: int, j: int) -> pa.RecordBatch:
        texts = pa.array([r[0] for r in rows], pa.string())
        sets, signature = [], []
        for a, b in slices(texts):
            h, at = shingles(texts[a:b])
            signature.append(minhashes(h, at))
            sets += [np.unique(h[at[x] : at[x + 1]]) for x in range(b - a)]
        k, copies = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])  # in order of k, so that a class's root is its least key
        one = [x for x, r in enumerate(rows) if r[3] == i]
        two = one if i == j else [x for x, r in enumerate(rows) if r[3] == j]
        links, forest = linked(one, two, sets, np.concatenate(signature), copies, floors)
        some = np.flatnonzero(links)
        a = np.concatenate([k[some], k[[x for x, _ in forest]]]) if len(some) else np.zeros(0, np.int64)
        b = [None] * len(some) + [int(k[y]) for _, y in forest]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*links[some].tolist(), *[0] * len(forest)], pa.int64())], names=["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_TEXTS):  # few rows as Python objects at a time
                for text, k, copies, comp, i, j, own in zip(*(c.to_pylist() for c in batch.slice(at, BLOCK_TEXTS).columns), strict=True):
                    if (comp, i, j) != now:
                        if len(rows) > 1:
                            yield solve(rows, now[1], now[2])
                        now, rows = (comp, i, j), []
                    rows.append((text, k, copies, own))
        if len(rows) > 1:
            yield solve(rows, now[1], now[2])

    return units.mapInArrow(run, "a long, b long, links long")


def units_of(docs: DataFrame, member: DataFrame) -> DataFrame:
    """Units of work (as verify takes them) of member: rep, k, copies, comp, blocks. docs: doc_id, text."""
    least = F.lit(-(1 << 63))
    rows = docs.select(F.coalesce("doc_id", least).alias("d"), text_hash().alias("h"), "text")
    named = member.select(F.coalesce("rep.doc_id", least).alias("d"), F.col("rep.t").alias("h"), F.col("rep.rows").alias("rows"), "k", "copies", "comp", "blocks")
    texts = rows.join(named.where("rows = 1"), ["d", "h"])
    if not named.where("rows > 1").isEmpty():  # rows that repeat an id and a text: one of them is enough
        texts = texts.unionByName(rows.join(named.where("rows > 1"), ["d", "h"]).dropDuplicates(["k"]))
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("k"), F.col("blocks"))).otherwise(0)
    texts = texts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return texts.select("text", "k", "copies", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, t, rep (what stands for the class: none (no id), doc_id, t, rows), n_links, n_copies of every row of docs (doc_id, text)."""
    base = kept(sign(docs))
    rows = base.count()
    same = base.groupBy("k", "doc_id", "t").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"))
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "rows")
    texts = checkpointed(same.groupBy("k").agg(F.min(rep).alias("rep"), F.sum("rows").alias("copies"), F.max("n").alias("n")), rows)
    keys = base.select("k", F.explode("bands").alias("band"))
    stars = checkpointed(keys.groupBy("band").agg(F.min("k").alias("least"), F.max("k").alias("most")).where("least < most").select("band", "least"), rows * BANDS)
    edges = keys.join(stars, "band").where("k <> least").select(F.col("k").alias("a"), F.col("least").alias("b")).distinct()
    groups = components(edges, rows, rows * BANDS)

    member = texts.join(groups, texts["k"] == groups["node"]).select("rep", "k", "copies", "n", F.col("root").alias("comp"))
    many = F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum("n") / BLOCK_SHINGLES)
    sizes = checkpointed(member.groupBy("comp").agg(F.ceil(many / F.greatest(F.lit(1.0), F.least(F.lit(float(LARGER)), many / LARGER))).alias("blocks")), rows)
    units = units_of(docs, checkpointed(member.join(sizes, "comp"), rows))
    free_shuffles(docs.sparkSession)
    found = kept(verify(units.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "k")))

    roots = components(found.where(F.col("b").isNotNull()).select("a", "b"), rows, found.count())
    degree = found.where(F.col("b").isNull()).groupBy("a").agg(F.sum("links").alias("links"))
    named = texts.join(roots, texts["k"] == roots["node"], "left").join(degree, texts["k"] == degree["a"], "left").select("k", "rep", "copies", F.coalesce("root", "k").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    named = checkpointed(named, rows)
    least = checkpointed(named.groupBy("root").agg(F.min("rep").alias("least")), rows)
    found = named.join(least, "root").select("k", F.col("least").alias("rep"), (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    return base.join(found, "k").select("doc_id", "t", "rep", "n_links", "n_copies")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every document."""
    return classes(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", F.col("rep.doc_id").alias("class_id"), "n_links", "n_copies")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each class of near copies, that of the least id (of its texts, the one of the least hash); all columns are kept."""
    rows = classes(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    one = rows.where(F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("t") == F.col("rep.t"))).select("rep").distinct()
    one = checkpointed(one.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism))  # three numbers a class
    t, d, h = free_names(docs.columns, "t", "d", "h")
    whole = docs.withColumn(t, text_hash())
    stay = one.select(F.col("rep.doc_id").alias(d), F.col("rep.t").alias(h), F.col("rep.rows").alias("rows"))

    def of(chosen: DataFrame) -> DataFrame:
        return whole.join(chosen.drop("rows"), whole["doc_id"].eqNullSafe(chosen[d]) & (whole[t] == chosen[h]), "left_semi")

    out = of(stay.where("rows = 1"))
    if not stay.where("rows > 1").isEmpty():
        out = out.unionByName(of(stay.where("rows > 1")).dropDuplicates(["doc_id", t]))
    return out.drop(t)

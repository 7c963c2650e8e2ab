"""Suffix-array dedup: bytes of strings of LENGTH bytes that also start earlier in the corpus.

An enhanced suffix array of a whole corpus fits no task, so it is built over
sampled suffixes, bucket by bucket, without losing a match:

1. Every string of LENGTH bytes owns an anchor, the leftmost of its KGRAM-byte
   grams with the least hash. Equal strings own equal anchors at equal offsets,
   and neighbouring strings share anchors (about one anchor per 35 bytes).
   An anchor carries the stretch of strings that own it.
2. Anchors are dealt out by hash of the gram. Stretches that are equal as a
   whole are one entry of the array: all but the earliest are removed at once.
   Repeats within a slice of input are settled before the shuffle, so a very
   common stretch sends one row a slice.
3. Of grams that more than one distinct stretch shares, the texts around the
   anchors are fetched and sorted as suffixes; a stack scan over their common
   prefixes gives the interval tree. Each interval's occurrences are split by
   what they extend to on the left; where extensions differ, a maximal repeat
   ends, and its occurrences other than the first are removed. Lengths run
   from KGRAM to LENGTH, so the tree is no deeper than that. A gram of more
   contexts than one task may sort (MOST) is not gathered: the strings that own
   it are hashed, and the first place of each is pre-aggregated.

Order is by doc_id, then place. Matches never cross documents. Long texts are
worked on in pieces of PIECE bytes that overlap by a string's length.

Defined cases: a null text is empty and loses nothing; a null id comes first;
rows of one id and different texts are documents of their own, in order of a
hash of the text; rows that repeat an id and a text are one document, so they
are no copies of each other; texts shorter than LENGTH bytes lose nothing; no
documents give no rows; all other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _INV, _MULT, checkpointed, free_names, free_shuffles, mix, powers, raw, slices, text_column, text_hash

LENGTH, KGRAM = 100, 32
#: Contexts that are sorted at once (whole grams only), and the most contexts of one gram that one task may sort.
CHUNK, MOST = 8_000, 50_000
#: Bytes of text whose grams are hashed at once; repeated ids that are broadcast at most.
PIECE, FEW = 1 << 20, 1_000_000
_FIRST = -(1 << 63)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by running minima of blocks from both sides."""
    n = len(values) - width + 1
    pad = -len(values) % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = KGRAM) -> dict[str, np.ndarray]:
    """Of consecutive texts: text, place (x), gram (h), hash of the whole stretch (g), and the offsets (hi <= lo) at which strings own the anchor."""
    n = len(data)
    none = {c: np.zeros(0, np.int64) for c in ("text", "x", "h", "g", "lo", "hi")}
    if n < length:
        return none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_MULT, n), out=sums[1:])
    inverse = powers(_INV, n)
    grams = mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
    bits = np.uint64(max(22, n.bit_length()))
    least = sliding_least((grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), length - k + 1)
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: n - length + 1]
    inside = np.arange(n - length + 1) + length <= offs[1:][text]
    change = np.flatnonzero(inside & np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]]))
    if not len(change):
        return none
    stop = np.flatnonzero(inside & np.concatenate([(place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~inside[1:], [True]]))
    x = place[change]
    lo, hi = x - change, x - stop
    span = (sums[stop + length] - sums[change]) * inverse[change]
    g = mix(span + lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi.astype(np.uint64) << np.uint64(8)))
    return {"text": text[change], "x": x - offs[text[change]], "h": grams[x].view(np.int64), "g": g.view(np.int64), "lo": lo, "hi": hi}


def groups(contexts: list[bytes], left: list[int], gram: list[int], length: int = LENGTH) -> Iterator[tuple[list[int], int, int, int]]:
    """Maximal repeats of `length` bytes or more: (occurrences, right, least and most left) of each.

    contexts[i] holds left[i] bytes before an anchor and what follows it; only
    occurrences of equal gram are compared. A group's occurrences share
    `right` bytes from the anchor on and any number of bytes from `least` to
    `most` before it, and make up every string of `length` bytes at those
    offsets. This is the enhanced suffix array (sorted suffixes and common
    prefixes of neighbours) and a stack scan of its interval tree.
    """
    n = len(contexts)
    rows = np.zeros((n, length + 1), np.uint8)
    for i, (c, a) in enumerate(zip(contexts, left, strict=True)):
        right = c[a : a + length]
        rows[i, : len(right)] = np.frombuffer(right, np.uint8)
        rows[i, length] = len(right)  # not 0, and it sorts equal bytes by length
    order = np.lexsort((rows.view(f"S{length + 1}").ravel(), np.array(gram)))
    rows, gram = rows[order], np.array(gram)[order]
    same = rows[1:, :length] == rows[:-1, :length]
    prefix = np.where(same.all(axis=1), length, same.argmin(axis=1))
    prefix = np.minimum(prefix, np.minimum(rows[1:, length], rows[:-1, length]))
    prefix[gram[1:] != gram[:-1]] = 0
    order = order.tolist()

    def node(depth: int, above: int, first: int, last: int) -> Iterator[tuple[list[int], int, int, int]]:
        """Offsets length - depth to length - above - 1 belong to this interval."""
        some = [order[i] for i in range(first, last + 1)]
        at, top = max(0, length - depth), length - above - 1
        parts = {}
        for i in some:
            if left[i] >= at:
                parts.setdefault(contexts[i][left[i] - at : left[i]], []).append(i)
        work = [(at, p) for p in parts.values() if len(p) > 1]
        while work:
            at, p = work.pop()
            reach = min(min(left[i] for i in p), top)
            one = contexts[p[0]][: left[p[0]]][::-1]
            for i in p[1:]:
                other = contexts[i][: left[i]][::-1]
                if one[:reach] != other[:reach]:
                    reach = next(d for d in range(reach) if one[d] != other[d])
            yield p, depth, at, reach
            if reach < top:  # left extensions differ here
                finer = {}
                for i in p:
                    if left[i] > reach:
                        finer.setdefault(contexts[i][left[i] - reach - 1 : left[i]], []).append(i)
                work += [(reach + 1, q) for q in finer.values() if len(q) > 1]

    stack = [(0, 0)]  # depth and first row of open intervals
    for i, depth in enumerate([*prefix.tolist(), 0]):
        first = i
        while stack[-1][0] > depth:
            own, first = stack.pop()
            above = max(stack[-1][0], depth, 0)
            yield from node(own, above, first, i)
        if stack[-1][0] < depth:
            stack.append((depth, first))


def pieces(data: np.ndarray, offs: np.ndarray, limit: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes and offsets of texts, and where they start; a text longer than `limit` comes in pieces that hold each string once."""
    if len(offs) > 2 or len(data) <= limit + LENGTH:
        yield data, offs, 0
        return
    for at in range(0, len(data) - LENGTH + 1, limit):
        piece = data[at : at + limit + LENGTH - 1]
        yield piece, np.array([0, len(piece)]), at


def found_in(docs: DataFrame) -> DataFrame:
    """Anchors of all texts: doc, t, x, key (the gram), g, lo, hi, open; those that repeat within a slice have settled (not open) and are dealt anywhere. docs: doc, t, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, (ids, ties) = text_column(batch), (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b in slices(texts, PIECE):
                for data, offs, start in pieces(*raw(texts[a:b]), PIECE):
                    f = anchors(data, offs)
                    doc, tie, place = ids[a:b][f["text"]].astype(np.int64), ties[a:b][f["text"]].astype(np.int64), f["x"] + start
                    order = np.lexsort((place, tie, doc, f["g"], f["h"]))
                    h, g, d, t, x = f["h"][order], f["g"][order], doc[order], tie[order], place[order]
                    new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])[: len(h)]
                    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
                    again = (d != d[first]) | (t != t[first]) | (x != x[first])
                    key = np.where(again, mix(d.view(np.uint64) * np.uint64(31) + x.view(np.uint64)).view(np.int64), h)
                    back = np.lexsort((x, f["text"][order]))  # rows of one text together, which compresses better
                    cols = [d, t, x.astype(np.int32), key, np.where(again, 0, g), f["lo"][order].astype(np.int8), f["hi"][order].astype(np.int8), ~again]
                    yield pa.RecordBatch.from_arrays([pa.array(c[back]) for c in cols], names=["doc", "t", "x", "key", "g", "lo", "hi", "open"])

    return docs.select("doc", "t", "text").mapInArrow(run, "doc long, t long, x int, key long, g long, lo byte, hi byte, open boolean")


def settle(dealt: DataFrame) -> DataFrame:
    """doc, t, first, end of removed bytes (h null), or an entry (doc, t, first: its place, h, lo, hi) whose gram has other entries.

    dealt is sorted by key, g, doc, t, x; only the entry and the gram at hand are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"doc": pa.int64(), "t": pa.int64(), "first": pa.int32(), "end": pa.int32(), "h": pa.int64(), "lo": pa.int8(), "hi": pa.int8()}
        last: tuple | None = None  # h, g, doc, t, x of the entry at hand
        held, many = None, False  # a gram's only entry so far; whether the gram at hand has more

        def out(*cols) -> pa.RecordBatch:
            none = [None] * len(cols[0])
            return pa.RecordBatch.from_arrays([pa.array(none if c is None else c, k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))

        for batch in batches:
            doc, t, x, g, lo, hi = (batch.column(i).to_numpy() for i in (0, 1, 2, 4, 5, 6))
            known = batch.column(7).to_numpy(zero_copy_only=False)
            if not len(x):
                continue
            x, lo, hi = x.astype(np.int64), lo.astype(np.int64), hi.astype(np.int64)
            gone = lambda k: out(doc[k], t[k], x[k] - lo[k], x[k] - hi[k] + LENGTH, None, None, None)  # noqa: B023, E731
            rest = np.flatnonzero(~known)
            if len(rest):
                yield gone(rest)
            at = np.flatnonzero(known)
            if not len(at):
                continue
            h = batch.column(3).to_numpy()[at]
            doc, t, x, g, lo, hi = doc[at], t[at], x[at], g[at], lo[at], hi[at]
            new = np.concatenate([[last is None or (h[0], g[0]) != last[:2]], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
            fd, ft, fx = doc[first], t[first], x[first]
            fd[first < 0], ft[first < 0], fx[first < 0] = last[2:] if last else (0, 0, 0)
            again = (doc != fd) | (t != ft) | (x != fx)
            if again.any():
                yield gone(np.flatnonzero(again))
            entry = np.flatnonzero(new)
            same = np.concatenate([[last is not None and len(entry) > 0 and h[entry[0]] == last[0]], h[entry[1:]] == h[entry[:-1]]])[: len(entry)]
            shared = same | np.concatenate([same[1:], [False]])[: len(entry)]
            if len(entry):
                if same[0] and held is not None:
                    yield out(*([v] for v in held))
                if same[0]:
                    held, many = None, True
                alone = not shared[-1] and not (same[-1])
                k = entry[shared]
                if len(k):
                    yield out(doc[k], t[k], x[k], None, h[k], lo[k], hi[k])
                e = entry[-1]
                held, many = ((doc[e], t[e], x[e], None, h[e], lo[e], hi[e]), False) if alone else (None, True)
            last = (h[-1], g[-1], fd[-1], ft[-1], fx[-1])

    return dealt.mapInArrow(run, "doc long, t long, first int, end int, h long, lo byte, hi byte")


def around(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """h, doc, t, x, before and the bytes around each entry (doc, t, first, h, lo, hi). texts: doc, t, text, one row of each."""
    part = (F.col("first") / PIECE).cast("int")
    gathered = entries.groupBy("doc", "t", part.alias("part")).agg(F.collect_list(F.struct("h", "first", "lo", "hi")).alias("entries"))
    start = F.greatest(F.col("part") * PIECE - LENGTH, F.lit(0))
    rows = texts.join(gathered, ["doc", "t"]).select("doc", "t", start.alias("start"), F.substring(F.col("text").cast("binary"), start + 1, F.lit(PIECE + 2 * LENGTH)).alias("data"), "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, t, start, data, lists = batch.columns
            many = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), many)
            h, first, lo, hi = lists.flatten().flatten()
            a = first.to_numpy() - lo.to_numpy() - start.to_numpy()[owner]
            b = a + lo.to_numpy().astype(np.int64) - hi.to_numpy() + LENGTH
            cut, held, of = [], b"", -1
            for i, x, y in zip(owner.tolist(), a.tolist(), b.tolist(), strict=True):
                if i != of:
                    held, of = data[i].as_py(), i
                cut.append(held[x:y])
            yield pa.RecordBatch.from_arrays([h, doc.take(pa.array(owner)), t.take(pa.array(owner)), first, lo.cast(pa.int32()), pa.array(cut, pa.binary())], names=["h", "doc", "t", "x", "before", "bytes"])

    return rows.mapInArrow(run, "h long, doc long, t long, x int, before int, bytes binary")


def repeats(sorted_contexts: DataFrame) -> DataFrame:
    """doc, t, first, end of what the maximal repeats of each gram remove. Rows come sorted by h."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        where = [r[1:4] for r in rows]
        out = set()
        for some, _, least, most in groups([r[5] for r in rows], [r[4] for r in rows], [r[0] for r in rows]):
            first = min(where[i] for i in some)
            out.update((*where[i], least, most) for i in some if where[i] != first)
        cols = list(zip(*((d, t, x - most, x - least + LENGTH) for d, t, x, least, most in out), strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["doc", "t", "first", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= CHUNK and rows[-1][0] != r[0]:
                    yield solve(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield solve(rows)

    return sorted_contexts.mapInArrow(run, "doc long, t long, first int, end int")


def windows(contexts: DataFrame) -> DataFrame:
    """w, doc, t, start: every string of LENGTH bytes that a context's text owns, by a 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, doc, tie, start = [], [], [], []
            for _, d, t, x, before, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i in range(len(data) - LENGTH + 1):
                    w.append(hashlib.blake2b(data[i : i + LENGTH], digest_size=16).digest())
                    doc.append(d)
                    tie.append(t)
                    start.append(x - before + i)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(doc, pa.int64()), pa.array(tie, pa.int64()), pa.array(start, pa.int32())], names=["w", "doc", "t", "start"])

    return contexts.mapInArrow(run, "w binary, doc long, t long, start int")


def repeats_of_common(contexts: DataFrame) -> DataFrame:
    """doc, t, first, end of what grams of over MOST contexts remove: their strings are hashed and the first place of each is pre-aggregated, so no task gathers a gram."""
    every = windows(contexts)
    place = F.struct("doc", "t", "start")
    first = every.groupBy("w").agg(F.min(place).alias("least"))
    later = every.join(first, "w").where(place != F.col("least"))
    return later.select("doc", "t", F.col("start").alias("first"), (F.col("start") + LENGTH).alias("end"))


def keyed(docs: DataFrame, doc: str, t: str) -> tuple[DataFrame, DataFrame]:
    """docs with the columns doc (id, a null as the least long) and t (0, or a hash of the text where an id has several texts); and doc, t, text of each document once."""
    whole = docs.withColumn(doc, F.coalesce("doc_id", F.lit(_FIRST)))
    h = text_hash()
    some = whole.groupBy(doc).agg(F.count(F.lit(1)).alias("rows"), F.min(h).alias("a"), F.max(h).alias("b")).where("rows > 1").select(doc, (F.col("a") != F.col("b")).alias(t))
    n = some.count()
    if n:
        some = checkpointed(some, n)
        several = F.broadcast(some) if n <= FEW else some
        whole = whole.join(several, doc, "left")
    else:
        whole = whole.withColumn(t, F.lit(None).cast("boolean"))
    text = F.coalesce("text", F.lit(""))
    tie = F.when(F.col(t), h).otherwise(F.lit(0).cast("long"))
    texts = whole.where(F.col(t).isNull()).select(F.col(doc).alias("doc"), tie.alias("t"), text.alias("text"))
    if n:
        texts = texts.unionByName(whole.where(F.col(t).isNotNull()).select(F.col(doc).alias("doc"), tie.alias("t"), text.alias("text")).dropDuplicates(["doc", "t"]))
    return whole.withColumn(t, tie), texts


def repeated_spans(texts: DataFrame) -> DataFrame:
    """doc, t, first, end: byte ranges to remove; they may overlap. texts: doc, t, text of each document."""
    dealt = found_in(texts).repartition("key").sortWithinPartitions("open", "key", "g", "doc", "t", "x")
    found = checkpointed(settle(dealt))
    del dealt
    free_shuffles(texts.sparkSession)
    open_ = found.where(F.col("h").isNotNull())
    common = open_.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST).select("h")
    removed = found.where(F.col("h").isNull()).select("doc", "t", "first", "end")
    if n := common.count():
        common = checkpointed(common, n)
        removed = removed.unionByName(checkpointed(repeats_of_common(around(texts, open_.join(common, "h", "left_semi")))))
        open_ = open_.join(common, "h", "left_anti")
    more = checkpointed(repeats(around(texts, open_).repartition("h").sortWithinPartitions("h")))
    free_shuffles(texts.sparkSession)
    return removed.unionByName(more)


def with_spans(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column, of removable byte ranges (null: none), and its name."""
    doc, t, d, h, name = free_names(docs.columns, "doc", "t", "d", "h", "spans")
    whole, texts = keyed(docs, doc, t)
    spans = repeated_spans(texts).groupBy("doc", "t").agg(F.collect_list(F.struct("first", "end")).alias(name)).withColumnsRenamed({"doc": d, "t": h})
    return whole.join(spans, (whole[doc] == spans[d]) & (whole[t] == spans[h]), "left").drop(doc, t, d, h), name


def cut(data: bytes, first: np.ndarray, end: np.ndarray) -> tuple[bytes, int]:
    """What is left of data without the ranges first to end, and the number of maximal removed runs."""
    if not len(first):
        return data, 0
    order = np.argsort(first, kind="stable")
    a, b = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    starts, ends = a[new], b[np.concatenate([new[1:], [True]])]
    edges = [0, *np.column_stack([starts, ends]).ravel().tolist(), len(data)]
    return b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)), len(starts)


def cut_all(texts: pa.Array, spans: pa.Array) -> Iterator[tuple[bytes | None, bytes, int]]:
    """Each text, what is left of it, and the number of its removed runs."""
    many = pc.fill_null(pc.list_value_length(spans), 0).to_numpy()
    first, end = (c.to_numpy().astype(np.int64) for c in spans.flatten().flatten())
    ends = np.cumsum(many)
    for text, a, b in zip(texts, (ends - many).tolist(), ends.tolist(), strict=True):
        data = text.as_py()
        data = None if data is None else data.encode()
        yield (data, *cut(data or b"", first[a:b], end[a:b]))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    rows, name = with_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for data, kept, n in cut_all(batch.column(1), batch.column(2)):
                for box, v in zip(out, (len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest()), strict=True):
                    box.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("doc_id", "text", name).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with their texts cut (characters of which bytes are removed go as a whole) and n_chars after them; all columns are kept."""
    rows, name = with_spans(docs)
    names = docs.columns
    at, last = names.index("text"), len(names)
    rows = rows.select(*names, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if data is None else kept.decode("utf-8", "ignore") for data, kept, _ in cut_all(batch.column(at), batch.column(last))]
            cols = [*batch.columns[:last]]
            cols[at] = pa.array(texts, pa.string())
            if "n_chars" in names:  # the documents' own column of text lengths follows
                k = names.index("n_chars")
                cols[k] = pa.array([None if t is None else len(t) for t in texts], cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return rows.mapInArrow(run, kinds)

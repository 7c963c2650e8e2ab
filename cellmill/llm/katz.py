"""Language-model scoring: a Katz backoff bigram model over all words, trained and evaluated in one pass of pairs.

Words are lower-cased and split at ASCII white space; every text ends with an
end token. The model has three levels, each exactly normalised:

  P(w | h)  = d(c) c(h, w) / c(h) if the pair was seen, else alpha(h) P(w)
  P(w)      = discounted share of w
  unknown   = the mass that Good-Turing discounting leaves

for every word and pair of the corpus: counts of words and of pairs, and what
belongs to a context, are kept by hash in tables that grow with the corpus.
c counts come from all documents that may be learned from; nothing is pruned.
(VOCABULARY can bound the model's words; those beyond it then are one class.)

Jobs: word counts (a table, partitioned by word hash); counts of pairs of the
COMMON most frequent words, a table of fixed size, which settles the pairs that
could be hot where they stand. Counts of the HEAD most frequent words are
broadcast; a token beyond them goes to the partition of its word, which adds
the word's count. Then every other token goes, in delta-coded blocks, to the
partition of the context before it (of the pair, for the COMMON contexts),
where pairs are counted and, right there, looked up for all texts that hold
them. As all of a context is in one partition, a text that waits for its alpha
takes along what alpha is made of; alphas of the COMMON contexts and the
discounts need a bounded number of rows and close the sums at the end.

Defined cases: a null text is empty (its end token is scored); rows are scored
one by one, so repeated rows and ids repeat results; a null id is learned
from; without anything to learn from, known is 0 and the base score is that
of an empty count table (log10 of 1 / 1 for each token), the model's the same;
a very long text is one slice, whose word hashes are made in chunks; of words
that are as frequent the smaller hash is the more common one, which results do
not depend on; columns other than doc_id and text do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, free_shuffles, held_out, kept, mix, raw, slices, text_column, tokens

VOCABULARY: int | None = None
DISCOUNTED, BUCKET_TOKENS, CHUNK_TOKENS = 5, 4_000_000, 500_000
#: Bytes of text that make one set of blocks.
SLICE = 2 << 20
#: Counts of the HEAD most frequent words are broadcast; those of the others are joined by hash. Results do not depend on it.
HEAD = 1 << 16
#: Pairs of the COMMON most frequent words are counted first and never dealt out.
COMMON = 1024
END, START, CLASS = np.uint64(0x0E0D0E0D0E0D0E0D), np.uint64(0x57A257A257A257A2), np.uint64(0xC1A5C1A5C1A5C1A5)


def stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with an end token after each text, and n + 1 offsets."""
    data, offs = raw(texts)
    h, _, starts = tokens(data, offs, BLANK)
    return np.insert(h, starts[1:], END), starts + np.arange(len(starts))


def planes(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as byte planes of their differences (what compresses well)."""
    delta = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel())


def count_words(docs: DataFrame) -> DataFrame:
    """w (hash), c of all tokens of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            parts = [np.unique(stream(texts[a:b])[0], return_counts=True) for a, b in slices(texts, SLICE)]
            w, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            own, at = np.unique(w, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.bincount(at, weights=c).astype(np.int64))], names=["w", "c"])

    return docs.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def discounts(n: dict[int, int]) -> np.ndarray:
    """Katz's Good-Turing factors d(1) .. d(DISCOUNTED) from the numbers n of events seen so many times; 0 where there is no such event."""
    k = DISCOUNTED
    out = np.ones(k + 1)
    one = n.get(1, 0)
    a = (k + 1) * n.get(k + 1, 0) / one if one else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - a) / (1 - a) if n.get(r) and a < 1 else -1.0
        # Good-Turing fails where counts of counts have holes: absolute discounting then
        out[r] = d if 0 < d <= 1 else (r - (one / (one + 2 * n.get(2, 0)) if one else 0.5) * 0.999) / r
    return out


class Unigrams:
    """The word level: head words by hash, their numbers and log10 probabilities, the class and the unknown."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, kinds: int, of_counts: dict[int, int], bounded: bool = False) -> None:
        self.bounded = bounded
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.total, self.kinds = total, kinds
        self.d = discounts(of_counts)
        kept = total - sum((1 - self.d[r]) * r * of_counts.get(r, 0) for r in range(1, DISCOUNTED + 1))
        self.unknown = max(1 - kept / total, 1 / (total + 1)) if total else 1.0
        self.scale = (1 - self.unknown) / kept if kept else 0.0
        self.reserved = reserved = 1 / (total + 1)  # keeps some mass unseen after every context
        head = self.share(self.counts) * (1 - reserved)
        self.events = np.log10(np.append(head, max(1 - reserved - head.sum(), self.unknown * (1 - reserved)) if len(head) else 1.0))
        self.contexts = np.concatenate([self.counts, [total - self.counts.sum()]]).astype(np.float64)  # the start is added

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the add-one share of words by count."""
        return np.log10((counts + 1.0) / (self.total + 1.0 * (self.kinds + 1))) if self.total else np.zeros(len(counts))

    def share(self, counts: np.ndarray) -> np.ndarray:
        """P(w) of words by count (above 0)."""
        return np.where(counts <= DISCOUNTED, self.d[np.minimum(counts, DISCOUNTED)], 1.0) * counts * self.scale

    def event(self, counts: np.ndarray) -> np.ndarray:
        """log10 P(w) of words beyond the head; an unknown word takes the unknown mass."""
        if self.bounded:
            return np.full(len(counts), self.events[-1])
        return np.log10(np.where(counts > 0, self.share(np.maximum(counts, 1)), self.unknown) * (1 - self.reserved)) if self.total else np.zeros(len(counts))

    def within(self, counts: np.ndarray) -> np.ndarray:
        """log10 P(w | class) of words beyond a bounded vocabulary; an unknown word takes the unknown mass."""
        mass = max(1 - self.share(self.counts).sum(), self.unknown)
        return np.log10(np.where(counts > 0, self.share(np.maximum(counts, 1)), self.unknown) / mass)


def numbered(w: np.ndarray, offs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number (place among the sorted head words; the class is their number) of each token, and of the token before it (the start is one more)."""
    head = len(words)
    at = np.minimum(np.searchsorted(words, w), max(0, head - 1))
    number = np.where(words[at] == w, at, head) if head else np.zeros(len(w), np.int64)
    before = np.concatenate([[0], number[:-1]])
    before[offs[:-1]] = head + 1
    return number, before


def common_ids(counts: np.ndarray) -> np.ndarray:
    """Of each head word, the class and the start: its place among the common ones (the start is the last), else -1."""
    out = np.full(len(counts) + 2, -1)
    top = np.argsort(-counts, kind="stable")[:COMMON]
    out[top] = np.arange(len(top))
    out[-1] = COMMON
    return out


def count_common(docs: DataFrame, model: Unigrams) -> np.ndarray:
    """Counts of pairs of common words (COMMON + 1 contexts by COMMON words, a bounded table). docs: text of what may be learned from.

    A pair that holds over 1 / COMMON of all tokens is made of common words, so
    no pair that is dealt out later is more frequent than that.
    """
    shared, most = docs.sparkSession.sparkContext.broadcast((model.words, common_ids(model.counts))), COMMON

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = shared.value
        total = np.zeros((most + 1) * most, np.int64)
        for batch in batches:
            texts = text_column(batch)
            for a, b in slices(texts, SLICE):
                w, offs = stream(texts[a:b])
                number, before = numbered(w, offs, words)
                x, y = ids[before], ids[number]
                both = (x >= 0) & (y >= 0)
                total += np.bincount(x[both] * most + y[both], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["pair", "n"])

    rows = docs.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((COMMON + 1) * COMMON, np.int64)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(COMMON + 1, COMMON)


class Contexts:
    """What deals pairs out: the common contexts (ids as by common_ids) by hash."""

    def __init__(self, model: Unigrams) -> None:
        place = common_ids(model.counts)
        some = np.flatnonzero(place[:-2] >= 0)
        hashes, ids = np.append(model.words[some], START), np.append(place[some], COMMON)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], ids[order]
        self.counts = np.zeros(COMMON + 1)
        self.counts[place[some]], self.counts[COMMON] = model.counts[some], model.contexts[-1]

    def of(self, context: np.ndarray) -> np.ndarray:
        """The id of a common context, else -1."""
        at = np.minimum(np.searchsorted(self.hashes, context), len(self.hashes) - 1)
        return np.where(self.hashes[at] == context, self.ids[at], -1)

    def bucket(self, context: np.ndarray, event: np.ndarray, buckets: int) -> np.ndarray:
        return (mix(np.where(self.of(context) >= 0, context ^ mix(event), context)) % np.uint64(buckets)).astype(np.int64)


def contexts_of(w: np.ndarray, offs: np.ndarray, before: np.ndarray, model: Unigrams) -> np.ndarray:
    """Hash of the token before each token (before: its number); a bounded vocabulary has one class for the words beyond it."""
    out = np.concatenate([np.zeros(1, np.uint64), w[:-1]])
    out[offs[:-1]] = START
    return np.where(before == len(model.words), CLASS, out) if model.bounded else out


_BLOCK = [("bucket", pa.int64()), ("kind", pa.string()), *((k, pa.binary()) for k in "abcef")]
_BLOCKS = "bucket long, kind string, a binary, b binary, c binary, e binary, f binary"


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True) if data else data


def unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True) if data else data


def blocks_batch(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of blocks. rows: (bucket, kind, some of a, b, c, e, f)."""
    full = [(*r[:2], *map(squeeze, r[2:]), *[b""] * (len(_BLOCK) - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in full], t) for k, (_, t) in enumerate(_BLOCK)], names=[n for n, _ in _BLOCK])


def narrow(values: np.ndarray) -> bytes:
    """Byte planes of numbers below 2 ** 32."""
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def unnarrow(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def parts(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Buckets that occur in a sorted array and where."""
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, slice(cuts[k], cuts[k + 1])


def deal_rare(docs: DataFrame, model: Unigrams, buckets: int) -> DataFrame:
    """Blocks (kind t) of tokens beyond the head by word: words, texts' places, rows, contexts. docs: row, doc_id, train, text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = text_column(batch, "text")
            row, train = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in slices(texts, SLICE):
                w, offs = stream(texts[a:b])
                number, before = numbered(w, offs, m.words)
                rest = np.flatnonzero(number == len(m.words))
                text = (np.searchsorted(offs, rest, side="right") - 1).astype(np.int64)
                context, w = contexts_of(w, offs, before, m)[rest], w[rest]
                bucket = (mix(w) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((w, bucket))
                w, text, context, bucket = w[order], text[order], context[order], bucket[order]
                code, rows = planes_of_rows(row[a:b], train[a:b]), []
                for k, part in parts(bucket, buckets):
                    used, local = np.unique(text[part], return_inverse=True)
                    rows.append((k, "t", planes(w[part]), narrow(local), code(used), context[part].tobytes()))
                yield blocks_batch(rows)

    return docs.mapInArrow(run, _BLOCKS)


def count_rare(dealt: DataFrame, model: Unigrams, contexts: Contexts, buckets: int) -> DataFrame:
    """Blocks (kind f) of the tokens of deal_rare by context: contexts, texts' places, rows, words, counts of the words. dealt comes sorted by bucket."""
    shared = dealt.sparkSession.sparkContext.broadcast((model.bounded, contexts))

    def solve(tails: list, table: list) -> pa.RecordBatch:
        bounded, common = shared.value
        w, code, context = (np.concatenate(c) for c in zip(*tails, strict=True))
        words, counts = (np.concatenate(c) for c in zip(*table, strict=True)) if table else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        at = np.minimum(np.searchsorted(words, w), max(0, len(words) - 1))
        c = np.where(words[at] == w, counts[at], 0) if len(words) else np.zeros(len(w), np.int64)
        if bounded:
            w = np.full(len(w), CLASS)
        bucket = common.bucket(context, w, buckets)
        order = np.lexsort((context, bucket))
        w, code, context, c, bucket = w[order], code[order], context[order], c[order], bucket[order]
        rows = []
        for k, part in parts(bucket, buckets):
            used, local = np.unique(code[part], return_inverse=True)
            rows.append((k, "f", planes(context[part]), narrow(local), planes(used), w[part].tobytes(), narrow(np.minimum(c[part], 2**32 - 1))))
        return blocks_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tails, table = None, [], []
        for batch in batches:
            for k in range(batch.num_rows):
                bucket, kind = (x[k].as_py() for x in batch.columns[:2])
                a, b, c, e = (unsqueeze(x[k].as_py()) for x in batch.columns[2:6])
                if bucket != now:
                    if tails:
                        yield solve(tails, table)
                    now, tails, table = bucket, [], []
                if kind == "u":
                    table.append((unplanes(a), np.frombuffer(b, np.int64)))
                else:
                    tails.append((unplanes(a), unplanes(c)[unnarrow(b)], np.frombuffer(e, np.uint64)))
        if tails:
            yield solve(tails, table)

    return dealt.mapInArrow(run, _BLOCKS)


def deal(docs: DataFrame, model: Unigrams, common: np.ndarray, contexts: Contexts, buckets: int) -> DataFrame:
    """Blocks of tokens of the head by context (p: contexts, texts' places, rows, numbers of the words) and of texts (d). docs: row, doc_id, train, text."""
    shared = docs.sparkSession.sparkContext.broadcast((model, common, common_ids(model.counts), contexts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, common, ids_of, contexts = shared.value
        base = m.base(m.counts)
        for batch in batches:
            texts = text_column(batch, "text")
            row, train = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            ids, none = pc.fill_null(batch.column(1), 0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for a, b in slices(texts, SLICE):
                w, offs = stream(texts[a:b])
                n = np.diff(offs)
                text = np.repeat(np.arange(b - a), n)
                number, before = numbered(w, offs, m.words)
                known = number < len(m.words)
                x, y = ids_of[before], ids_of[number]
                both = np.flatnonzero((x >= 0) & (y >= 0))
                c = common[x[both], y[both]]
                both, c = both[c > 0], c[c > 0]  # settled here
                own = np.log10(c) - np.log10(np.maximum(m.contexts[before[both]], 1))
                settled = [np.bincount(text[both], weights=own, minlength=b - a), *(np.bincount(text[both], weights=c == r, minlength=b - a) for r in range(1, DISCOUNTED + 1))]
                open_ = known.copy()
                open_[both] = False
                context, owner, event = contexts_of(w, offs, before, m)[open_], text[open_], number[open_]
                bucket = contexts.bucket(context, w[open_], buckets)
                order = np.lexsort((context, bucket))
                context, owner, event, bucket = context[order], owner[order], event[order], bucket[order]
                code, rows = planes_of_rows(row[a:b], train[a:b]), []
                for k, part in parts(bucket, buckets):
                    used, local = np.unique(owner[part], return_inverse=True)
                    rows.append((k, "p", planes(context[part]), narrow(local), code(used), narrow(event[part])))
                sums = np.bincount(text[known], weights=base[number[known]], minlength=b - a)
                found = np.bincount(text, weights=known, minlength=b - a)
                rows.append((int(row[a] % buckets), "d", np.ascontiguousarray(row[a:b]).tobytes(), np.stack([sums, *settled]).tobytes(), np.stack([n, found.astype(np.int64), ids[a:b], none[a:b]]).tobytes()))
                yield blocks_batch(rows)

    return docs.mapInArrow(run, _BLOCKS)


def planes_of_rows(row: np.ndarray, train: np.ndarray):
    """A coder of row numbers and their train flags for chosen texts of a slice."""
    coded = (row.astype(np.uint64) << np.uint64(1)) | train.astype(np.uint64)  # rows ascend
    return lambda used: planes(coded[used])


def rows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    coded = unplanes(data)
    return (coded >> np.uint64(1)).astype(np.int64), (coded & np.uint64(1)).astype(bool)


def words_blocks(counts: DataFrame, buckets: int, least: int) -> DataFrame:
    """Blocks (kind u) of the word table, for words beyond the head (those counted `least` times at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, c = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            bucket = (mix(w) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((w, bucket))
            w, c, bucket = w[order], c[order], bucket[order]
            yield blocks_batch([(k, "u", planes(w[part]), c[part].tobytes()) for k, part in parts(bucket, buckets)])

    return counts.where(F.col("c") <= least).select("w", "c").mapInArrow(run, _BLOCKS)


#: What one bucket tells of a text (x) or a common context (h; the sums of all others are -1's): n1 .. n6 count pairs by count. Texts that wait for an alpha are in blocks (w).
_TOLD = [("kind", pa.string()), ("id", pa.int64()), ("logs", pa.float64()), ("base", pa.float64()), ("share", pa.float64()), ("n_tokens", pa.int64()), ("known", pa.int64()), *((f"n{r}", pa.int64()) for r in range(1, DISCOUNTED + 2)), ("more", pa.int64()), ("doc_id", pa.int64()), ("block", pa.binary())]


def pack(rows: np.ndarray, codes: np.ndarray, parts: np.ndarray) -> bytes:
    """Rows that wait (sorted), what for (a common context, or beyond those a column of parts), and what alpha is made of: DISCOUNTED + 3 rows of parts."""
    return np.array([len(rows)]).tobytes() + planes(rows) + narrow(codes) + parts.tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data[:8], np.int64)[0])
    return unplanes(data[8 : 8 + 8 * n]).astype(np.int64), unnarrow(data[8 + 8 * n : 8 + 12 * n]), np.frombuffer(data[8 + 12 * n :]).reshape(DISCOUNTED + 3, -1)


def alphas(parts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log10 of alpha from n1 .. n5, the counts above, the context's count and the P(w) of what was seen."""
    mass = parts[DISCOUNTED] + sum(parts[r - 1] * r * d[r] for r in range(1, DISCOUNTED + 1))
    out = np.zeros(parts.shape[1])
    some = mass > 0
    out[some] = np.log10(np.maximum(1 - mass[some] / parts[-2][some], 1e-300) / np.maximum(1 - parts[-1][some], 1e-300))
    return out


def tell(dealt: DataFrame, model: Unigrams, contexts: Contexts) -> DataFrame:
    """One row for each bucket and text or common context in it, and blocks of what waits. dealt comes sorted by bucket."""
    shared = dealt.sparkSession.sparkContext.broadcast((model, contexts))
    names = [k for k, _ in _TOLD]

    def batch_of(kind: str, ids: np.ndarray, **cols) -> pa.RecordBatch:
        n = len(ids)
        zero = {pa.float64(): np.zeros(n), pa.int64(): np.zeros(n, np.int64)}
        out = [pa.array([kind] * n, pa.string()), pa.array(ids, pa.int64())]
        for k, t in _TOLD[2:]:
            v = cols.get(k)
            out.append(pa.array([None] * n, t) if v is None and k in ("block", "doc_id") else pa.array(zero[t] if v is None else v, t) if not isinstance(v, pa.Array) else v)
        return pa.RecordBatch.from_arrays(out, names=names)

    def solve(bucket: int, blocks: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Counts and looks up the pairs of a bucket, a range of contexts after the other. blocks: sorted contexts, local text of each, rows and train flags of the texts, numbers of words or (words, counts)."""
        m, common = shared.value
        texts = np.unique(np.concatenate([b[2] for b in blocks]))
        for k, (context, local, row, train, event) in enumerate(blocks):
            blocks[k] = (context, np.searchsorted(texts, row).astype(np.int32)[local], train[local], event)
        n = len(texts)
        logs, base, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        by, most = np.zeros((DISCOUNTED, n), np.int64), COMMON + 1
        of, share = np.zeros((DISCOUNTED + 2, most + 1), np.int64), np.zeros(most + 1)  # the last is all others
        for _, at, _, event in blocks:
            if isinstance(event, tuple):
                c = event[1]
                base += np.bincount(at, weights=m.base(c), minlength=n)
                known += np.bincount(at, weights=c > 0, minlength=n).astype(np.int64)
                if m.bounded:
                    logs += np.bincount(at, weights=m.within(c), minlength=n)
        some = np.sort(np.concatenate([b[0][::64] for b in blocks]))
        many = sum(len(b[0]) for b in blocks)
        cuts = np.unique(some[np.linspace(0, len(some) - 1, many // CHUNK_TOKENS + 2).astype(int)[1:-1]])
        places = [[0, *np.searchsorted(b[0], cuts).tolist(), len(b[0])] for b in blocks]
        for k in range(len(cuts) + 1):
            chunk = []
            for (context, at, train, event), p in zip(blocks, places, strict=True):
                part = slice(p[k], p[k + 1])
                if p[k] == p[k + 1]:
                    continue
                if isinstance(event, tuple):
                    word, log = event[0][part], m.event(event[1][part])
                else:
                    word, log = m.words[event[part]], m.events[event[part]]
                chunk.append((context[part], word, log, at[part], train[part]))
            if not chunk:
                continue
            context, word, log, at, train = (np.concatenate(c) for c in zip(*chunk, strict=True))
            order = np.lexsort((word, context))
            context, word, log, at, train = context[order], word[order], log[order], at[order], train[order]
            first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])]))
            each = np.diff(np.append(first, len(context)))
            count, log, pair_context = np.add.reduceat(train.astype(np.int64), first), log[first], context[first]
            new = np.concatenate([[True], pair_context[1:] != pair_context[:-1]])
            own, kinds = np.cumsum(new) - 1, int(new.sum())
            ids = common.of(pair_context[new])
            seen = count > 0
            c, h = count[seen], own[seen]
            parts = np.zeros((DISCOUNTED + 3, kinds))
            for r in range(1, DISCOUNTED + 1):
                parts[r - 1] = np.bincount(h[c == r], minlength=kinds)
            parts[DISCOUNTED] = np.bincount(h, weights=np.where(c > DISCOUNTED, c, 0), minlength=kinds)
            parts[-2] = np.where(ids >= 0, common.counts[ids], np.bincount(h, weights=c, minlength=kinds))
            parts[-1] = np.bincount(h, weights=10 ** log[seen], minlength=kinds)
            to = np.where(ids >= 0, ids, most)
            for r in range(DISCOUNTED + 1):
                np.add.at(of[r if r < DISCOUNTED else DISCOUNTED + 1], to, parts[r].astype(np.int64))
            of[DISCOUNTED] += np.bincount(to[h[c == DISCOUNTED + 1]], minlength=most + 1)
            np.add.at(share, to, parts[-1])
            # every seen pair is divided by its context's count, every unseen one waits for its context's alpha
            value = np.where(seen, np.log10(np.maximum(count, 1)) - np.log10(np.maximum(parts[-2][own], 1)), log)
            logs += np.bincount(at, weights=np.repeat(value, each), minlength=n)
            c = np.repeat(count, each)
            for r in range(1, DISCOUNTED + 1):
                by[r - 1] += np.bincount(at[c == r], minlength=n)
            wait = (~seen & (parts[-2] > 0)[own])  # a context that was never learned from has an alpha of 1
            rest = np.repeat(wait, each)
            if rest.any():
                code = np.where(ids >= 0, ids, most)
                asked = np.unique(own[wait & (ids < 0)[own]])
                code[asked] = most + np.arange(len(asked))
                rows, code = texts[at[rest]], code[np.repeat(own, each)[rest]]
                order = np.argsort(rows, kind="stable")
                yield batch_of("w", np.array([bucket]), block=pa.array([pack(rows[order], code[order], np.ascontiguousarray(parts[:, asked]))], pa.binary()))
        some = np.flatnonzero(of.sum(axis=0))
        if len(some):
            yield batch_of("h", np.where(some == most, -1, some), share=share[some], more=of[DISCOUNTED + 1][some], **{f"n{r}": of[r - 1][some] for r in range(1, DISCOUNTED + 2)})
        yield batch_of("x", texts, logs=logs, base=base, known=known, **{f"n{r}": by[r - 1] for r in range(1, DISCOUNTED + 1)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs = None, []
        for batch in batches:
            for k in range(batch.num_rows):  # one block at a time: only its arrays are kept
                bucket, kind = (x[k].as_py() for x in batch.columns[:2])
                a, b, c, e, f = (unsqueeze(x[k].as_py()) for x in batch.columns[2:])
                if bucket != now:
                    if pairs:
                        yield from solve(now, pairs)
                    now, pairs = bucket, []
                if kind == "d":
                    n = np.frombuffer(c, np.int64).reshape(4, -1)
                    t = np.frombuffer(b).reshape(DISCOUNTED + 2, -1)
                    by = {f"n{r}": t[1 + r].astype(np.int64) for r in range(1, DISCOUNTED + 1)}
                    yield batch_of("x", np.frombuffer(a, np.int64), base=t[0], logs=t[1], n_tokens=n[0], known=n[1], doc_id=pa.array(n[2], mask=n[3] > 0), **by)
                else:
                    event = unnarrow(e) if kind == "p" else (np.frombuffer(e, np.uint64), unnarrow(f).astype(np.int64))
                    pairs.append((unplanes(a), unnarrow(b), *rows_of(c), event))
        if pairs:
            yield from solve(now, pairs)

    kinds = {pa.string(): "string", pa.int64(): "long", pa.float64(): "double", pa.binary(): "binary"}
    return dealt.mapInArrow(run, ", ".join(f"{k} {kinds[t]}" for k, t in _TOLD))


def close(gathered: DataFrame, model: Unigrams, common: np.ndarray, contexts: Contexts) -> tuple[np.ndarray, np.ndarray]:
    """Discounts of pairs (0 .. DISCOUNTED) and log10 of alpha by common context, from one row a common context and the common pairs."""
    rows = gathered.where("kind = 'h'").drop("blocks").toArrow()
    most = COMMON + 1
    by, more, share = np.zeros((DISCOUNTED + 1, most + 1), np.int64), np.zeros(most + 1), np.zeros(most + 1)
    ids = np.where(rows["id"].to_numpy() < 0, most, rows["id"].to_numpy())
    for r in range(1, DISCOUNTED + 2):
        by[r - 1, ids] = rows[f"n{r}"].to_numpy()
    more[ids], share[ids] = rows["more"].to_numpy(), rows["share"].to_numpy()
    place = common_ids(model.counts)[:-2]
    word = np.zeros(most, np.int64)
    word[place[place >= 0]] = np.flatnonzero(place >= 0)
    h, y = np.nonzero(common)
    c = common[h, y]
    for r in range(1, DISCOUNTED + 2):
        by[r - 1] += np.bincount(h[c == r], minlength=most + 1)
    more += np.bincount(h, weights=np.where(c > DISCOUNTED, c, 0), minlength=most + 1)
    share += np.bincount(h, weights=10 ** model.events[word[y]], minlength=most + 1)
    d = discounts({r: int(by[r - 1].sum()) for r in range(1, DISCOUNTED + 2)})
    return d, alphas(np.vstack([by[:DISCOUNTED, :most], more[:most], contexts.counts, share[:most]]), d)


def katz(docs: DataFrame, train) -> DataFrame:
    """row, doc_id, n_tokens, n_known, train_tokens, base_score, score of every text. train: a Column that says what to learn from."""
    spark = docs.sparkSession
    base = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", train.alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    counts = kept(count_words(base.where("train")))
    free_shuffles(spark)
    sizes = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), *(F.sum((F.col("c") == r).cast("long")).alias(f"n{r}") for r in range(1, DISCOUNTED + 2))).first()
    size = VOCABULARY or HEAD
    top = counts.orderBy(F.desc("c"), "w").limit(size).toArrow()
    total, kinds = sizes["n"] or 0, sizes["v"]
    model = Unigrams(top["w"].to_numpy().view(np.uint64), top["c"].to_numpy(), total, kinds, {r: sizes[f"n{r}"] or 0 for r in range(1, DISCOUNTED + 2)}, VOCABULARY is not None)
    starts = base.where("train").count()
    if not (model.words == END).any():
        model.contexts[-1] -= starts  # ends are no contexts
    model.contexts = np.append(model.contexts, starts)
    seen = spark.createDataFrame(top.select(["w"])).withColumnRenamed("w", "head")
    least = int(top["c"].to_numpy().min()) if top.num_rows == size else -1
    rest = counts.where(F.col("c") <= least).join(F.broadcast(seen), F.col("w") == F.col("head"), "left_anti")
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-total // BUCKET_TOKENS))
    common, contexts = count_common(base.where("train"), model), Contexts(model)

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")

    rare = count_rare(by_bucket(deal_rare(base, model, buckets).unionByName(words_blocks(rest, buckets, least))), model, contexts, buckets)
    told = tell(by_bucket(deal(base, model, common, contexts, buckets).unionByName(rare)), model, contexts)
    sums = [F.sum(k).alias(k) for k, t in _TOLD[2:] if k not in ("block", "doc_id")]
    gathered = kept(told.groupBy("kind", "id").agg(*sums, F.max("doc_id").alias("doc_id"), F.collect_list("block").alias("blocks")))
    free_shuffles(spark)
    d, alpha = close(gathered, model, common, contexts)
    shared = spark.sparkContext.broadcast((d, alpha))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, alpha = shared.value
        for batch in batches:
            for blocks in batch.column(0):
                for block in blocks:
                    rows, codes, parts = unpack(block.as_py())
                    ids, at = np.unique(rows, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(at, weights=np.append(alpha, alphas(parts, d))[codes]))], names=["row", "logs"])

    logs = F.col("logs") + sum((F.col(f"n{r}") * float(np.log10(d[r])) for r in range(1, DISCOUNTED + 1)), F.lit(0.0))
    texts = gathered.where("kind = 'x'").select(F.col("id").alias("row"), logs.alias("logs"), "doc_id", "n_tokens", "known", "base")
    waited = gathered.where("kind = 'w'").select("blocks").mapInArrow(finish, "row long, logs double")
    out = texts.unionByName(waited, allowMissingColumns=True).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("logs").alias("score"))
    return out.select("row", "doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def katz_score(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    away = held_out(F.col("doc_id"), 7, 2)
    return katz(docs.select("doc_id", "text"), ~away).select("doc_id", away.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""Shared pieces of the training-data operators: reading, checkpoints, byte-level tokenising in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..packaging import ship

#: Bytes of text that are worked on at once, and of which word hashes are made at once.
SLICE_BYTES, CHUNK_BYTES = 1 << 19, 1 << 19


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of one file of a checkpoint whose size is known.
FILE_ROWS = 100_000


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with its lineage cut by files in the shared folder of spark.checkpoint.dir.

    rows: a bound on the rows of df, where one is known; few rows then go to
    few files, whatever the number of shuffle partitions. A folder of our own
    is set only where the session has none (tests).
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{tempfile.gettempdir()}/cellmill-{uuid.uuid4().hex}")
    return (df if rows is None else df.coalesce(-(-rows // FILE_ROWS) or 1)).checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept on the executors' own disks; parts that are lost with an executor are computed again from what df was made of.

    For what is read several times and has short lineage: it writes no files
    into the shared folder. spark.catalog.clearCache() lets it go.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of finished jobs (it follows the driver's garbage collection)."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32(doc_id as text) mod `mod` is `rest`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes of text each; a longer text is a range of its own."""
    n = len(texts)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, to
        at = to


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column with nulls as empty texts."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of them."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or o[-1] == o[0]:
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]], o - o[0]


def _table(space: Callable[[int], bool]) -> np.ndarray:
    return np.array([32 if space(i) else i + 32 if 65 <= i <= 90 else i for i in range(256)], dtype=np.uint8)


#: Byte tables: lower-case A-Z; what separates words becomes a space.
WORD = _table(lambda i: i < 128 and not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122))
BLANK = _table(lambda i: i == 32 or 9 <= i <= 13)

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if n <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray, cuts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start byte of each word; no word goes over a cut."""
    n = len(data)
    b = table[data]
    inside = b != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(_MULT, n), out=sums[1:])
    return mix((sums[e + 1] - sums[s]) * powers(_INV, n)[s]), s


def _cut(data: np.ndarray, offs: np.ndarray, at: int, table: np.ndarray) -> int:
    """Where a chunk that starts at `at` ends: between words, after CHUNK_BYTES at most but for a longer word."""
    to = at + CHUNK_BYTES
    if to >= len(data):
        return len(data)
    blank = np.flatnonzero(table[data[at:to]] == 32)
    cut = max(at + int(blank[-1]) + 1 if len(blank) else at, int(offs[np.searchsorted(offs, to, side="right") - 1]))
    if cut > at:
        return cut
    bound = int(offs[np.searchsorted(offs, at, side="right")])
    while to < bound:
        ahead = np.flatnonzero(table[data[to : to + CHUNK_BYTES]] == 32)
        if len(ahead):
            return min(bound, to + int(ahead[0]))
        to += CHUNK_BYTES
    return bound


def tokens(data: np.ndarray, offs: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of consecutive texts: 64-bit hash, start byte, and for each text the number of words before it (n + 1).

    Bytes are hashed CHUNK_BYTES at a time, so that a long text takes little
    more than its words' hashes.
    """
    at, found = 0, []
    while at < len(data):
        to = _cut(data, offs, at, table)
        own = offs[np.searchsorted(offs, at, side="left") : np.searchsorted(offs, to, side="left")] - at
        h, s = _words(data[at:to], own, table)
        found.append((h, s + at))
        at = to
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    h, s = (np.concatenate(c) for c in zip(*found, strict=True))
    return h, s, np.searchsorted(s, offs).astype(np.int64)


def shingle_hashes(words: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of each text and their n + 1 offsets; a text of fewer words has one shingle of all of them."""
    n = len(starts) - 1
    count = np.diff(starts)
    many = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    offs = np.zeros(n + 1, np.int64)
    np.cumsum(many, out=offs[1:])
    at = np.arange(offs[-1]) - np.repeat(offs[:-1], many) + np.repeat(starts[:-1], many)
    end = np.repeat(starts[1:], many)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        p = at + j
        w = np.where(p < end, words[np.minimum(p, max(0, len(words) - 1))], np.uint64(0)) if len(words) else h
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w + np.uint64(j + 1))
    return h, offs


def free_names(taken: list[str], *names: str) -> list[str]:
    """Names like these that none of `taken` (in any case) has, for helper columns beside an input's own."""
    have, out = {n.lower() for n in taken}, []
    for n in names:
        while (n := f"_{n}").lower() in have:
            pass
        have.add(n.lower())
        out.append(n)
    return out


def text_hash(text: str = "text") -> Column:
    """64-bit hash of a text, a null as an empty one; tells texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))

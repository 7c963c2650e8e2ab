"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, and only that reply trainable. A conversation that goes on after its
last assistant turn, or has none, ends with an example of all its turns that
trains nothing, so each conversation can be read back whole.

Template: ``### role: text </turn>`` and a line break for each turn. Control
strings inside texts and roles are escaped by a backslash, reversibly.

Conversations are streamed in order of turn: a task holds one formatted
conversation at a time and emits examples in bounded batches. By definition
examples take the square of a conversation's turns in output.

Defined cases: null texts and roles are empty; rows of equal turn go by role,
then text; repeated rows all count; a null conv_id is a conversation of its
own; null turns come first; no rows give no examples; columns other than
conv_id, turn, role and text do not matter. A text of n characters takes a
small multiple of n in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, END = "### ", ": ", " </turn>\n"
_MARKS = re.compile(r"\\|###|</turn>")
_ROLE_MARKS = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
BATCH_CHARS = 4 << 20


def escape(text: str, marks: re.Pattern = _MARKS) -> str:
    return marks.sub(lambda m: "\\" + m[0], text) if marks.search(text) else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text) if "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation, in time and memory in proportion to it.

    A role ends at its first colon that is not escaped. Inside a text every
    </turn> has a backslash before it, so END is nowhere but at its end.
    """
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise ValueError(f"no turn at character {at}")
        start = at + len(HEAD)
        colon = formatted.find(":", start)
        while colon >= 0 and _escaped(formatted, start, colon):
            colon = formatted.find(":", colon + 1)
        end = formatted.find(END, colon + len(MIDDLE))
        if colon < 0 or end < 0 or not formatted.startswith(MIDDLE, colon):
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(formatted[start:colon]), unescape(formatted[colon + len(MIDDLE) : end])))
        at = end + len(END)
    return out


def _escaped(text: str, start: int, at: int) -> bool:
    """Whether an odd number of backslashes stands before place `at`."""
    k = at
    while k > start and text[k - 1] == "\\":
        k -= 1
    return (at - k) % 2 == 1


def expand(turns: Iterator[tuple[int | None, str, str]]) -> Iterator[tuple[int | None, int, str, int, int, bool]]:
    """Rows (conv_id, example, text, loss_start, loss_end, whole) from (conv_id, role, text), which come conversation by conversation."""

    def tail(conv, n, prefix, open_):
        return [(conv, n, prefix, len(prefix), len(prefix), True)] if open_ else []

    now, started, n, prefix, held, open_ = None, False, 0, "", None, False
    for conv, role, text in turns:
        if not started or conv != now:
            if held:
                yield (*held, not open_)
            yield from tail(now, n, prefix, open_)
            now, started, n, prefix, held, open_ = conv, True, 0, "", None, False
        if held:
            yield (*held, False)
            held = None
        prefix += f"{HEAD}{escape(role, _ROLE_MARKS)}{MIDDLE}"
        start = len(prefix)
        prefix += escape(text)
        end = len(prefix)
        prefix += END
        open_ = role != "assistant"
        if not open_:
            held = (conv, n, prefix, start, end)
            n += 1
    if started:
        if held:
            yield (*held, not open_)
        yield from tail(now, n, prefix, open_)


_KINDS = [("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("whole", pa.bool_())]


def batches_of(rows: Iterator[tuple], kinds: list[tuple[str, pa.DataType]], chars: int | None) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about BATCH_CHARS in column `chars`."""
    kept, size = [], 0
    schema = pa.schema(kinds)
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*kept, strict=True), kinds, strict=True)], schema=schema)
    for r in rows:
        kept.append(r)
        size += 64 if chars is None else len(r[chars]) + 64
        if size >= BATCH_CHARS:
            yield flush()
            kept, size = [], 0
    if kept:
        yield flush()


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text, loss_start and loss_end (characters; equal: nothing to train), whole (has all turns).

    Rows come sorted by conversation and example within each partition.
    """
    clean = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        return batches_of(expand(turns), _KINDS, 2)

    return placed.mapInArrow(run, "conv_id long, example long, text string, loss_start long, loss_end long, whole boolean")


def digests(examples: DataFrame) -> DataFrame:
    """The contract's digest columns, read back from the examples (as prefix_targets orders them)."""
    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        loss, chars, total, n = hashlib.sha256(), 0, 0, 0
        for b in batches:
            for conv, _, text, start, end, whole in zip(*(c.to_pylist() for c in b.columns), strict=True):
                reply = unescape(text[start:end])
                loss.update(reply.encode("utf-8", "surrogatepass"))
                chars, total, n = chars + len(reply), total + len(text), n + 1
                if whole:
                    turns = parse(text)
                    said = hashlib.sha256()
                    for x in turns:
                        said.update("".join(f"{y}\n" for y in x).encode("utf-8", "surrogatepass"))
                    yield conv, len(turns), said.hexdigest(), chars, loss.hexdigest(), total, n
                    loss, chars, total, n = hashlib.sha256(), 0, 0, 0

    return examples.mapInArrow(lambda batches: batches_of(rows(batches), kinds, None), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")


def chat_format(conversations: DataFrame) -> DataFrame:
    """The contract's rows, with conversation -7 of two turns full of control strings."""
    spark = conversations.sparkSession
    odd = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return digests(prefix_targets(conversations.select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(more)))

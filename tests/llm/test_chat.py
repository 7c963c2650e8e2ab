import hashlib
import tracemalloc

import pytest
from hypothesis import given
from hypothesis import strategies as st

from cellmill.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, example string"
ROWS = [
    (1, 0, "system", "be kind", "x"), (1, 1, "user", "hi </turn>\n### assistant: no", "x"), (1, 2, "assistant", "\\### ok \\", "x"), (1, 3, "user", None, "x"),
    (2, 0, "assistant", "", "x"), (2, 0, "assistant", "tie", "x"), (2, 1, None, "tail", "x"), (3, 5, "user", "alone", "x"), (3, 5, "user", "alone", "x"),
    (None, 0, "user", "q", "x"), (None, 1, "assistant", "é𝔘" * 50, "x"), (4, None, "we:ird ### role", "t", "x"), (4, 1, "assistant", "a" * 300000, "x"),
]
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    out, by = {}, {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    odd = r"\### Assistant: </turn> ok"
    by[-7] = [(-7, 0, "user", odd), (-7, 1, "assistant", odd)]
    for conv, turns in by.items():
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for role, t in said if role == "assistant")
        out[conv] = (len(said), sha("".join(f"{a}\n{b}\n" for a, b in said)), len(loss), sha(loss))
    return out


def test_digests(spark):
    rows = C.chat_format(spark.createDataFrame(ROWS, SCHEMA).repartition(4)).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in rows} == expected(ROWS)
    assert len(rows) == len(expected(ROWS)) and all(r["formatted_chars"] > r["loss_chars"] for r in rows)


def test_examples(spark):
    rows = sorted(C.prefix_targets(spark.createDataFrame(ROWS[:4], SCHEMA)).collect())
    assert [(r["example"], r["whole"]) for r in rows] == [(0, False), (1, True)]
    assert C.unescape(rows[0]["text"][rows[0]["loss_start"] : rows[0]["loss_end"]]) == "\\### ok \\"
    assert rows[1]["loss_start"] == rows[1]["loss_end"] and rows[1]["text"].startswith(rows[0]["text"])


def test_empty(spark):
    rows = C.chat_format(spark.createDataFrame([], SCHEMA)).collect()
    assert [r["conv_id"] for r in rows] == [-7]


@given(st.lists(st.tuples(st.text(alphabet="\\#/<>turn: \nab", max_size=12), st.text(alphabet="\\#/<>turn: \nab", max_size=20)), max_size=5))
def test_round_trip(turns):
    text = "".join(f"{C.HEAD}{C.escape(r, C._ROLE_MARKS)}{C.MIDDLE}{C.escape(t)}{C.END}" for r, t in turns)
    assert C.parse(text) == turns


def test_long_turns_take_little_memory():
    """A turn of 8 MB, plain or full of marks, is parsed in a few times its size."""
    for piece in ("long words of text ", "\\ ### </turn> : ", "</turn>\n### a: "):
        long = piece * ((8 << 20) // len(piece))
        text = f"{C.HEAD}user{C.MIDDLE}{C.escape(long)}{C.END}"
        tracemalloc.start()
        turns = C.parse(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert turns == [("user", long)] and peak < 250 << 20


def test_clashing_columns(spark):
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3], "x", 1, 2, True) for r in ROWS], "conv_id long, turn long, role string, text string, example string, loss_start int, n_turns int, whole boolean")
    assert sorted(map(str, C.chat_format(df).collect())) == sorted(map(str, C.chat_format(spark.createDataFrame(ROWS, SCHEMA)).collect()))


def test_no_turn():
    for bad in ("x", "### a", "### a: b", "### a: b </turn>\nx", "### a\\: b </turn>\n"):
        with pytest.raises(ValueError):
            C.parse(bad)

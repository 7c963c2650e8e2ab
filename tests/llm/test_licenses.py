import random
import time
import tracemalloc

import pytest
from cases import ODD, docs, none, words
from pyspark.sql import functions as F

from cellmill.llm import licenses as L


def test_base_against_words(spark):
    rows = {(r["doc_id"], r["n_words"]): r for r in L.license_scan(docs(spark)).collect()}
    assert len(L.license_scan(docs(spark)).collect()) == len(ODD)
    for i, text, *_ in ODD:
        w = words(text)
        found = [(k, label) for phrase, label in L.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = rows[i, len(w)]
        assert r["n_base"] == len(found)
        assert (r["first_word"], r["last_word"]) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_overlapping_phrases():
    r = L.scan("cc by nc cc by nc under the mit license apache license version 2")
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (4, 0, 10, "apache-2,cc-by-nc,mit")


@pytest.mark.parametrize(
    ("text", "labels", "openness", "form"),
    [
        ("MIT", ["mit"], 0.9, "MIT"),
        ("MIT OR Apache-2.0 AND GPL-3.0-only", ["mit", "apache-2", "gpl"], 0.9, "MIT Apache-2.0 GPL-3.0-only and or"),
        ("(MIT OR Apache-2.0) AND GPL-2.0+", ["mit", "apache-2", "gpl"], 0.4, "MIT Apache-2.0 or GPL-2.0+ and"),
        ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl"], 0.7, "GPL-2.0 Classpath-exception-2.0 with"),
        ("MIT and then some text", ["mit"], 0.9, "MIT"),
        ("BSD-3-Clause */ int x", ["bsd"], 0.9, "BSD-3-Clause"),
        ("Artistic-2.0 OR MIT", ["artistic", "mit"], 0.9, "Artistic-2.0 MIT or"),
        ("WTFPL", ["wtfpl"], 1.0, "WTFPL"),
        ("Foo-1.1+ AND (ISC or MIT)", ["foo-1.1", "isc", "mit"], 0.5, "Foo-1.1+ ISC MIT or and"),
        ("MIT AND SEE the file", ["mit"], 0.9, "MIT"),
        ("MIT AND\nGPL-2.0", ["mit"], 0.9, "MIT"),
    ],
)
def test_expressions(text, labels, openness, form):
    assert L.evaluate(text) == (labels, pytest.approx(openness), form)


def test_no_expression():
    assert L.evaluate("OR MIT") is None and L.evaluate("") is None and L.evaluate("(MIT") is None


def test_tag():
    r = L.scan("// SPDX-License-Identifier: (MPL-2.0 OR ISC)\ncode under the MIT license")
    assert r["labels"] == "isc,mit,mpl" and r["expressions"] == ["MPL-2.0 ISC or"]


def test_empty(spark):
    assert L.license_scan(none(spark)).collect() == []


def brute_expression(tokens):
    """Value and labels by recursive descent: or binds least, then and, then with."""
    def level(at, ops=("or", "and", "with")):
        if not ops:
            if tokens[at] == "(":
                value, at = level(at + 1)
                return value, at + 1
            return L.operand(tokens[at])[1] if tokens[at - 1].lower() != "with" else 0.0, at + 1
        value, at = level(at, ops[1:])
        while at < len(tokens) and tokens[at].lower() == ops[0]:
            other, at = level(at + 1, ops[1:])
            value = max(value, other) if ops[0] == "or" else min(value, other) if ops[0] == "and" else value + (1 - value) / 2
        return value, at

    return level(0)[0]


def test_expressions_against_descent():
    rng = random.Random(2)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(["MIT", "GPL-2.0-only", "Apache-2.0", "CC-BY-NC-4.0", "Foo-2", "ISC"])
            return [name, rng.choice(["with", "WITH"]), "Classpath-exception-2.0"] if rng.random() < 0.2 else [name]
        out = made(depth - 1)
        for _ in range(rng.randint(1, 2)):
            part = made(depth - 1)
            out += [rng.choice(["or", "and", "OR", "AND"]), *(["(", *part, ")"] if rng.random() < 0.5 else part)]
        return out

    for _ in range(300):
        tokens = made(3)
        labels, value, form = L.evaluate(" ".join(tokens))
        assert value == pytest.approx(brute_expression(tokens))
        assert sorted(form.split()) == sorted(t.lower() if t.lower() in ("or", "and", "with") else t for t in tokens if t not in "()")
        assert labels == [L.operand(t)[0] for k, t in enumerate(tokens) if t.lower() not in ("or", "and", "with", "(", ")") and (k == 0 or tokens[k - 1].lower() != "with")]


def test_long_texts_are_scanned_in_line():
    """Many tags on one line, long expressions, and a text of 20 MB within 500 MB."""
    many = "SPDX-License-Identifier: MIT " * 30_000
    begun = time.process_time()
    r = L.scan(many)
    assert len(r["expressions"]) == 30_000 and r["n_words"] == 120_000 and r["labels"] == "mit"
    r = L.scan("SPDX-License-Identifier: " + "(" * 1000 + " OR ".join(["MIT"] * 20_000) + ")" * 1000)
    assert r["expressions"][0].count("MIT") == 20_000
    assert time.process_time() - begun < 10
    text = "Plain words, of no\u00e9 licence... " * (20 * 2**20 // 32) + "SPDX-License-Identifier: MIT\n" + "under the MIT license"
    tracemalloc.start()
    r = L.scan(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert r["labels"] == "mit" and r["first_word"] == r["n_words"] - 4 and r["expressions"] == ["MIT"] and peak < 500 << 20


def test_clashing_columns(spark):
    df = docs(spark)
    for c in ("labels", "n_words", "spans", "kind"):
        df = df.withColumn(c, F.lit(1))
    assert sorted(map(str, L.license_scan(df).collect())) == sorted(map(str, L.license_scan(docs(spark)).collect()))

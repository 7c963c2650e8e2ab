"""Licence scan: Aho-Corasick over normalised words, shunting-yard for licence expressions.

A text's words (lower-cased runs of letters, digits and non-ASCII characters)
are joined by single blanks; one automaton finds all identifier tags and
notice phrases at once. What follows a tag on its line is parsed as a licence
expression (and / or / with, parentheses, + suffix) and evaluated.

Defined cases: a null or empty text has no words, no labels (empty strings)
and score 0. Overlapping and repeated phrases all count. An expression that
does not parse is cut before its first bad token; without an operand it says
nothing. An identifier that is not known but well formed (with a digit or two
capitals) is an operand labelled by its own name. Rows are scanned one by one,
so repeated rows and ids repeat results; other columns of the input do not
matter. Time and memory are in proportion to a text's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD, text_column

# The base phrases with their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notice phrases with their labels.
NOTICES = {
    "cc by sa": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "gnu affero general public license": "agpl",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "licensed under the apache license": "apache-2",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "released into the public domain": "public-domain",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "all-rights-reserved",
}
# Tags that a licence expression follows.
TAGS = ("spdx license identifier", "spdx licenseidentifier", "license expression")
# Identifiers (lower case, without version suffix) with label and openness (1: any use).
LICENSES = {
    "0bsd": ("bsd", 1.0),
    "afl": ("afl", 0.8),
    "agpl": ("agpl", 0.3),
    "apache": ("apache-2", 0.9),
    "artistic": ("artistic", 0.7),
    "beerware": ("beerware", 0.9),
    "blueoak": ("blueoak", 0.9),
    "bsd": ("bsd", 0.9),
    "bsl": ("bsl", 0.9),
    "busl": ("busl", 0.2),
    "cc-by": ("cc-by", 0.8),
    "cc-by-nc": ("cc-by-nc", 0.2),
    "cc-by-nc-nd": ("cc-by-nc", 0.1),
    "cc-by-nc-sa": ("cc-by-nc", 0.2),
    "cc-by-nd": ("cc-by-nd", 0.2),
    "cc-by-sa": ("cc-by-sa", 0.5),
    "cc0": ("cc0", 1.0),
    "cddl": ("cddl", 0.5),
    "cecill": ("cecill", 0.4),
    "cpl": ("cpl", 0.5),
    "ecl": ("ecl", 0.8),
    "epl": ("epl", 0.5),
    "eupl": ("eupl", 0.4),
    "gfdl": ("gfdl", 0.4),
    "gpl": ("gpl", 0.4),
    "isc": ("isc", 0.9),
    "lgpl": ("lgpl", 0.5),
    "lppl": ("lppl", 0.7),
    "mit": ("mit", 0.9),
    "mit-0": ("mit", 1.0),
    "mpl": ("mpl", 0.6),
    "ms-pl": ("ms-pl", 0.6),
    "mulanpsl": ("mulanpsl", 0.8),
    "ncsa": ("ncsa", 0.9),
    "odbl": ("odbl", 0.5),
    "ofl": ("ofl", 0.7),
    "openssl": ("openssl", 0.8),
    "osl": ("osl", 0.4),
    "pddl": ("pddl", 1.0),
    "php": ("php", 0.8),
    "postgresql": ("postgresql", 0.9),
    "psf": ("psf", 0.9),
    "python": ("psf", 0.9),
    "qpl": ("qpl", 0.4),
    "ruby": ("ruby", 0.8),
    "sspl": ("sspl", 0.2),
    "unicode": ("unicode", 0.9),
    "unlicense": ("public-domain", 1.0),
    "upl": ("upl", 0.9),
    "vim": ("vim", 0.7),
    "w3c": ("w3c", 0.9),
    "wtfpl": ("wtfpl", 1.0),
    "x11": ("mit", 0.9),
    "zlib": ("zlib", 0.9),
    "zpl": ("zpl", 0.8),
}
# What stands where an identifier would, but names none.
NAMELESS = ("license", "licence", "noassertion", "none", "see", "unlicensed")
#: What a tagged expression, a base phrase and a notice phrase say for a licence being there.
SURE = {"tag": 0.95, "base": 0.9, "notice": 0.7}
_BYTES = WORD.tobytes()
_TOKEN = re.compile(rb"[A-Za-z0-9][A-Za-z0-9.+:-]*|[()\n]")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_built: list = []


def automaton():
    if not _built:
        import ahocorasick

        out = ahocorasick.Automaton()
        for kind, found in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
            for phrase, label in found.items():
                out.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, kind, label))
        out.make_automaton()
        _built.append(out)
    return _built[0]


def operand(token: str) -> tuple[str, float] | None:
    """Label and openness of an identifier; a version and a trailing + or -only / -or-later do not matter."""
    name = re.sub(r"(-(only|or-later))?\+?$", "", token.lower())
    for known in (name, re.sub(r"-v?[0-9].*$", "", name), re.sub(r"-[0-9]+-clause$", "", name)):
        if known in LICENSES:
            return LICENSES[known]
    formed = not name.startswith(NAMELESS) and (re.search("[0-9]", token) or len(re.findall("[A-Z]", token)) > 1) and token[0].isalpha()
    return (name.strip(".+:-"), 0.5) if formed or name.startswith("licenseref-") else None


_RANK = {"or": 1, "and": 2, "with": 3}


def evaluate(text: str | bytes, at: int = 0) -> tuple[list[str], float, str] | None:
    """Labels, openness and reverse Polish form of the longest licence expression at place `at` of a line of text.

    or: the most open of two; and: the least open; with: an exception, which
    opens its licence by half of what it lacks. Nothing after the expression
    is read.
    """
    out: list[tuple[str, str]] = []
    wait: list[str] = []
    operands_due, after_with, inside = True, False, 0
    good: tuple[int, list[str]] | None = None  # so much of out, and the operators that wait behind it
    for m in _TOKEN.finditer(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text, at):
        token = m[0].decode()
        low = token.lower()
        if low == "\n":
            break
        if operands_due:
            if token == "(" and not after_with:
                wait.append("(")
                inside += 1
                continue
            if token in "()" or low in _RANK or (not after_with and operand(token) is None):
                break
            out.append(("exception" if after_with else "id", token))
            operands_due = after_with = False
        elif token == ")":
            if not inside:
                break
            inside -= 1
            while (x := wait.pop()) != "(":
                out.append(("op", x))
        elif low in _RANK:
            while wait and wait[-1] != "(" and _RANK[wait[-1]] >= _RANK[low]:
                out.append(("op", wait.pop()))
            wait.append(low)
            operands_due, after_with = True, low == "with"
            continue
        else:
            break
        if not inside:
            good = len(out), wait[::-1]  # three operators at most
    if not good:
        return None
    labels, stack = [], []
    whole = [*out[: good[0]], *(("op", x) for x in good[1])]
    for kind, token in whole:
        if kind == "id":
            label, open_ = operand(token)
            labels.append(label)
            stack.append(open_)
        elif kind == "exception":
            stack.append(0.0)
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(max(a, b) if token == "or" else min(a, b) if token == "and" else a + (1 - a) / 2)
    return labels, stack[0], " ".join(t for _, t in whole)


def scan(text: str) -> dict:
    """All that the scan finds in one text."""
    data = text.encode("utf-8", "surrogatepass")
    joined = re.sub(rb" {2,}", b" ", b" " + data.translate(_BYTES) + b" ").decode("latin-1")
    n_words = joined.count(" ") - 1
    hits = sorted((end + 1 - span, n, kind, label) for end, (span, n, kind, label) in automaton().iter(joined))
    base, labels, doubt, openness, expressions, spans = [], set(), 1.0, None, [], []
    at = number = passed = 0
    ends, end = None, 0
    for start, n, kind, label in hits:
        number += joined.count(" ", at, start)
        at = start
        if kind == "tag":
            if ends is None:
                ends = (m.end() for m in _WORD.finditer(data.translate(_BYTES)))
            while passed < number + n:  # tags are as long and come in order, so their ends do
                end = next(ends)
                passed += 1
            if (said := evaluate(data, end)) is None:
                continue
            labels.update(said[0])
            expressions.append(said[2])
            openness = said[1] if openness is None else min(openness, said[1])
        else:
            labels.add(label)
            if kind == "base":
                base.append((number, label))
            known = LICENSES.get(label.removesuffix("-2"), (label, 0.0 if label == "all-rights-reserved" else 1.0))[1]
            openness = known if openness is None else min(openness, known)
        spans.append({"first": number, "words": n, "kind": kind, "label": label})
        doubt *= 1 - SURE[kind]
    return {
        "n_words": n_words, "n_base": len(base), "first_word": min(base)[0] if base else None, "last_word": max(base)[0] if base else None,
        "base_labels": ",".join(sorted({x for _, x in base})), "labels": ",".join(sorted(labels)), "score": 1 - doubt, "openness": openness, "expressions": expressions, "spans": spans,
    }


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("kind", pa.string()), ("label", pa.string())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("openness", pa.float64()), ("expressions", pa.list_(pa.string())), ("spans", _SPANS)])


def license_scan(docs: DataFrame) -> DataFrame:
    """One row a document: words, base phrases, labels, score, openness, parsed expressions and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t) for t in text_column(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[f.name] for r in rows], f.type) for f in list(_SCHEMA)[1:])], schema=_SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, openness double, expressions array<string>, spans array<struct<first: long, words: long, kind: string, label: string>>")

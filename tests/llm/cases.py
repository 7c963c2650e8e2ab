"""Documents with everything that may go wrong, shared by the tests of the training-data operators."""

import re

PHRASE = "This work is Under the MIT license, and cc-by-nc too; Apache License, Version 2. "
LONG = "The quick brown Fox jumps over the lazy dog and runs on until the evening comes along. " * 700
ODD = [
    (1, "The cat and the dog were in the garden with a small idiot bird.", "en", "a", 5),
    (1, "The cat and the dog were in the garden with a small idiot bird.", "en", "a", 5),
    (2, None, None, None, 5),
    (3, "", "de", "b", 5),
    (4, "12 34 ### !!", None, "b", 5),
    (5, LONG, "en", "c", 5),
    (6, PHRASE * 3, "en", "c", 5),
    (7, "Der Hund und die Katze waren in dem Garten mit einem kleinen Vogel.", "de", "a", 5),
    (8, "Der Hund und die Katze waren in dem Garten mit einem kleinen Vogel.", "de", None, 5),
    (None, "le chien et le chat dans le jardin é è ü\tavec un oiseau\x0b", "fr", "é", 5),
    (9, "\x00\x01 zero \u2003 wide 𝔘nicode 語", None, "b", 5),
]
COLUMNS = "doc_id long, text string, lang string, source string, score int"


def docs(spark, rows=ODD):
    """A frame of ODD rows; score, lang and the like clash with what operators add."""
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def none(spark):
    return spark.createDataFrame([], COLUMNS)


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

"""SpotSigs fingerprints in DataFrame functions only.

A text's words (lower-cased runs of letters and digits) are content words or
anchors, the common words below. Each content word that follows an anchor
starts a chain of CHAIN content words; hashed chains are the text's signature
set, and sorted they are its fingerprint. A text without anchored chains takes
all its chains, one without words the hash of its whole text.

Likeness is the Jaccard index of two sets, pruned by set length: sets whose
lengths are in partitions too far apart cannot reach FLOOR and get 0.

Texts are shuffled once, by id; what a document needs of its successor (its
first characters and its signatures) goes back as one small row.

Defined cases: a null text is empty; equal texts are 1 alike; a
very long text is one row like any other; columns other than doc_id and text
do not matter; with one document only, it is its own next; ids that repeat are one place in the order,
whose least text is the successor of the id before; a null id comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

# The anchors, common words of four languages.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au aux avec dans de des du elle en est et il la le les pas pour que qui sur un une "
    "auf das dem den der des die ein eine einer ist mit nicht sich sie und von zu für "
    "con del el en es la las lo los no para por que se su un una y"
).split()
CHAIN, FLOOR = 2, 0.1
_FIRST = -(1 << 63)


def _anchor_pattern() -> str:
    """The anchors by first letter, so that most words are passed over at their first character."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(ANCHORS)):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(sorted(rest, reverse=True))})" for c, rest in sorted(by.items()))


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the sorted signature set (array<int>) of column `text` as `name`.

    Every word stands between blanks of its own; an anchor becomes #, and a row
    of # joins the word after it. Steps are columns of their own, so each is
    computed once; patterns repeat fixed lengths or single characters only, so
    long rows of anchors take no stack.
    """
    hashed = lambda chains: F.transform(chains, lambda c: F.xxhash64(c).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    more = "(?: +[^ ]+)?" * (CHAIN - 1)
    rows = df.withColumn("_spaced", F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "  "), F.lit("  ")))
    rows = rows.withColumn("_marked", F.regexp_replace(F.regexp_replace("_spaced", f" (?:{_anchor_pattern()}) ", " # "), "(?:#  )+", "#"))
    rows = rows.withColumn("_chains", F.regexp_extract_all("_marked", F.lit(f"#(?=([^ #]+{more}))"), F.lit(1)))
    every = F.regexp_extract_all("_spaced", F.lit(f" (?=([^ ]+{more}))"), F.lit(1))
    words = F.col("_spaced").rlike("[^ ]")
    found = F.when(F.size("_chains") > 0, hashed(F.col("_chains"))).when(words, hashed(every)).otherwise(hashed(F.array(F.col(text))))
    return rows.withColumn(name, F.array_sort(F.array_distinct(found))).drop("_spaced", "_marked", "_chains")


def fingerprint(found: Column) -> Column:
    """A signature set as text: 8 hexadecimal digits each."""
    return F.array_join(F.transform(found, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def length_partition(found: Column, ratio: float = FLOOR) -> Column:
    """Number of a set's length partition: sets two or more partitions apart have a length ratio, and so a likeness, under `ratio`."""
    return F.floor(F.log(F.greatest(F.size(found), F.lit(1))) / F.log(F.lit(1 / ratio))).cast("int")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two signature sets, 0 without a comparison if their lengths forbid FLOOR."""
    apart = F.abs(length_partition(a) - length_partition(b)) > 1
    short = F.least(F.size(a), F.size(b)) < F.greatest(F.size(a), F.size(b)) * FLOOR
    common = F.size(F.array_intersect(a, b))
    return F.when(apart | short, 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def successors(ids: DataFrame) -> DataFrame:
    """key and next of distinct keys in ascending order, the last one's next being the first; no task holds all of them."""
    placed = checkpointed(ids.distinct().repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    ends = placed.groupBy("part").agg(F.min("key").alias("least"))  # one row a partition
    order = Window.orderBy("part")
    ends = ends.withColumn("after", F.coalesce(F.lead("least").over(order), F.min("least").over(Window.partitionBy()))).select("part", "after")
    inner = F.lead("key").over(Window.partitionBy("part").orderBy("key"))
    return placed.withColumn("inner", inner).join(ends, "part").select("key", F.coalesce("inner", "after").alias("next"))


def spotsigs(docs: DataFrame) -> DataFrame:
    """The contract's rows, with the number of signatures and the length partition of each document."""
    key = F.coalesce("doc_id", F.lit(_FIRST))
    base = docs.select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    after = successors(base.select("key"))
    wanted = base.select("key", F.length("text").alias("n")).groupBy("key").agg(F.floor(F.max("n") / 4).cast("int").alias("q"))
    asked = after.join(wanted, "key").select(F.col("key").alias("asker"), F.col("next").alias("key"), "q")
    answers = base.join(asked, "key").select(F.col("asker").alias("key"), F.col("text").substr(F.lit(1), F.col("q")).alias("head"), "text")
    answers = with_signatures(answers, "text", "next_set").select("key", "head", F.sha2("text", 256).alias("of"), "next_set")
    answers = answers.groupBy("key").agg(F.min(F.struct("head", "of", "next_set")).alias("x")).select("key", "x.head", "x.next_set")
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - q), F.col("head").substr(F.lit(1), q))
    rows = base.join(answers, "key").select("key", n.cast("long").alias("n_chars"), "next_set", "text", edited.alias("edited"))
    rows = with_signatures(with_signatures(rows, "text", "own").drop("text"), "edited", "changed").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    return rows.select(
        F.when(F.col("key") != _FIRST, F.col("key")).alias("doc_id"), "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_set")).alias("near_next"), F.size("own").alias("n_signatures"), length_partition(F.col("own")).alias("length_partition"),
    )

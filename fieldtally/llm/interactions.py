"""Filter interaction audit by truth-table survival words.

Five filters fail documents: A (few words), B (few distinct words), C (many capitals), D
(signs), E (copy of a document with a smaller doc_id). Which of them a document fails decides for
each of the 32 subsets of filters whether it survives them, so a document is a 32-bit word with
one bit for each subset. Words are summed by position with carry-save adders: three words of one
weight become a sum and a carry, which keeps a few words for each power of two however
many documents there are. The survivors of the 32 subsets, of all, good and toxic documents of each
part, give every figure: what a filter removes after others is the difference of two subsets.

Work is shared as follows. Texts are read once; a slim row of each document meets its labels by
doc_id, and the rows of one text meet by its SHA-256. Rows of one text, label and part are
counted before they meet, so a text that a third of all documents repeat is a few rows, and its
word enters the adders at the powers of two of its count.

Edge cases: a null text is an empty one (no words: fails A only, and E if it has a smaller twin);
a null language is the part of the empty string. A null doc_id has no label and is no copy, nor makes others
copies. Rows that repeat a doc_id are documents each; neither is smaller, so they do not fail E by each other. A
doc_id labelled more than once is good (toxic) if any of its labels says so. A very long text is split into words
within its own row. An empty table gives no rows. Columns other than those named are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, whole

FILTERS = "ABCDE"
EVERY = (1 << len(FILTERS)) - 1
FEW_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, SIGNS = 200, 50, 3, "[#$%&*|]"
COPY = 1 << FILTERS.index("E")

# For each set of failed filters the subsets that a document survives: those without any of them.
SURVIVAL = np.array([sum(1 << s for s in range(EVERY + 1) if not s & failed) for failed in range(EVERY + 1)], np.uint32)


def failed_alone(text: Column) -> Column:
    """Bits of the filters A to D that a text fails by itself."""
    words = F.array_remove(F.split(text, f"{SPACES}+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (
        F.size(words) < FEW_WORDS,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT_SHARE,
        capitals.cast("long") * 100 > F.length(text).cast("long") * CAPITAL_SHARE,
        text.rlike(SIGNS),
    )
    out = F.lit(0)
    for i, fail in enumerate(fails):
        out = out + F.when(fail, 1 << i).otherwise(0)
    return out


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, failed (bits), n: how many documents have these."""
    text = whole(F.col("text"))
    slim = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("same"),
        failed_alone(text).alias("failed"),
        # Null ids have no label; they spread over tasks.
        F.when(F.col("doc_id").isNull(), F.spark_partition_id() + 1).otherwise(0).alias("salt"),
    )
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"), F.lit(0).alias("salt"))
    marks = marks.agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    key = ["same", "failed", "part", "good", "toxic"]
    known = slim.join(marks, ["id", "salt"], "left").fillna(False, ["good", "toxic"])
    once = known.groupBy(*key, "id", "salt").agg(F.count("*").alias("n"))
    met = once.groupBy(*key).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"),
    )
    smallest = F.min("least.id").over(Window.partitionBy("same"))
    first = F.when(F.col("least.id") == smallest, F.col("least.n")).otherwise(0) + F.col("unnamed")
    met = met.select(*key[1:], "n", first.alias("first"))
    sides = F.array(F.struct("failed", F.col("first").alias("n")), F.struct((F.col("failed") + COPY).alias("failed"), (F.col("n") - F.col("first")).alias("n")))
    return met.select("part", "good", "toxic", F.inline(sides)).where("n > 0")


class Adder:
    """Positional counts of 32-bit words. ``planes[k]`` holds the words that count 2^k: two at most at rest."""

    def __init__(self) -> None:
        self.planes: list[np.ndarray] = []

    def add(self, words: np.ndarray, plane: int = 0) -> None:
        while len(self.planes) <= plane:
            self.planes.append(np.zeros(0, np.uint32))
        words = np.concatenate((self.planes[plane], words))
        carries = []
        while len(words) > 2:
            n = len(words) // 3
            a, b, c = words[:n], words[n : 2 * n], words[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate((half ^ c, words[3 * n :]))
        self.planes[plane] = words
        if carries:
            self.add(np.concatenate(carries), plane + 1)

    def counts(self) -> list[int]:
        return [sum(sum(int(w) >> bit & 1 for w in words) << k for k, words in enumerate(self.planes)) for bit in range(32)]


SURVIVORS = "part string, good boolean, toxic boolean, subset int, survivors long"


def _counted(batches):
    adders: dict[tuple, Adder] = {}
    for batch in batches:
        for key, some in batch.to_pandas().groupby(["part", "good", "toxic"]):
            adder = adders.setdefault(key, Adder())
            words, times = SURVIVAL[some["failed"].to_numpy()], some["n"].to_numpy()
            for k in range(int(times.max()).bit_length()):
                adder.add(words[(times >> k) & 1 == 1], k)
    out = [(*key, s, n) for key, adder in adders.items() for s, n in enumerate(adder.counts())]
    cols = list(zip(*out)) if out else [()] * 5
    kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "good", "toxic", "subset", "survivors"])


def survivors(failed: DataFrame) -> DataFrame:
    """part, of: for each part an array by subset of how many of all, good and toxic documents survive it."""
    rows = [F.sum(F.when(c, F.col("survivors")).otherwise(0)).alias(n) for n, c in (("n", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))]
    sums = failed.mapInArrow(_counted, SURVIVORS).groupBy("part", "subset").agg(*rows)
    return sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("of"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with what is kept, removed and lost there.

    shapley is what a filter removes, summed over all orders: each subset of the other filters goes
    before it in as many orders as there are ways to order those before and those after.
    """
    of = F.col("of")
    shapley = []
    for i in range(len(FILTERS)):
        terms = F.lit(0).cast("long")
        for s in range(EVERY + 1):
            if not s >> i & 1:
                ways = factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())
                terms = terms + (of[s]["n"] - of[s | 1 << i]["n"]) * ways
        shapley.append(terms)
    parts = survivors(failures(docs, labels)).select("part", "of", F.array(*shapley).alias("values"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = parts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    gone, bit = F.lit(0), F.lit(0)
    for i, x in enumerate(FILTERS):
        at = F.locate(x, F.col("filter_order"))
        gone = gone + F.when(at < F.col("step"), 1 << i).otherwise(0)
        bit = bit + F.when(at == F.col("step"), 1 << i).otherwise(0)
    steps = steps.withColumns({"bit": bit, "before": gone})
    before, after, none, alone, others, every = (F.get("of", i) for i in (F.col("before"), F.col("before") + F.col("bit"), F.lit(0), F.col("bit"), F.lit(EVERY) - F.col("bit"), F.lit(EVERY)))
    removed = before["n"] - after["n"]
    return steps.select(
        "part",
        "filter_order",
        "step",
        after["n"].alias("kept"),
        removed.alias("removed"),
        (none["n"] - alone["n"] - removed).alias("redundant"),
        (others["n"] - every["n"]).alias("unique_fails"),
        (before["good"] - after["good"]).alias("good_lost"),
        (before["toxic"] - after["toxic"]).alias("toxic_lost"),
        F.get("values", F.log2("bit").cast("int")).alias("shapley"),
    )

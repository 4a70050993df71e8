"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised to words (A-Z in lower case; ASCII other
than letters and digits separates). Their windows of 13 words, or the whole item if it
is shorter, are the automaton's patterns, over numbers that stand for the benchmark's
words. Each text is normalised the same way and scanned once; a word that no item
has is number 0 and sends the automaton back to its root. Hits are counted in words,
and their spans are mapped back to code points of the original text.

The windows are broadcast only up to ``BLOCK_ITEMS`` items at a time: a larger
benchmark is scanned in blocks of items, each by an automaton of its own.

Edge cases: a null or empty text or item has no words and no hits. Items that repeat
count once for each item_id; rows that repeat an item_id add their windows to it. A
window that several items share counts for each of them. Rows that repeat a
doc_id each get their row. An empty benchmark hits nothing. Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import batches

WINDOW = 13
BLOCK_ITEMS = 20_000
# A-Z to lower case, what separates words to spaces.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_built: dict[str, tuple] = {}

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("items", T.ArrayType(T.LongType())),
        T.StructField("hit_words", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    # After the table only spaces are left of what split() takes for white space.
    return text.translate(_NORMAL).split()


def build(items: list[tuple[int, bytes]], window: int = WINDOW):
    """Numbers of the benchmark's words, the automaton over its windows, and
    the length of the shortest.

    A pattern's value is its length and the items that have it.
    """
    number: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[int]] = {}
    for item, text in items:
        codes = tuple(number.setdefault(w, len(number) + 1) for w in words_of(text))
        if not codes:
            continue
        size = min(window, len(codes))
        for at in range(len(codes) - size + 1):
            owners.setdefault(codes[at : at + size], set()).add(item)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for codes, who in owners.items():
        automaton.add_word(codes, (len(codes), tuple(sorted(who))))
    if owners:
        automaton.make_automaton()
    return number, automaton if owners else None, min(map(len, owners), default=1)


def scan(text: bytes, number: dict[bytes, int], automaton, shortest: int = 1) -> tuple[int, list[int], list[tuple[int, int]]]:
    """Words of the text, items with a window in it, and ranges of hit words."""
    words = words_of(text)
    if automaton is None:
        return len(words), [], []
    get = number.get
    codes = [get(w, 0) for w in words]
    code = np.array([0, *codes, 0], np.int32)
    known = code > 0
    begin, end = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(known[:-1] & ~known[1:])
    long = end - begin >= shortest  # an unknown word leads back to the root: runs are scanned one by one
    items: set[int] = set()
    ranges: list[list[int]] = []
    for at, stop in zip(begin[long].tolist(), end[long].tolist()):
        for last, (size, who) in automaton.iter(tuple(codes[at:stop])):
            items.update(who)
            first, last = at + last - size + 1, at + last
            # Ends come in ascending order; a longer pattern may begin before earlier ranges.
            while ranges and ranges[-1][1] >= first:
                first = min(first, ranges.pop()[0])
            ranges.append([first, last + 1])
    return len(words), sorted(items), [tuple(r) for r in ranges]


def original_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets in the original text of ranges of words."""
    if not ranges:
        return []
    places = np.array([m.span() for m in _WORD.finditer(text)])
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    code_point = np.concatenate(([0], np.cumsum(lead)))
    return [(int(code_point[places[a, 0]]), int(code_point[places[b - 1, 1]])) for a, b in ranges]


def _automaton(key: str, items: list[tuple[int, bytes]], window: int):
    if key not in _built:
        _built.clear()
        _built[key] = build(items, window)
    return _built[key]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``keep`` columns (doc_id if none are named) and for each document
    n_words, n_hit, items, hit_words (ranges of words) and spans (code points),
    their names after ``prefix``."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).where(F.col("text").isNotNull())
    # In a fixed order and a block at a time; one block for most benchmarks.
    listed = sorted((r[0] if r[0] is not None else -1, bytes(r[1])) for r in items.toLocalIterator())
    blocks = [listed[k : k + BLOCK_ITEMS] for k in range(0, len(listed), BLOCK_ITEMS)] or [[]]
    columns = keep or ["doc_id"]
    slim = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast("binary").alias("_bytes"))
    made_fields = [T.StructField(prefix + f.name, f.dataType) for f in RESULT.fields]
    schema = T.StructType(list(slim.drop("_bytes").schema.fields) + made_fields)
    held = []
    for block in blocks:
        key = hashlib.sha256(repr((window, block)).encode()).hexdigest()
        held.append((key, spark.sparkContext.broadcast(block)))

    def scanned(parts):
        for batch in parts:
            for rows, texts in batches(batch, "_bytes"):
                here = batch.slice(rows.start, len(texts))
                found = [(0, set(), [])] * len(texts)
                for key, block in held:
                    built = _automaton(key, block.value, window)
                    one = [scan(t, *built) for t in texts]
                    found = [(n, seen | set(items), _joined(old + ranges)) for (n, items, ranges), (_, seen, old) in zip(one, found)]
                out = [
                    {"n_words": n, "items": sorted(items), "hit_words": [{"first": a, "end": b} for a, b in ranges], "spans": [{"start": a, "end": b} for a, b in original_spans(t, ranges)]}
                    for t, (n, items, ranges) in zip(texts, found)
                ]
                made = [pa.array([r[f.name] for r in out], _arrow[f.name]) for f in RESULT.fields]
                yield pa.RecordBatch.from_arrays([here.column(i) for i in range(len(columns))] + made, schema.fieldNames())

    n_hit = F.aggregate(f"{prefix}hit_words", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["first"])
    return slim.mapInArrow(scanned, schema).withColumn(f"{prefix}n_hit", n_hit)


_arrow = {
    "n_words": pa.int64(),
    "items": pa.list_(pa.int64()),
    "hit_words": pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])),
    "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
}


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """At least one word is hit, and at least one in twenty."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))

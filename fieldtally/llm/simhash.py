"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprints are made per text; equal ones collapse to one row each before
anything is compared. Two fingerprints of 64 bits that differ in at most 3 agree on
at least one of four blocks of 16 bits. So each fingerprint is dealt out four times,
rotated so that another block stands first, by that block; no bit may differ there,
which makes its value a node of the trie that meets only itself. Below it pairs of
nodes are walked together, one bit at a time: children that continue with the
same bit keep their error, others add one, and a pair over the budget of 3 is pruned.
Only pairs of leaves are compared by all their bits.

A node's links are returned as a spanning forest of what the walk links, not as
all pairs: components are the same. Components are found by alternating
large-star and small-star steps over the links until they rest.

Edge cases: null and empty texts, and texts without words, have fingerprint
zero and link like any other. Rows that repeat a doc_id each get their row. A
component whose doc_ids are all null has a null component_id. An empty table gives
an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import batches
from .shared import stored, whole

SHINGLE = 3
BUDGET = 3
BLOCK = 16
SEED = 42
DIRECT = 1  # pairs of a node pair that are compared without walking on: two leaves
_FRONT = 1 << 16  # node pairs that are walked at a time
_PIECE = 1 << 15  # shingles whose bits are counted at a time


def fingerprint(text: bytes) -> int:
    """64 bits as an unsigned number; bit set if set in over half the shingles."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    counts = np.zeros(64, np.int64)
    n = len(words) - SHINGLE + 1
    for at in range(0, n, _PIECE):
        begins, stops = start[at : min(n, at + _PIECE)].tolist(), end[at + 2 : at + 2 + _PIECE].tolist()
        h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(begins, stops)), np.uint64, len(begins))
        counts += bits_set(h)
    return majority(counts, n)


def bits_set(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and ``keep`` (long columns) of every document."""
    names = ["doc_id", *(keep or [])]

    def made(parts):
        for batch in parts:
            for rows, texts in batches(batch):
                here = batch.slice(rows.start, len(texts))
                fp = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[here.column(c) for c in names], pa.array(fp)], [*names, "fp"])

    slim = docs.select(*[F.col(c).cast("long").alias(c) for c in names], F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(made, ", ".join(f"{c} long" for c in [*names, "fp"]))


def _forest(a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> tuple[list[int], list[int]]:
    """Those links a-b that join two trees so far; parent is changed."""
    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = x, y
        while parent[rx] != rx:
            parent[rx] = parent[parent[rx]]
            rx = parent[rx]
        while parent[ry] != ry:
            parent[ry] = parent[parent[ry]]
            ry = parent[ry]
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            left.append(x)
            right.append(y)
    return left, right


def trie_links(values: np.ndarray, depth: int = BLOCK, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs within ``budget`` bits of each other.

    ``values`` are sorted different 64-bit numbers; pairs must agree on the first
    ``depth`` bits. A node is a range of the sorted values. Returned are indices.
    """
    n = len(values)
    parent = list(range(n))
    left: list[int] = []
    right: list[int] = []
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = values >> np.uint64(64 - depth)
    edge = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1], [True])))
    lo, hi = edge[:-1], edge[1:]
    # Node pairs: ranges of both nodes and the bits that differ so far. Pieces of a level wait
    # while one is walked down, so that memory is bounded by the trie's height.
    waiting = [(63 - depth, (lo, hi, lo, hi, np.zeros(len(lo), np.int64)))]
    while waiting:
        bit, pairs = waiting.pop()
        if len(pairs[0]) > _FRONT:
            waiting.append((bit, tuple(x[_FRONT:] for x in pairs)))
            pairs = tuple(x[:_FRONT] for x in pairs)
        a0, a1, b0, b1, err = pairs
        many = (a1 - a0) * (b1 - b0)
        alone = (a0 == b0) & (a1 - a0 < 2)
        direct = ~alone & ((many <= DIRECT) | (bit < 0))
        if direct.any():
            _compare(values, a0[direct], a1[direct], b0[direct], b1[direct], budget, parent, left, right)
        walk = ~alone & ~direct
        a0, a1, b0, b1, err = (x[walk] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        cut_a, cut_b = _split(values, a0, a1, bit), _split(values, b0, b1, bit)
        same = a0 == b0
        children = [
            (a0, cut_a, b0, cut_b, err, True),
            (cut_a, a1, cut_b, b1, err, True),
            (a0, cut_a, cut_b, b1, err + 1, True),
            (cut_a, a1, b0, cut_b, err + 1, ~same),  # a node with itself: once is enough
        ]
        grown = []
        for x0, x1, y0, y1, e, ok in children:
            ok = (e <= budget) & (x1 > x0) & (y1 > y0) & ok
            grown.append((x0[ok], x1[ok], y0[ok], y1[ok], e[ok]))
        waiting.append((bit - 1, tuple(np.concatenate(x) for x in zip(*grown))))
    return np.array(left, np.int64), np.array(right, np.int64)


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where each range goes over from 0 to 1 in this bit."""
    above = (values[lo] >> np.uint64(bit + 1)) << np.uint64(bit + 1)
    return np.clip(np.searchsorted(values, above | np.uint64(1 << bit)), lo, hi)


def _compare(values, a0, a1, b0, b1, budget, parent, left, right, most: int = 1 << 20) -> None:
    """All value pairs of small node pairs, some at a time."""
    at, each = 0, (a1 - a0) * (b1 - b0)
    total = np.cumsum(each)
    while at < len(each):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        count = each[at:stop]
        pair = np.repeat(np.arange(at, stop), count)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        width = (b1 - b0)[pair]
        x, y = a0[pair] + k // width, b0[pair] + k % width
        ok = x < y
        x, y = x[ok], y[ok]
        near = np.bitwise_count(values[x] ^ values[y]) <= budget
        new_left, new_right = _forest(x[near], y[near], parent)
        left += new_left
        right += new_right
        at = stop


def links(distinct: DataFrame, parts: int | None = None) -> DataFrame:
    """fp_a, fp_b: a spanning forest per trie of the links of different fingerprints."""
    turns = []
    for k in range(64 // BLOCK):
        n = k * BLOCK
        v = F.shiftleft("fp", n).bitwiseOR(F.shiftrightunsigned("fp", 64 - n)) if k else F.col("fp")
        turns.append(F.struct(F.lit(k).alias("turn"), v.alias("v")))
    turned = distinct.select(F.explode(F.array(*turns)).alias("t")).select("t.turn", "t.v")
    turned = turned.withColumn("block", F.shiftrightunsigned("v", 64 - BLOCK))
    dealt = turned.repartition(parts, "turn", "block") if parts else turned.repartition("turn", "block")
    dealt = dealt.sortWithinPartitions("turn", "block", "v").select("turn", "block", "v")

    def found(turn: int, values: np.ndarray):
        values = np.sort(values.view(np.uint64))
        a, b = trie_links(values)
        if len(a):
            back = np.uint64(turn * BLOCK)
            plain = values if turn == 0 else (values >> back) | (values << (np.uint64(64) - back))
            plain = plain.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(plain[a]), pa.array(plain[b])], ["fp_a", "fp_b"])

    def joined(batches_in):
        """Whole blocks only; the last of a batch waits for the next batch."""
        held_turn, held = -1, np.zeros(0, np.int64)
        last_block = -1
        for batch in batches_in:
            turn, block = batch.column("turn").to_numpy(), batch.column("block").to_numpy()
            v = batch.column("v").to_numpy()
            if not len(v):
                continue
            edge = np.flatnonzero(np.concatenate(([True], turn[1:] != turn[:-1], [True])))
            for lo, hi in zip(edge[:-1], edge[1:]):
                if turn[lo] != held_turn:
                    yield from found(held_turn, held)
                    held_turn, held, last_block = int(turn[lo]), np.zeros(0, np.int64), -1
                whole = lo + int(np.searchsorted(block[lo:hi], block[hi - 1]))  # the last block starts here
                if block[hi - 1] != last_block:
                    yield from found(held_turn, np.concatenate([held, v[lo:whole]]))
                    held = v[whole:hi]
                else:
                    held = np.concatenate([held, v[lo:hi]])
                last_block = block[hi - 1]
        yield from found(held_turn, held)

    return dealt.mapInArrow(joined, "fp_a long, fp_b long")


def components(edges: DataFrame, a: str = "fp_a", b: str = "fp_b") -> DataFrame:
    """node, root: the smallest node reachable, for nodes that have a link.

    Large-star links every larger neighbour to a node's smallest neighbour,
    small-star every smaller one; both keep connectivity. Rounds end when no link
    changes, which takes about the logarithm of the longest path.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct(), "links")
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sums == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = sums


def dedup_classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every document."""
    prints = stored(fingerprints(docs), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_print = stored(rooted.join(smallest, "root").select("fp", "component_id"), "classes")
    return prints.join(of_print, "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: of the smallest doc_id (null last), then the smallest text hash.

    Rows are told apart by doc_id and text, so different texts that share a doc_id, or
    have none, are documents of their own. Of rows that repeat both, one stays.
    """
    prints = fingerprints(docs.select("doc_id", "text", text_key(docs).alias("text_key")), ["text_key"])
    distinct = stored(prints.groupBy("fp").agg(first_row().alias("first")), "distinct-fingerprints")
    return rows_of_components(docs, distinct, "fp", components(links(distinct.select("fp"))))


def text_key(docs: DataFrame) -> Column:
    return F.xxhash64(whole(docs["text"]))


def first_row() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))


def rows_of_components(docs: DataFrame, distinct: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are first in their component; ``distinct`` has a key's first row."""
    rooted = distinct.join(roots, distinct[key] == roots.node, "left").select(F.coalesce("root", key).alias("root"), "first")
    first = rooted.groupBy("root").agg(F.min("first").alias("first"))
    keep = stored(first.select("first.no_id", F.coalesce("first.doc_id", F.lit(0)).alias("id"), F.col("first.text_key").alias("row_key")), "kept")
    id = docs["doc_id"].cast("long")
    marked = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("given"), id.isNull().alias("no_id"), F.coalesce(id, F.lit(0)).alias("id"), text_key(docs).alias("row_key"))
    # Null ids are set apart in a column, so that both steps have the same keys: whole rows are shuffled once.
    on = ["no_id", "id", "row_key"]
    return marked.dropDuplicates(on).join(keep, on, "left_semi").select("given.*")

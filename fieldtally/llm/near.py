"""Near duplicates by Jaccard similarity of word shingles.

Texts of the same words collapse to one row first. Each gets a SimHash fingerprint of its shingles, and fingerprints
that differ in at most three bits are linked by the trie of :mod:`simhash`; texts of one fingerprint are linked to its first.
Most pairs of similarity 0.8 differ in more bits, so that texts are also sketched by the least
of their shingle hashes under ``BANDS`` x ``ROWS`` permutations, a byte of each. Texts that
agree on all bytes of a band meet in one bucket; a pair of similarity s does so in
some band with probability 1 - (1 - s^ROWS)^BANDS, 0.9998 at 0.8 (64-bit SimHash
would need a budget of 17 or more of 64 bits for that, where blocks no longer narrow the
search). Within a bucket sketches are compared: up to ``SMALL`` texts all pairs that look similar
are candidates, above it the strongest spanning forest of them, so that candidates grow
with the bucket's texts and not with its pairs. Candidates of both kinds are then held
against their whole shingle sets. Where the pairs that pass leave a large bucket in several
components, its strays, the texts outside of the largest one, are held against all texts of the bucket that
look similar and are not joined to them yet, on their whole sets: no link is lost to the forest. That work is dealt in
tiles of ``TILE`` strays by ``TILE`` texts and grows with what the forest did not join.
Components of all pairs that pass give the rows to keep.

Edge cases: texts without words, null ones among them, are copies of each other. A
text of fewer words than a shingle is one shingle. A very long text is shingled some words at a time, and its set
is held whole where it is compared. An empty table gives an empty result. Extra columns are passed on, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import batches
from .shared import stored
from .simhash import SEED, bits_set, components, first_row, links, majority, rows_of_components, text_key

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 4
SLACK = 0.2  # four standard deviations of a sketch's similarity
SMALL = 32
TILE = 256
_PIECE = 1 << 14
_DRAWS = np.random.default_rng(SEED)
_FLIP = _DRAWS.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _DRAWS.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(line: bytes, words: list[bytes], size: int):
    """Hashes of the runs of ``size`` words of ``line``, some at a time."""
    if len(words) <= size:
        yield np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
        return
    digest = xxhash.xxh64_intdigest
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(length) - 1
    start = end - length + 1
    n = len(words) - size + 1
    for at in range(0, n, _PIECE):
        stop = min(n, at + _PIECE)
        places = zip(start[at:stop].tolist(), end[at + size - 1 : stop + size - 1].tolist())
        yield np.fromiter((digest(line[a:b], SEED) for a, b in places), np.uint64, stop - at)


def sketch(parts) -> tuple[bytes, int]:
    """The sketch and the fingerprint of a text's shingle hashes."""
    least, counts, n = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64), np.zeros(64, np.int64), 0
    for h in parts:
        for k in range(BANDS * ROWS):
            least[k] = min(least[k], ((h ^ _FLIP[k]) * _TIMES[k]).min())
        counts, n = counts + bits_set(h), n + len(h)
    return ((least >> np.uint64(16)) & np.uint64(255)).astype(np.uint8).tobytes(), majority(counts, n)


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, the hash of all words (``words``), the sketch and the fingerprint (``fp``) of every row."""

    def made(parts):
        for batch in parts:
            for rows, texts in batches(batch):
                here = batch.slice(rows.start, len(texts))
                keys, sketches, prints = [], [], []
                for text in texts:
                    words = text.lower().split()
                    line = b" ".join(words)
                    keys.append(xxhash.xxh64_intdigest(line, SEED))
                    least, fp = sketch(shingles(line, words, size))
                    sketches.append(least)
                    prints.append(fp if words else 0)
                words_key, fps = (np.array(x, np.uint64).view(np.int64) for x in (keys, prints))
                columns = [here.column("doc_id"), here.column("text_key"), pa.array(words_key), pa.array(sketches, pa.binary()), pa.array(fps)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "words", "sketch", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs).alias("text_key"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(made, "doc_id long, text_key long, words long, sketch binary, fp long")


def trie_pairs(distinct: DataFrame) -> DataFrame:
    """a, b (a < b): word keys of texts of one fingerprint with its first text, and of first texts whose fingerprints the trie links."""
    prints = stored(distinct.groupBy("fp").agg(F.min("words").alias("least")), "fingerprints")
    equal = distinct.select("fp", "words").join(prints, "fp").select("least", "words")
    of_a, of_b = (prints.select(F.col("fp").alias(f"fp_{x}"), F.col("least").alias(x)) for x in "ab")
    linked = links(prints.select("fp")).join(of_a, "fp_a").join(of_b, "fp_b").select("a", "b")
    both = equal.union(linked).toDF("a", "b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")


def bucket_pairs(sketches: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``sketches`` to look at: all, or the strongest spanning forest."""
    n = len(sketches)
    if n <= SMALL:
        a, b = np.triu_indices(n, 1)
        near = (sketches[a] == sketches[b]).mean(axis=1) >= least
        return a[near], b[near]
    left, right = [], []
    rest, best, of = np.arange(1, n), np.full(n - 1, -1.0), np.zeros(n - 1, np.int64)
    last = 0
    while len(rest):  # Prim: the row that is most similar to any reached one is next
        like = (sketches[rest] == sketches[last]).mean(axis=1)
        of = np.where(like > best, last, of)
        best = np.maximum(like, best)
        k = int(best.argmax())
        last = int(rest[k])
        if best[k] >= least:
            left.append(int(of[k]))
            right.append(last)
        rest, best, of = np.delete(rest, k), np.delete(best, k), np.delete(of, k)
    return np.array(left, np.int64), np.array(right, np.int64)


def candidates(distinct: DataFrame, similarity: float) -> DataFrame:
    """a, b (a < b): word keys of texts whose sketches meet and look similar."""
    dealt = distinct.select(F.explode(F.array(*_banded("sketch"))).alias("bucket"), "words", "sketch").repartition("bucket").sortWithinPartitions("bucket", "words")
    least = similarity - SLACK

    def joined(parts):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BANDS * ROWS), np.uint8))

        def found(bucket, words, sketches):
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            some = np.flatnonzero(np.diff(edge) > 1)
            a, b = [], []
            for lo, hi in zip(edge[some].tolist(), edge[some + 1].tolist()):
                x, y = bucket_pairs(sketches[lo:hi], least)
                a.append(words[lo:hi][x])
                b.append(words[lo:hi][y])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            return None

        for batch in parts:
            if not batch.num_rows:
                continue
            sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
            now = (batch.column("bucket").to_numpy(), batch.column("words").to_numpy(), sketches)
            now = tuple(np.concatenate(x) for x in zip(held, now))
            whole = int(np.searchsorted(now[0], now[0][-1]))  # the last bucket waits for the next batch
            held = tuple(x[whole:] for x in now)
            if whole and (out := found(*(x[:whole] for x in now))) is not None:
                yield out
        if len(held[0]) and (out := found(*held)) is not None:
            yield out

    return dealt.mapInArrow(joined, "a long, b long").distinct()


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """words and the different shingle hashes of each text."""

    def made(parts):
        for batch in parts:
            for rows, texts in batches(batch):
                sets = []
                for text in texts:
                    words = text.lower().split()
                    sets.append(np.unique(np.concatenate(list(shingles(b" ".join(words), words, size)))).view(np.int64))
                here = batch.slice(rows.start, len(texts))
                yield pa.RecordBatch.from_arrays([here.column("words"), pa.array(sets, pa.list_(pa.int64()))], ["words", "shingles"])

    return texts.mapInArrow(made, "words long, shingles array<long>")


def _banded(sketch) -> list:
    return [F.xxhash64(F.lit(k), F.substring(sketch, k * ROWS + 1, ROWS)) for k in range(BANDS)]


def sets_of(docs: DataFrame, distinct: DataFrame, meant: DataFrame, size: int) -> DataFrame:
    """words and shingles of the texts that ``meant`` (words) names."""
    meant = meant.join(distinct, "words").select("words", F.col("first.doc_id").alias("_doc"), F.col("first.text_key").alias("_key"))
    on = docs["doc_id"].cast("long").eqNullSafe(F.col("_doc")) & (text_key(docs) == F.col("_key"))
    texts = docs.select("doc_id", "text").join(meant, on).select("words", F.col("text").cast("binary").alias("text"))
    return stored(shingle_sets(texts, size).dropDuplicates(["words"]), "shingles")


def near_links(docs: DataFrame, distinct: DataFrame, size: int, similarity: float) -> DataFrame:
    """a, b: candidates whose shingle sets have at least the Jaccard similarity."""
    pairs = stored(trie_pairs(distinct).union(candidates(distinct, similarity)).distinct(), "near-candidates")
    sets = sets_of(docs, distinct, pairs.select(F.explode(F.array("a", "b")).alias("words")).distinct(), size)
    a = sets.select(F.col("words").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("words").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    every = F.size("of_a") + F.size("of_b") - both
    return pairs.join(a, "a").join(b, "b").where(both >= F.lit(similarity) * every - 1e-9).select("a", "b")


def _tile(similarity: float):
    """Links of a tile's strays with its texts, a forest over the components known so far."""

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        stray, near = rows[rows["stray"]], rows[~rows["stray"]]
        boss: dict[int, int] = {}

        def top(x: int) -> int:
            while boss.get(x, x) != x:
                x = boss[x]
            return x

        sketches = np.frombuffer(b"".join(near["sketch"]), np.uint8).reshape(-1, BANDS * ROWS)
        words, roots, sets = near["words"].to_numpy(), near["root"].tolist(), near["shingles"].tolist()
        out = []
        for key, root, band, sketch, own in zip(stray["words"], stray["root"], stray["band"], stray["sketch"], stray["shingles"]):
            same = sketches == np.frombuffer(sketch, np.uint8)
            like = same.mean(axis=1)
            # A pair that meets in several buckets is looked at in the first.
            first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
            for j in sorted(np.flatnonzero((like >= similarity - SLACK) & (first == band)).tolist(), key=lambda j: -like[j]):
                one, two = top(root), top(roots[j])
                if one != two:
                    both = len(np.intersect1d(own, sets[j], assume_unique=True))
                    if both >= similarity * (len(own) + len(sets[j]) - both) - 1e-9:
                        boss[max(one, two)] = min(one, two)
                        out.append((min(key, int(words[j])), max(key, int(words[j]))))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return linked


def stray_links(docs: DataFrame, distinct: DataFrame, roots: DataFrame, size: int, similarity: float) -> DataFrame:
    """a, b: further links in buckets of more than ``SMALL`` texts that ``roots`` leaves in several components."""
    rooted = distinct.join(roots, distinct.words == roots.node, "left").select("words", "sketch", F.coalesce("root", "words").alias("root"))
    rows = rooted.select("words", "root", "sketch", F.posexplode(F.array(*_banded("sketch"))).alias("band", "bucket"))
    parts = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    large = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "root")).alias("main"))
    large = large.where((F.col("n") > SMALL) & (F.col("parts") > 1)).select("bucket", F.col("main.root").alias("main"), F.ceil(F.col("n") / TILE).cast("int").alias("across"), F.ceil((F.col("n") - F.col("main.n")) / TILE).cast("int").alias("down"))
    found = stored(rows.join(large, "bucket"), "near-strays")
    sets = sets_of(docs, distinct, found.select("words").distinct(), size)
    place = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "words"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["bucket", "band", "words", "root", "sketch"]
    texts = found.select(*columns, F.lit(False).alias("stray"), place("across", 1).alias("column"), each("down").alias("row"))
    strays = found.where("root <> main").select(*columns, F.lit(True).alias("stray"), place("down", 2).alias("row"), each("across").alias("column"))
    tiles = texts.unionByName(strays).join(sets, "words")
    return tiles.groupBy("bucket", "row", "column").applyInPandas(_tile(similarity), "a long, b long")


def one_of_each(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component of near copies: of the smallest doc_id (null last), then the
    smallest text hash. Of rows that repeat doc_id and text, one stays."""
    rows = sketched(docs, size)
    distinct = stored(rows.groupBy("words").agg(first_row().alias("first"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp")), "sketches")
    links = stored(near_links(docs, distinct, size, similarity), "near-links")
    roots = components(links, "a", "b")
    more = stored(stray_links(docs, distinct, roots, size, similarity), "near-links")
    if not more.isEmpty():
        roots = components(links.unionByName(more), "a", "b")
    return rows_of_components(docs, distinct, "words", roots)

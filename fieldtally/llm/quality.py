"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates.

A text's features are its words and sign runs and their pairs, hashed into
``2**BITS`` buckets; a token that repeats the one before counts as one fixed
pair, so that repetition is learned whatever the word. A feature's value is
its share of the text's n-grams. Training is the follow-the-regularised-leader
update with one learning rate per coordinate over a bounded sample of labelled
rows; a score is the sparse dot product through the logistic function.

Edge cases: a null or empty text has the bias as its only feature. Labels
that are null, or whose document is missing, are not used. Rows that repeat a
doc_id are scored each. An empty table gives an empty result; without any
usable label every score is 0.5. Only doc_id and text of the documents are
read, so extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Tokens, mixed

BITS = 20
SAMPLE_PER_CLASS = 4000  # labelled rows of each class that training takes at most
SENT_ROWS = 100_000  # labels that are broadcast; the texts of more are shuffled
EPOCHS = 4
_SAME = np.uint64(0x5851F42D4C957F2D)


def usable_labels(labels: DataFrame, label: str, train: Column) -> DataFrame:
    """doc_id, label (0 or 1) and order, a hash of doc_id, of the rows that training may use."""
    usable = labels.where(train & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(label).cast("int").alias("label"), F.xxhash64("doc_id").alias("order")
    )
    return usable.where(F.col("label").isin(0, 1)).distinct()


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, train: Column, *more: str) -> DataFrame:
    """Texts of all labelled rows.

    Up to ``SENT_ROWS`` labels are sent to the texts. More are joined by a shuffle, with the texts
    that a bitmap of the labels' ids lets pass: all that are labelled and a few others."""
    usable = usable_labels(labels, label, train)
    texts = docs.select("doc_id", "text", *more)
    n = usable.count()
    if n <= SENT_ROWS:
        return texts.join(F.broadcast(usable), "doc_id")
    return passing(texts, usable, n).join(usable, "doc_id")


def passing(texts: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """Rows of ``texts`` whose doc_id is among the ``n`` of ``keys``, and some whose is not.

    Four bits of a bitmap stand for an id. It has 16 bits an id or more, and 8 MB at most."""
    size = min(26, max(10, (16 * n).bit_length()))
    bits = [F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(k)), 64 - size) for k in range(4)]
    ones = keys.select(F.explode(F.array(*bits)).alias("bit"))
    filled = ones.groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("ones")).toArrow()
    bitmap = np.zeros(1 << (size - 6), np.int64)
    bitmap[filled["cell"].to_numpy()] = filled["ones"].to_numpy()
    held = texts.sparkSession.createDataFrame(pa.table({"_bitmap": pa.array([bitmap], pa.list_(pa.int64()))}))
    known = [F.getbit(F.get("_bitmap", F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1 for b in bits]
    return texts.join(F.broadcast(held), known[0] & known[1] & known[2] & known[3], "left_semi")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, *more: str) -> DataFrame:
    """Texts of at most ``per_class`` labelled rows for each of 0 and 1.

    The rows with the smallest hashes are taken, so the sample does not depend on
    partitioning. It has at most two times ``per_class`` rows, so it may be broadcast.
    """
    usable = usable_labels(labels, label, train)
    picked = None
    for value in (0, 1):
        rows = usable.where(F.col("label") == value).orderBy("order", "doc_id").limit(per_class)
        picked = rows if picked is None else picked.unionByName(rows)
    return docs.select("doc_id", "text", *more).join(F.broadcast(picked), "doc_id")


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts and where each text's begin."""
    tokens = Tokens([t.decode("utf-8", "replace").lower().encode() for t in texts])
    h, n = tokens.hash, len(tokens.hash)
    last = np.zeros(n, bool)
    last[tokens.first[1:][tokens.first[1:] > tokens.first[:-1]] - 1] = True
    pair = np.zeros(n, np.uint64)
    if n > 1:
        pair[:-1] = np.where(h[:-1] == h[1:], _SAME, mixed(h[:-1] * np.uint64(3) + h[1:]))
    both = np.empty(2 * n, np.uint64)
    both[0::2], both[1::2] = h, pair
    keep = np.ones(2 * n, bool)
    keep[1::2] = ~last  # the last token of a text starts no pair
    buckets = (both[keep] >> np.uint64(64 - BITS)).astype(np.int32)
    before = np.concatenate(([0], np.cumsum(keep)))
    return buckets, before[2 * tokens.first]


def train(rows: list[tuple[bytes, int]], alpha: float = 0.5, l1: float = 1e-4, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (bucket bytes, label) rows in the given order."""
    size = (1 << BITS) + 1  # the last is the bias
    z, n = np.zeros(size), np.zeros(size)
    total = len(rows)
    positive = sum(y for _, y in rows)
    balance = (total / (2 * max(1, total - positive)), total / (2 * max(1, positive)))

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((1.0 + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    examples = []
    for raw, y in rows:
        buckets, counts = np.unique(np.frombuffer(raw, np.int32), return_counts=True)
        share = 10 * counts / max(1, counts.sum())
        examples.append((np.append(buckets, np.int32(size - 1)), np.append(share, 1.0).astype(np.float32), y))
    for _ in range(EPOCHS):
        for i, x, y in examples:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * balance[y] * x
            old = n[i]
            new = old + g * g
            z[i] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[i] = new
    w = weights(np.arange(size))
    return w[:-1].astype(np.float32), float(w[-1])


def dot_scores(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    buckets, first = ngrams(texts)
    sums = np.concatenate(([0.0], np.cumsum(weights[buckets], dtype=np.float64)))
    count = np.maximum(1, first[1:] - first[:-1])
    raw = bias + 10 * (sums[first[1:]] - sums[first[:-1]]) / count
    return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def batches(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 22):
    """Runs of rows of a record batch with about ``most`` bytes of text."""
    texts = [b"" if t is None else t for t in batch.column(column).to_pylist()]
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= most):
            size += len(texts[stop])
            stop += 1
        yield slice(at, stop), texts[at:stop]
        at = stop


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, per_class: int = SAMPLE_PER_CLASS) -> tuple[np.ndarray, float]:
    """Model from labels.quality; ``train_rows`` says which labels may be used."""
    sample = labelled_sample(docs, labels, "quality", train_rows, per_class)

    def hashed(parts):
        for batch in parts:
            for rows, texts in batches(batch):
                buckets, first = ngrams(texts)
                grams = [buckets[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                here = batch.slice(rows.start, len(texts))
                yield pa.RecordBatch.from_arrays([here.column("order"), here.column("label"), pa.array(grams, pa.binary())], ["order", "label", "grams"])

    slim = sample.select("order", "label", F.col("text").cast("binary").alias("text"))
    got = slim.mapInArrow(hashed, "order long, label int, grams binary").collect()
    return train([(r.grams, r.label) for r in sorted(got, key=lambda r: (r.order, r.label, bytes(r.grams)))])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(parts):
        weights, bias = held.value
        for batch in parts:
            for rows, texts in batches(batch):
                here = batch.slice(rows.start, len(texts))
                yield pa.RecordBatch.from_arrays([here.column("doc_id"), pa.array(dot_scores(texts, weights, bias))], ["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(scored, "doc_id long, score double")

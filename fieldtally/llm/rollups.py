"""Token counts kept up to date by signed deltas.

A batch of changes inserts, deletes or revises documents. Each change is turned into
signed counts for every tokenizer (a revision takes the old text's count away and adds
the new one's), summed by source, language and tokenizer version, and written as
that batch's delta. A feed brings texts, or counts that were kept by document: then
deletes need ids only, and no text is shuffled to find them. Totals are the sum of the deltas of all committed batches.

A commit is one small row, written after the delta is complete. Totals take the first
committed attempt of each batch and nothing else, so a batch that is sent again, or
whose job failed half way, counts once. Attempts have folders of their own and
never overwrite each other.

Edge cases: a null text has no tokens. Null sources and languages are values of their
own. Changes of an unknown kind count nothing. An empty batch can be committed. Rows that repeat
count as often as they occur: the feed says what happened. Columns other than those
named are not read.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import batches

TOKENIZER_DIR = "/opt/tokenizers"  # every machine has it; a parameter of commit()
TOKENIZERS = ("words:1", "byte_bpe_50k:1")
KEYS = ("source", "lang", "tokenizer")
COMMITS = "batch_id string, attempt string, committed_ns long"
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
_loaded: dict[tuple[str, str], object] = {}


def encoder(name: str, folder: str):
    """A function from UTF-8 bytes to a number of tokens."""
    kind = name.split(":")[0]
    if kind == "words":
        return lambda text: len(text.split())
    if (folder, kind) not in _loaded:
        import tiktoken

        spec = importlib.util.spec_from_file_location("tokenizer_files", os.path.join(folder, "__init__.py"))
        files = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(files)
        with open(os.path.join(folder, f"{kind}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[folder, kind] = tiktoken.Encoding(kind, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = _loaded[folder, kind].encode_ordinary
    return lambda text: len(encode(text.decode("utf-8", "replace")))


def signed(changes: DataFrame) -> DataFrame:
    """source, lang, sign, text of each side of each change.

    ``changes`` has op (insert, delete, revise), source, lang, text and, for
    revisions, old_text."""
    minus = F.struct(F.lit(-1).alias("sign"), F.when(F.col("op") == "revise", F.col("old_text")).otherwise(F.col("text")).alias("text"))
    plus = F.struct(F.lit(1).alias("sign"), F.col("text").alias("text"))
    sides = (
        F.when(F.col("op") == "insert", F.array(plus))
        .when(F.col("op") == "delete", F.array(minus))
        .when(F.col("op") == "revise", F.array(minus, plus))
    )
    return changes.select("source", "lang", F.explode(sides).alias("side")).select("source", "lang", "side.sign", "side.text")


def counted(rows: DataFrame, keep: list[str], tokenizers=TOKENIZERS, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``keep`` columns and one count of the text for each tokenizer, t0, t1, ..."""
    slim = rows.select(*keep, F.col("text").cast("binary").alias("text"))
    names = list(tokenizers)
    schema = slim.drop("text").schema
    for k in range(len(names)):
        schema = schema.add(f"t{k}", "long")

    def count(parts):
        encoders = [encoder(n, folder) for n in names]
        for batch in parts:
            for rows_, texts in batches(batch):
                here = batch.slice(rows_.start, len(texts))
                made = [pa.array([e(t) for t in texts], pa.int64()) for e in encoders]
                yield pa.RecordBatch.from_arrays([here.column(c) for c in keep] + made, schema.fieldNames())

    return slim.mapInArrow(count, schema)


def delta(rows: DataFrame, tokenizers=TOKENIZERS) -> DataFrame:
    """What counted changes (source, lang, sign, t0, t1, ...) add to the totals, by
    source, lang and tokenizer."""
    sums = rows.groupBy("source", "lang").agg(
        F.sum(F.col("sign").cast("long")).alias("n_docs"), *[F.sum(F.col("sign") * F.col(f"t{k}")).alias(f"t{k}") for k in range(len(tokenizers))]
    )
    each = F.array(*[F.struct(F.lit(n).alias("tokenizer"), F.col(f"t{k}").alias("n_tokens")) for k, n in enumerate(tokenizers)])
    return sums.select("source", "lang", "n_docs", F.explode(each).alias("t")).select("source", "lang", "t.tokenizer", "n_docs", "t.n_tokens")


def create(spark: SparkSession, store: str) -> None:
    """An empty store, if there is none."""
    spark.createDataFrame([], COMMITS).write.mode("append").parquet(f"{store}/commits")


def commits(spark: SparkSession, store: str) -> DataFrame:
    """batch_id, attempt of the attempts that count."""
    return spark.read.schema(COMMITS).parquet(f"{store}/commits").groupBy("batch_id").agg(F.min_by("attempt", F.struct("committed_ns", "attempt")).alias("attempt"))


def commit(store: str, batch_id: str, changes: DataFrame, tokenizers=TOKENIZERS, folder: str = TOKENIZER_DIR) -> bool:
    """Add a batch of changes with texts; False if it had been committed before
    (then nothing is counted)."""
    return commit_counts(store, batch_id, counted(signed(changes), ["source", "lang", "sign"], tokenizers, folder), tokenizers)


def commit_counts(store: str, batch_id: str, rows: DataFrame, tokenizers=TOKENIZERS) -> bool:
    """The same for changes that are counted already: source, lang, sign, t0, t1, ..."""
    spark = rows.sparkSession
    if commits(spark, store).where(F.col("batch_id") == batch_id).limit(1).count():
        return False
    attempt = uuid.uuid4().hex
    delta(rows, tokenizers).write.parquet(f"{store}/deltas/attempt={attempt}")
    row = spark.createDataFrame([(batch_id, attempt, time.time_ns())], COMMITS)
    row.coalesce(1).write.mode("append").parquet(f"{store}/commits")
    return True


def totals(spark: SparkSession, store: str) -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
    counted_attempts = [r["attempt"] for r in commits(spark, store).select("attempt").toLocalIterator()]
    if not counted_attempts:
        return spark.createDataFrame([], DELTAS)
    rows = spark.read.schema(DELTAS).parquet(*[f"{store}/deltas/attempt={a}" for a in counted_attempts])
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

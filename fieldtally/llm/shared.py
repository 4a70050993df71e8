"""What the operators of this subpackage have in common."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """Folder that the cluster names in ``spark.checkpoint.dir``.

    Tests and single sessions without the setting fall back to a folder below
    the warehouse, which executors share with the driver as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/llm-shared").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and the
    result outlives executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def bounded_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, rows: int = 100_000) -> DataFrame:
    """Left join with a lookup table that is stored already.

    Up to ``rows`` lookup rows are broadcast. A larger table is repeated for
    16 salts and joined on keys and salt, so that a key with many rows on the
    big side spreads over tasks. Null keys match null keys.
    """
    marked = small.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = same if on is None else on & same
    if small.limit(rows + 1).count() <= rows:
        joined = big.join(F.broadcast(marked), on, "left")
    else:
        marked = marked.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(15))))
        salted = big.withColumn("_salt_l", F.pmod(F.xxhash64(spread), F.lit(16)).cast("int"))
        joined = salted.join(marked, on & (F.col("_salt_l") == F.col("_salt_r")), "left").drop("_salt_l", "_salt_r")
    return joined.drop(*[f"_k_{k}" for k in keys])


# --- token hashes of many texts at once -------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_CHUNK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        steps = np.full(max(n, _CHUNK + 4096), base, np.uint64)
        steps[0] = 1
        have = _powers[which] = np.multiply.accumulate(steps)
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


# Kind of a byte: 0 between tokens, 1 in a word, 2 in a run of other signs.
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
for _lo, _hi in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _KIND[_lo : _hi + 1] = 1


class Tokens:
    """Words and sign runs of a list of texts (UTF-8 bytes, lower case).

    ``hash`` has a 64-bit hash for each token, ``head`` those of the first
    4 and 5 bytes of words that are longer (else 0), ``is_word`` tells words from
    signs, and ``first`` where the tokens of each text begin (with the end).
    """

    def __init__(self, texts: list[bytes], heads: tuple[int, ...] = ()):
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        parts: list[tuple[np.ndarray, ...]] = []
        at = 0
        while at < len(buf):
            stop = min(at + _CHUNK, len(buf))
            if stop < len(buf):  # cut between tokens; one endless token is taken whole
                gaps = np.flatnonzero(_KIND[buf[at:stop]] == 0)
                while not len(gaps):
                    stop = min(stop + _CHUNK, len(buf))
                    gaps = np.flatnonzero(_KIND[buf[at:stop]] == 0)
                stop = at + int(gaps[-1]) + 1
            parts.append(self._hashed(buf[at:stop], at, heads))
            at = stop
        cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.uint64)] * 3
        self.hash, starts, self.is_word = cols[0], cols[1], cols[2].astype(bool)
        self.head = cols[3:]
        self.first = np.concatenate(([0], np.searchsorted(starts, ends, "left"))).astype(np.int64)

    @staticmethod
    def _hashed(buf: np.ndarray, offset: int, heads: tuple[int, ...]) -> tuple[np.ndarray, ...]:
        kind = _KIND[buf]
        edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
        edge = np.append(edge, len(buf))
        begin, end = edge[:-1], edge[1:]
        real = kind[begin] > 0 if len(begin) else np.zeros(0, bool)
        begin, end = begin[real], end[real]
        power, inverse = _power("up", _BASE, len(buf)), _power("down", _INVERSE, len(buf))
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
        back = inverse[begin]
        out = [mixed((total[end] - total[begin]) * back), begin + offset, kind[begin] == 1]
        for n in heads:
            long = (end - begin > n) & out[2]
            to = np.minimum(begin + n, end)
            out.append(np.where(long, mixed((total[to] - total[begin]) * back + np.uint64(n)), np.uint64(0)))
        return tuple(out)

"""Outlier flags: names, order, labels and three-valued combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Flags from most to least severe, and the labels of the ordered
# error scale with their ranks.
FLAG_ORDER = ["key_entry_error", "over_max", "mad15", "mad10", "seasonal5", "seasonal3"]
SOURCE_FLAGS = ["over_max", "mad15", "mad10", "seasonal5", "seasonal3"]
MISSING_FLAGS = ["missing_numerator", "missing_denominator"]
ERROR_LEVELS = [
    "All",
    "key_entry_error",
    "over_max",
    "mad15",
    "mad10",
    "seasonal5",
    "seasonal3",
    "none",
]


def present(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def is_set(flag: str) -> Column:
    """True only where the flag is true; NULL counts as not flagged."""
    return F.coalesce(F.col(flag), F.lit(False))


def any_set(flags: list[str]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | is_set(f)
    return out


def first_flag(flags: list[str], default: str | None = None) -> Column:
    """Name of the most severe flag that is set."""
    picks = [F.when(is_set(f), F.lit(f)) for f in flags]
    if default is not None:
        picks.append(F.lit(default))
    return F.coalesce(*picks)


def flags_through(level: str) -> list[str]:
    """Flags at least as severe as ``level``; none for ``none``."""
    if level == "none":
        return []
    return FLAG_ORDER[: FLAG_ORDER.index(level) + 1]


def error_rank(label: Column) -> Column:
    """Position of an error label on the ordered scale, from 1."""
    return F.array_position(F.array(*[F.lit(x) for x in ERROR_LEVELS]), label).cast("int")


def with_error_label(df: DataFrame) -> DataFrame:
    """Add ``error`` and ``error_rank``.

    The mildest flag that is set names the error. Rows where every flag is
    known to be false, and rows where nothing is known, are ``none``.
    """
    have = set(df.columns)
    col = {f: (F.col(f) if f in have else F.lit(False)) for f in FLAG_ORDER}
    clean = F.lit(True)
    for f in FLAG_ORDER:
        clean = clean & ~col[f]
    label = F.when(clean, F.lit("none"))
    for f in reversed(FLAG_ORDER):
        label = label.when(col[f], F.lit(f))
    label = label.otherwise(F.lit("none"))
    out = df.withColumn("error", label)
    return out.withColumn("error_rank", error_rank(F.col("error")))

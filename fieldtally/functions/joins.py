"""Joins of large tables with dictionaries on keys that have few values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def by_facility(df: DataFrame, key: str = "orgUnit") -> DataFrame:
    """Rows dealt to tasks by facility, in as many pieces as the session has shuffle partitions.

    What follows by facility, series, or facility and period needs no further shuffle. The
    number is given, since adaptive execution merges pieces by their packed bytes: facts pack
    so well that a merged piece has millions of rows, and each sort of its task holds them all.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def lookup(table: DataFrame, key: str | Column, value: str | Column) -> Column:
    """A short table with one row per key as a map that every row can look into.

    For keys of which there are few by nature (years, settings, elements): joining a
    large table on them would send each key's rows to one task.
    """
    key = F.col(key) if isinstance(key, str) else key
    return table.filter(key.isNotNull()).agg(F.map_from_entries(F.collect_list(F.struct(key, value)))).scalar()


def with_dictionary(data: DataFrame, dictionary: DataFrame, keys: list[str], spread: str | None = None, null_safe: bool = False) -> DataFrame:
    """Left join with a dictionary of elements, categories or areas.

    Each entry is repeated for every salt and rows are salted by ``spread`` (all columns, if none is named), so
    an element that most rows have, or rows without any, are no single task. The
    dictionary may be of any size; one that is small is broadcast by Spark.
    """
    salted = data.withColumn("_salt", F.pmod(F.xxhash64(*([spread] if spread else data.columns)), F.lit(SALTS)).cast("int"))
    entries = dictionary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    if not null_safe:
        return salted.join(entries, [*keys, "_salt"], "left").drop("_salt")
    entries = entries.withColumnsRenamed({k: f"_k_{k}" for k in [*keys, "_salt"]})
    on = F.col("_salt") == F.col("_k__salt")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return salted.join(entries, on, "left").drop("_salt", "_k__salt", *[f"_k_{k}" for k in keys])

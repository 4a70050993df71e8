"""Combine extracts and refresh a stored table with newer periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods, text
from .staging import settle


def default_category(df: DataFrame, column: str = "categoryOptionCombo") -> DataFrame:
    """Give rows without a category the name ``default`` before joining."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("default")))


def pair_extracts(sums: DataFrame, counts: DataFrame) -> DataFrame:
    """Full outer join of a value and a count extract on their shared keys."""
    keys = [
        c
        for c in ("dataElement", "period", "orgUnit", "categoryOptionCombo")
        if c in sums.columns and c in counts.columns
    ]
    return counts.withColumnRenamed("value", "COUNT").join(
        sums.withColumnRenamed("value", "SUM"), keys, "full_outer"
    )


def compare_totals(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored against current counts and totals per element, period, category.

    ``current`` has ``current_count`` and ``current_value`` per key.
    """
    keys = ["dataElement", "period", "categoryOptionCombo"]
    prev = stored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("prev_count"), F.sum(F.col("SUM").try_cast("double")).alias("prev_value")
    )
    return current.join(prev, keys, "left").withColumn(
        "same",
        F.coalesce(
            (F.col("current_count") == F.col("prev_count")) & (F.col("current_value") == F.col("prev_value")),
            F.lit(False),
        ),
    )


def stale_periods(stored: DataFrame, current: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted periods that must be fetched again: those not identical in every
    element and category."""
    unchanged = (
        compare_totals(stored, current).groupBy("period").agg(F.bool_and("same").alias("ok")).filter("ok")
    )
    return wanted.join(unchanged, "period", "left_anti").select("period").distinct()


RAW = ["dataElement", "categoryOptionCombo", "orgUnit", "period", "COUNT", "SUM"]


def raw_rows(extract: DataFrame) -> DataFrame:
    """The columns of a raw table as text, without rows that have no count."""
    n = F.col("COUNT").try_cast("double")
    return extract.select(*[F.col(c).cast("string").alias(c) for c in RAW]).filter(n.isNotNull() & (n != 0))


def merge_refresh(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace the refreshed periods and keep the rest; rows without a count
    are dropped. Rows are in no order; a writer sorts within its partitions."""
    kept = stored.join(fresh.select("period").distinct(), "period", "left_anti")
    return raw_rows(kept).unionByName(raw_rows(fresh))


# -- a stored extract that is refreshed period by period ---------------------------
#
# path/rows/generation=G/period=P   rows that generation G wrote, never changed later
# path/index/generation=G           one file: each period's writer, number of rows, digest
#
# The newest index names the rows that count. It is one file, so it appears whole or
# not at all; rows of a refresh that stopped before its index are never read, and the
# same refresh run again overwrites them.


def period_digests(rows: DataFrame) -> DataFrame:
    """Number of rows and digest of each period; order and partitions play no part,
    repeated rows do."""
    digest = F.sum(F.xxhash64(*RAW).cast("decimal(38,0)")).alias("digest")
    return rows.groupBy("period").agg(F.count(F.lit(1)).alias("n"), digest)


_INDEX = "period string, writer long, n long, digest decimal(38,0)"


def _generations(spark: SparkSession, path: str) -> DataFrame | None:
    """All indexes with their generation; None where nothing is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/index")
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return None
    return spark.read.schema(f"{_INDEX}, generation long").parquet(f"{path}/index")


def stored_index(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """The index of a generation, the newest by default: what each period holds."""
    every = _generations(spark, path)
    if every is None:
        return spark.createDataFrame([], _INDEX)
    wanted = every.agg(F.max("generation")).scalar() if generation is None else F.lit(generation)
    return every.filter(F.col("generation") == wanted).drop("generation")


def read_stored(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """The rows of a stored extract as of a generation. Partitions of other writers
    are pruned by the index at run time."""
    index = stored_index(spark, path, generation).select("period", F.col("writer").alias("generation"))
    schema = ", ".join(f"{c} string" for c in RAW) + ", generation long"
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    return rows.join(index, ["generation", "period"], "left_semi").select(*RAW)


def refresh_stored(path: str, fresh: DataFrame) -> int:
    """Take the periods of an extract into a stored one; returns the generation.

    A period whose digest is the stored one is not written again, so its files stay
    untouched; a period that the extract no longer has rows with counts for is
    emptied; periods that the extract does not mention stay. One refresh at a time.
    """
    spark = fresh.sparkSession
    every = _generations(spark, path)
    newest = None if every is None else every.agg(F.max("generation")).first()[0]
    generation = 0 if newest is None else newest + 1
    rows = raw_rows(fresh)
    named = fresh.select(F.col("period").cast("string").alias("period")).distinct()
    found = named.join(period_digests(rows), "period", "left").select("period", F.coalesce("n", F.lit(0)).alias("n"), "digest")
    before = stored_index(spark, path)
    same = ["period", "n", "digest"]
    changed = settle(found.join(before.select(*same), same, "left_anti"))
    (
        rows.join(changed.filter("n > 0"), "period", "left_semi")
        .hint("rebalance", "period")
        .sortWithinPartitions("period", "dataElement", "orgUnit")
        .write.mode("overwrite")
        .partitionBy("period")
        .parquet(f"{path}/rows/generation={generation}")
    )
    kept = before.join(changed.select("period"), "period", "left_anti")
    written = changed.filter("n > 0").select("period", F.lit(generation).cast("long").alias("writer"), "n", "digest")
    index = kept.select("period", "writer", "n", "digest").unionByName(written)
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/index/generation={generation}")
    return generation


def raw_from_processed(facts: DataFrame) -> DataFrame:
    """Raw rows from processed ones, splitting ``data_id`` at its first ``_``."""
    period = periods.period_column(facts)
    code = periods.month_code(F.col(period)) if period == "Month" else periods.week_code(F.col(period))
    return facts.select(
        text.element_uid(F.col("data_id")).alias("dataElement"),
        text.category_uid(F.col("data_id")).alias("categoryOptionCombo"),
        "orgUnit",
        code.alias("period"),
        F.lit(1).alias("COUNT"),
        F.col("original").alias("SUM"),
    )

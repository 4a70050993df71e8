"""Read and write fact, rainfall and facility tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import periods
from ..functions.flags import FLAG_ORDER, present

# Fixed value: a numeric month index at or below this median counts months
# since 1970, above it days.
LEGACY_MONTH_LIMIT = 5000


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Load a processed table; a numeric month index becomes a date."""
    return restore_index(spark.read.parquet(path))


def restore_index(df: DataFrame) -> DataFrame:
    """Check the key columns and repair a numeric time index."""
    period = periods.period_column(df)
    missing = [c for c in ("orgUnit", "data_id", period) if c not in df.columns]
    if missing:
        raise ValueError(f"not a processed table, missing {missing}")
    if isinstance(df.schema[period].dataType, T.NumericType):
        df = df.withColumn(period, _index_date(df, period))
    return df


def _index_date(df: DataFrame, period: str):
    """Decode one numeric encoding, chosen for the table by its median.

    The number of distinct periods is small, so they are counted first; the
    median then runs over the calendar weighted by those counts.
    """
    n = F.col(period).cast("int")
    counts = df.filter(F.col(period).isNotNull()).groupBy(n.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    median = counts.agg(F.expr("percentile(v, 0.5, c)")).scalar()
    days = F.date_add(F.lit("1970-01-01").cast("date"), n)
    if period != "Month":
        return days
    return F.when(median <= LEGACY_MONTH_LIMIT, periods.months_since_epoch_to_date(n)).otherwise(days)


def write_facts(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Save a processed table partitioned by year, sorted by series inside files.

    Spark rebalances the rows of a year to tasks of about its advisory size, so
    the number of writers follows the data; series of a data element lie together
    for pruning.
    """
    period = periods.period_column(df)
    (
        df.withColumn("year", F.year(period))
        .hint("rebalance", "year")
        .sortWithinPartitions("year", "data", "orgUnit", period)
        .write.mode(mode)
        .partitionBy("year")
        .parquet(path)
    )


def profile(df: DataFrame) -> DataFrame:
    """Distinct series with row counts, flags present and the period type."""
    flags = ",".join(present(df, FLAG_ORDER))
    return (
        df.filter(F.col("data").isNotNull())
        .groupBy("data")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(
            "data",
            "n_rows",
            F.lit(flags).alias("cleaning_levels"),
            F.lit(periods.period_column(df)).alias("period_type"),
        )
    )


def union_rainfall(tables: list[DataFrame]) -> DataFrame:
    """Stack rainfall tables; the first listed wins per id, year and month."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("_file", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    keys = ["id", "year", "month"]
    rest = [c for c in out.columns if c not in (*keys, "_file")]
    best = F.min(F.struct("_file", *rest)).alias("b")
    return out.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def read_rainfall(spark: SparkSession, paths: list[str]) -> DataFrame:
    return union_rainfall([spark.read.parquet(p) for p in paths])


def write_rainfall(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Save flat rainfall by year and level."""
    df.write.mode(mode).partitionBy("year", "level").parquet(path)


def facility_master(units: DataFrame, levels: DataFrame) -> DataFrame:
    """Name, parent and position of facilities, sorted by name.

    The facility level is the first whose name contains "facilit", else the
    deepest.
    """
    named = levels.agg(
        F.min(F.when(F.lower("levelName").contains("facilit"), F.col("level"))).alias("a"),
        F.max("level").alias("b"),
    ).select(F.coalesce("a", "b"))
    return (
        units.filter(F.col("level") == named.scalar())
        .select(
            F.col("name").alias("facility_name"),
            F.col("parentName").alias("parent_name"),
            "latitude",
            "longitude",
        )
        .orderBy("facility_name")
    )


def write_facility_master(master: DataFrame, path: str) -> None:
    master.write.mode("overwrite").option("header", True).csv(path)


def ingest_wide(
    data: DataFrame,
    summary: DataFrame,
    series: list[str],
    leaf: bool = True,
    level: int | None = None,
    total_name: str = "Total",
) -> DataFrame:
    """Long formula data to one column per series, with summary columns.

    ``series`` lists the expected ``element_category`` names, so the pivot
    needs no pass over the data to find them.
    """
    keys = [c for c in data.columns if c not in ("dataElement", "Category", "SUM", "COUNT")]
    wide = (
        data.withColumn("period", periods.month_from_code(F.col("period")))
        .withColumn("_de", F.concat_ws("_", "dataElement", "Category"))
        .groupBy(*keys)
        .pivot("_de", series)
        .agg(F.sum(F.col("SUM").try_cast("double")))
    )
    s = summary.select(
        "orgUnit",
        periods.month_from_code(F.col("period")).alias("period"),
        F.col("Total").alias(total_name),
        "Count_Any",
        "Count_Complete",
    )
    out = wide.join(s, ["orgUnit", "period"], "left")
    if leaf:
        return out.filter("effectiveLeaf" if "effectiveLeaf" in out.columns else "leaf")
    return out if level is None else out.filter(F.col("level") == level)

"""Outlier flags, cleaning and outlier summaries.

A series is one facility and one data id. After conforming it has one row per
period, so a window over a series holds at most the length of the calendar;
nothing here puts a whole data element in one window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.flags import (
    ERROR_LEVELS,
    FLAG_ORDER,
    any_set,
    first_flag,
    flags_through,
    is_set,
    present,
    with_error_label,
)
from ..functions.joins import by_facility, lookup
from ..functions.periods import period_column

SERIES = ["orgUnit", "data_id"]

# Stock-out series are recognised by name and cannot exceed the
# days of a month; the bounds of the scale estimate.
STOCK_WORD = "(?i)stock"
STOCK_OUT_WORD = "(?i)out|rupture"
MAX_DAYS = 31.0
TRIMMED_SD_SCALE = 0.6745
NEGLIGIBLE_MAD = 0.01


def key_entry_values(df: DataFrame, by: str = "dataElement") -> DataFrame:
    """Values of more than three characters that repeat suspiciously often.

    Per element: frequency above three times the median frequency of the ten
    most common such values. Values are counted before they are printed, and ranks are
    cut to ten on the map side before the rows of an element meet.
    """
    value = F.col("original")
    printed = F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))
    counts = (
        df.filter("effectiveLeaf")
        .groupBy(by, "original")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.when(F.col("n") > 0, F.length(printed)) > 3)  # names the count, so it stays above
    )
    w = W.partitionBy(by).orderBy(F.desc("n"), F.asc("original"))
    top = counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 10)
    # A value above three times the median of the ten is one of them, so the counts are read once.
    limited = top.withColumn("_m", F.median("n").over(W.partitionBy(by)))
    return limited.filter(F.col("n") > 3 * F.col("_m")).select(by, "original")


def add_scale(df: DataFrame, value: str, keys: list[str], prefix: str = "_s") -> DataFrame:
    """Median and robust scale of a value within each series, as columns
    ``<prefix>_centre`` and ``<prefix>_scale``.

    The scale is the normal-consistent MAD; where that is below 1% of the
    median, 0.6745 times the SD of the values strictly between the 1% and 99%
    quantiles. All passes share one partitioning, so there is one shuffle.
    """
    w = W.partitionBy(*keys)
    x, c = F.col(value), F.col(f"{prefix}_centre")
    out = (by_facility(df) if "orgUnit" in keys else df).withColumns(
        {
            f"{prefix}_q": F.percentile(x, F.array(F.lit(0.5), F.lit(0.01), F.lit(0.99))).over(w),
        }
    ).withColumn(f"{prefix}_centre", F.col(f"{prefix}_q")[0])
    inner = F.when((x > F.col(f"{prefix}_q")[1]) & (x < F.col(f"{prefix}_q")[2]), x)
    out = out.withColumns(
        {
            f"{prefix}_mad": F.lit(stats.MAD_SCALE) * F.median(F.abs(x - c)).over(w),
            f"{prefix}_sd": F.stddev_samp(inner).over(w),
        }
    )
    mad = F.col(f"{prefix}_mad")
    scale = F.when(mad < NEGLIGIBLE_MAD * c, F.lit(TRIMMED_SD_SCALE) * F.col(f"{prefix}_sd")).otherwise(mad)
    return out.withColumn(f"{prefix}_scale", scale).drop(
        f"{prefix}_q", f"{prefix}_mad", f"{prefix}_sd"
    )


def beyond(x: Column, centre: Column, scale: Column, deviation: float) -> Column:
    return (x > centre + deviation * scale) | (x < centre - deviation * scale)


def extreme_values(
    df: DataFrame,
    value: str,
    keys: list[str],
    deviation: float = 15.0,
    small_threshold: float | None = 50.0,
    name: str = "extreme",
) -> DataFrame:
    """Flag values further than ``deviation`` scales from the series median.

    NULL for a whole series whose values are all at or below the threshold.
    """
    out = add_scale(df, value, keys)
    hit = beyond(F.col(value), F.col("_s_centre"), F.col("_s_scale"), deviation)
    if small_threshold is not None:
        largest = F.max(value).over(W.partitionBy(*keys))
        hit = F.when(largest > small_threshold, hit)
    return out.withColumn(name, hit).drop("_s_centre", "_s_scale")


def mad_flags(
    df: DataFrame,
    threshold: float = 50.0,
    key_entry: DataFrame | None = None,
    period: str | None = None,
    keys: list[str] | None = None,
    element: str = "dataElement",
) -> DataFrame:
    """Add key_entry_error, over_max, mad15, mad10 and mad5.

    The three MAD flags share one masked value: known errors, values over
    the maximum and series of small values are left out. Also adds
    ``AllSmall`` and the masked value ``scan_value``.
    """
    keys = keys or SERIES
    repeated = key_entry if key_entry is not None else key_entry_values(df, element)
    # More than three times the median of the ten highest counts: at most five
    # values per element, so this is a short list on a dictionary-sized table.
    lists = lookup(repeated.groupBy(element).agg(F.collect_set("original").alias("_bad")), element, "_bad")
    dealt = by_facility(df) if "orgUnit" in keys else df
    out = dealt.withColumn("_bad", F.try_element_at(lists, F.col(element)))
    known = F.col("original").isNotNull()
    capped = F.col("data").rlike(STOCK_WORD) & F.col("data").rlike(STOCK_OUT_WORD) & F.col("effectiveLeaf")
    out = out.withColumns(
        {
            "key_entry_error": F.when(
                F.col("_bad").isNotNull() & known, F.array_contains("_bad", F.col("original"))
            ),
            "over_max": F.when(capped & known, F.col("original") > MAX_DAYS),
            "AllSmall": F.coalesce(F.max("original").over(W.partitionBy(*keys)) <= threshold, F.lit(True)),
        }
    ).drop("_bad")
    usable = ~is_set("over_max") & ~is_set("key_entry_error") & ~F.col("AllSmall")
    out = add_scale(out.withColumn("scan_value", F.when(usable, F.col("original"))), "scan_value", keys)
    big = F.max("scan_value").over(W.partitionBy(*keys)) > threshold
    out = out.withColumn("_big", big)
    x, c, s = F.col("scan_value"), F.col("_s_centre"), F.col("_s_scale")
    return out.withColumns(
        {f"mad{k}": F.when(F.col("_big"), beyond(x, c, s, k)) for k in (15, 10, 5)}
    ).drop("_s_centre", "_s_scale", "_big").select(
        *df.columns, "key_entry_error", "over_max", "AllSmall", "scan_value", "mad15", "mad10", "mad5"
    )


def add_expected(df: DataFrame, value: str, keys: list[str], period: str, name: str = "expected") -> DataFrame:
    """Seasonal expectation of a series.

    The level is the median of the rows from six before to six after; the
    season is the median over years of value divided by level for the same
    month of year; the expectation is level times season. NULL where the
    value is NULL. Documented stand-in for loess-based cleaning, so flags
    built on it differ from that method's.
    """
    w = W.partitionBy(*keys)
    near = w.orderBy(period).rowsBetween(-6, 6)
    season_key = F.month(period) if period == "Month" else F.weekofyear(period)
    around = F.sort_array(F.collect_list(value).over(near))
    n = F.size("_near")
    middle = (
        F.get("_near", F.floor((n - 1) / 2).cast("int")) + F.get("_near", F.floor(n / 2).cast("int"))
    ) / 2
    return (
        df.withColumn("_near", around)
        .withColumn("_level", middle)
        .withColumn("_season", season_key)
        .withColumn("_ratio", F.try_divide(F.col(value), F.col("_level")))
        .withColumn("_index", F.median("_ratio").over(W.partitionBy(*keys, "_season")))
        .withColumn(
            name, F.when(F.col(value).isNotNull(), F.col("_level") * F.coalesce("_index", F.lit(1.0)))
        )
        .drop("_near", "_level", "_season", "_ratio", "_index")
    )


def off_season(x: Column, expected: Column, mad: Column, deviation: float) -> Column:
    """Is the distance to the expectation at least ``deviation`` MADs?

    With a zero MAD any distance counts and no distance is undecided.
    """
    gap = F.abs(expected - x)
    return F.when(mad > 0, gap / mad >= deviation).when(gap > 0, F.lit(True))


def _seasonal(df: DataFrame, value: str, keys: list[str], period: str, levels: dict[str, float], threshold: float):
    w = W.partitionBy(*keys)
    out = add_expected(df, value, keys, period, "_exp")
    out = out.withColumn("_c", F.median(value).over(w)).withColumn("_top", F.max(value).over(w))
    out = out.withColumn("_m", F.lit(stats.MAD_SCALE) * F.median(F.abs(F.col(value) - F.col("_c"))).over(w))
    big = F.col("_top") > threshold
    x = F.col(value)
    return out.withColumns(
        {n: F.when(big, off_season(x, F.col("_exp"), F.col("_m"), k)) for n, k in levels.items()}
    ), big


def seasonal_flags(
    df: DataFrame,
    threshold: float = 50.0,
    mad: str = "mad10",
    period: str | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Add seasonal5, seasonal3 and ``expected`` over values not flagged by
    ``mad``. A NULL flag leaves the value out, so small series get NULLs."""
    keys, period = keys or SERIES, period or period_column(df)
    masked = df.withColumn("not_mad", F.when(~F.col(mad), F.col("original")))
    out, big = _seasonal(masked, "not_mad", keys, period, {"seasonal5": 5.0, "seasonal3": 3.0}, threshold)
    expected = F.when(big, F.col("_exp")).otherwise(F.col("not_mad"))
    return out.withColumn("expected", expected).drop("_exp", "_c", "_m", "_top", "not_mad")


def rescan(df: DataFrame, keys: list[str], period: str) -> DataFrame:
    """Staged scan where each stage leaves out what earlier stages flagged:
    over_max, mad15, mad10, seasonal5, seasonal3. Earlier flags are kept
    (OR), and there is no threshold for small series."""
    out = df.withColumns({f: is_set(f) for f in ("over_max", "mad15", "mad10", "seasonal5", "seasonal3")})
    gone = F.col("over_max")
    for name, k in (("mad15", 15.0), ("mad10", 10.0)):
        out = out.withColumn("_x", F.when(~gone, F.col("original")))
        out = extreme_values(out, "_x", keys, k, 0.0, "_new")
        out = out.withColumn(name, F.col(name) | is_set("_new")).drop("_x", "_new")
        gone = gone | F.col(name)
    for name, k in (("seasonal5", 5.0), ("seasonal3", 3.0)):
        out = out.withColumn("_x", F.when(~gone, F.col("original")))
        out, _ = _seasonal(out, "_x", keys, period, {"_new": k}, 0.0)
        out = out.withColumn(name, F.col(name) | is_set("_new")).drop("_x", "_new", "_exp", "_c", "_m", "_top")
        gone = gone | F.col(name)
    return out


# -- cleaning ---------------------------------------------------------------------


def clean_to_level(df: DataFrame, level: str, name: str = "cleaned") -> DataFrame:
    """Replace values flagged at ``level`` or worse by the expected value, or
    by NULL where there is none."""
    flags = present(df, flags_through(level))
    if not flags:
        return df.withColumn(name, F.col("original"))
    instead = F.col("expected") if "expected" in df.columns else F.lit(None).cast("double")
    return df.withColumn(name, F.when(any_set(flags), instead).otherwise(F.col("original")))


def cleaned_data(
    df: DataFrame, error: str | None = None, effective_leaf: bool = True, union_of_levels: bool = False
) -> DataFrame:
    """Keep (effective) leaves and add ``dataCol``: the value, or NULL when its
    error is at or above ``error`` on the ordered scale.

    The single error label names the mildest flag, so a value flagged both
    mad15 and seasonal3 survives censoring at mad15; ``union_of_levels``
    censors on any flag at least as severe instead.
    """
    rows = df.filter(F.col("effectiveLeaf") == effective_leaf).filter(
        F.col("data").isNull() | (F.col("data") != "NA_")
    )
    if error is None or error == "Original":
        return rows.withColumn("dataCol", F.col("original"))
    if union_of_levels:
        return censor(rows, error).withColumnRenamed("censored", "dataCol")
    labelled = with_error_label(rows)
    rank = ERROR_LEVELS.index(error) + 1
    return labelled.withColumn("dataCol", F.when(F.col("error_rank") > rank, F.col("original")))


def censor(df: DataFrame, level: str, name: str = "censored") -> DataFrame:
    """NULL for values with any flag at least as severe as ``level``."""
    return df.withColumn(name, F.when(~any_set(present(df, flags_through(level))), F.col("original")))


# -- listings -----------------------------------------------------------------------


def flagged_values(df: DataFrame, champion_units: DataFrame, extra_cols: list[str] | None = None) -> DataFrame:
    """Flagged rows with the series median, ratio to it, first flag, number of
    flags in the series and champion mark; champions first, then by ratio."""
    flags, period = present(df, FLAG_ORDER), period_column(df)
    w = W.partitionBy(*SERIES)
    marks = champion_units.select("orgUnit", F.lit(True).alias("_m"))
    ratio = F.when(F.col("series_median") > 0, F.round(F.col("original") / F.col("series_median"), 1))
    return (
        df.withColumn("any_flag", any_set(flags))
        .withColumn("series_median", F.median("original").over(w))
        .withColumn("flags_in_series", F.count_if("any_flag").over(w))
        .filter("any_flag")
        .join(marks, "orgUnit", "left")
        .select(
            *(extra_cols or []),
            "orgUnit",
            "orgUnitName",
            "data",
            "data_id",
            period,
            "original",
            "series_median",
            ratio.alias("ratio"),
            first_flag(flags).alias("flag_type"),
            F.coalesce("_m", F.lit(False)).alias("champion"),
            "flags_in_series",
        )
        .orderBy(F.desc("champion"), F.desc_nulls_last("ratio"), "orgUnit", "data_id", period)
    )


def series_detail(df: DataFrame, org_unit: str, data_id: str) -> DataFrame:
    """One series with ratio to its median and first flag."""
    flags, period = present(df, FLAG_ORDER), period_column(df)
    rows = df.filter((F.col("orgUnit") == org_unit) & (F.col("data_id") == data_id))
    med = F.median("original").over(W.partitionBy(*SERIES))
    return rows.withColumn("series_median", med).select(
        period,
        "original",
        "series_median",
        F.when(F.col("series_median") > 0, F.round(F.col("original") / F.col("series_median"), 1)).alias("ratio"),
        any_set(flags).alias("any_flag"),
        first_flag(flags, "none").alias("flag_type"),
    )


def removal_effect(df: DataFrame) -> DataFrame:
    """Totals per period after removing ever milder errors: five columns."""
    period = period_column(df)
    cols = [stats.sum0(F.col("original")).alias("original_total")]
    for level in ("mad15", "mad10", "seasonal5", "seasonal3"):
        kept = F.when(~any_set(present(df, flags_through(level))), F.col("original"))
        cols.append(stats.sum0(kept).alias(f"without_{level}"))
    return df.groupBy(period).agg(*cols)


# -- summaries -----------------------------------------------------------------------

SUMMARY_FLAGS = [
    "AllSmall",
    "key_entry_error",
    "over_max",
    "missing_numerator",
    "missing_denominator",
    "mad15",
    "mad10",
    "mad5",
    "seasonal5",
    "seasonal3",
]


def outlier_summary(df: DataFrame, flags: list[str] | None = None) -> DataFrame:
    """n, total, smallest, median and largest value per flag, and for rows
    without any flag, with shares of all values.

    Rows are first grouped by their combination of flags. The median of a
    flag is the median of its combinations' medians, and the median without
    flags the largest of theirs.
    """
    flags = present(df, flags or SUMMARY_FLAGS)
    # One pass over the rows: distinct values per combination of flags, counted.
    counts = df.groupBy(*flags, F.col("original").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    known = F.when(F.col("v").isNotNull(), F.col("c")).otherwise(F.lit(0))
    groups = counts.groupBy(*flags).agg(
        F.sum(known).alias("n"),
        stats.sum0(F.col("v") * F.col("c")).alias("total"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
    )
    medians = stats.exact_quantiles(counts, flags, "v", [0.5], ["med"], count="c")
    cond = reduce(
        lambda a, b: a & b, [F.col(f"g.{f}").eqNullSafe(F.col(f"m.{f}")) for f in flags]
    )
    combos = groups.alias("g").join(medians.alias("m"), cond, "left").select("g.*", "m.med")
    whole = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(1))), F.lit(0))
    if {"numerator", "denominator"} <= set(df.columns):
        n_all = df.agg(F.greatest(F.count("numerator"), F.count("denominator"))).scalar()
    else:
        n_all = whole
    combos = combos.withColumns(
        {"n_all": n_all, "total_all": F.sum("total").over(W.partitionBy(F.lit(1)))}
    )
    error_flags = [f for f in flags if f != "AllSmall"]
    labels = F.array(
        *[F.when(is_set(f), F.lit(f)) for f in flags],
        F.when(~any_set(error_flags), F.lit("No Error Flags")),
    )
    none = F.col("err") == "No Error Flags"
    out = (
        combos.withColumn("err", F.explode(F.array_compact(labels)))
        .groupBy("err")
        .agg(
            F.sum("n").alias("n"),
            F.sum("total").alias("total"),
            F.min("lo").alias("smallest"),
            F.when(F.max(none.cast("int")) == 1, F.max("med")).otherwise(F.median("med")).alias("median"),
            F.max("hi").alias("largest"),
            F.max("n_all").alias("n_all"),
            F.max("total_all").alias("total_all"),
        )
    )
    return out.select(
        "err",
        "n",
        F.try_divide("n", "n_all").alias("share_n"),
        "total",
        F.try_divide("total", "total_all").alias("share_total"),
        "smallest",
        "median",
        "largest",
    )


def monthly_outliers(df: DataFrame, flags: list[str] | None = None) -> DataFrame:
    """Flagged sums and counts per month, series and algorithm, also for any
    flag (Combined) and over all series (All), with shares of the totals."""
    flags = present(df, flags or ["mad15", "mad10", "seasonal5", "seasonal3"])
    base = df.filter("effectiveLeaf").select("Month", "data", "original", *flags)
    # One pass: a row goes to each of its flags, to Combined and to the totals.
    names = F.array_compact(
        F.array(
            *[F.when(is_set(f), F.lit(f)) for f in flags],
            F.when(any_set(flags), F.lit("Combined")),
            F.lit("Total"),
        )
    )
    sums = (
        base.withColumn("Alg", F.explode(names))
        .groupBy("Month", "data", "Alg")
        .agg(stats.sum0(F.col("original")).alias("e"), F.count(F.lit(1)).alias("n_e"))
    )
    errors = sums.filter("Alg <> 'Total'")
    totals = sums.filter("Alg = 'Total'").select("Month", "data", F.col("e").alias("t"), F.col("n_e").alias("n_t"))
    by_series = totals.join(errors, ["Month", "data"])
    all_errors = errors.groupBy("Month", "Alg").agg(F.sum("e").alias("e"), F.sum("n_e").alias("n_e"))
    all_totals = totals.groupBy("Month").agg(F.sum("t").alias("t"), F.sum("n_t").alias("n_t"))
    overall = all_totals.join(all_errors, "Month", "left").withColumn("data", F.lit("All"))
    return by_series.unionByName(overall).select(
        "Month",
        F.year("Month").alias("year"),
        "data",
        "Alg",
        "e",
        "n_e",
        "t",
        "n_t",
        F.try_divide("e", "t").alias("pe"),
        F.try_divide("n_e", "n_t").alias("pn"),
    )


def yearly_outliers(monthly: DataFrame) -> DataFrame:
    """Yearly sums of the Combined rows of :func:`monthly_outliers`."""
    sums = [F.sum(c).alias(c) for c in ("e", "n_e", "t", "n_t")]
    return (
        monthly.filter(F.col("Alg") == "Combined")
        .groupBy("year", "data")
        .agg(*sums)
        .withColumn("pe", F.try_divide("e", "t"))
        .withColumn("pn", F.try_divide("n_e", "n_t"))
    )


def outlier_percentages(yearly: DataFrame) -> DataFrame:
    """Share of values without flags and size of flagged values, long."""
    return (
        yearly.filter(F.col("data") == "All")
        .select("year", (1 - F.col("pn")).alias("percent_no_error"), F.col("pe").alias("percent_value_no_error"))
        .unpivot(["year"], ["percent_no_error", "percent_value_no_error"], "name", "value")
    )

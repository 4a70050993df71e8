"""Decomposition of many series by local regression, as windows over each series.

The trend at a period is a line through the periods around it, weighted by the
tricube of the distance; the season is the mean, by month (or week) of the year, of what the trend
leaves. A first season comes from the distances to means over whole years; trend and season are
then found twice, the trend from values freed of the latest season. Where ``robust`` is asked for, values far from the series' median weigh
little at first, and those far from the first fit then. Periods without a value take no part, so gaps need no filling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import MAD_SCALE
from .outliers import off_season
from .series_fits import month_number

# Fewest values; the reach of remainders in interquartile ranges; of robust weights in medians.
MIN_VALUES = 12
IQR_REACH = 3.0
ROBUST_REACH = 6.0
# Periods of a year, and how many on either side a trend's line takes in (one and a half years in all).
AXES = {"Month": (12, 9), "Week": (52, 39)}
NOISE = 1e-9
LEAST_SHARE = 0.01  # remainders within a hundredth of the value are no outliers, however even the series


def _place(period: str) -> tuple[Column, Column]:
    """(number of the period, its season)."""
    if period == "Week":
        return F.floor(F.date_diff(F.col(period), F.lit("1970-01-05").cast("date")) / 7).cast("int"), F.weekofyear(period)
    return month_number(F.col(period)), F.month(period)


def _with_line(df: DataFrame, name: str, value: Column, keys: list[str], reach: int) -> DataFrame:
    """Adds the weighted line through the values around, at the period itself; columns _t and _weight.

    A distance has one tricube weight, so what lies at each distance is summed by itself (a period may lack rows or
    have several), and the sums of the line are sums over distances.
    """
    order = W.partitionBy(*keys).orderBy("_t")
    known = value.isNotNull()
    df = df.withColumns({"_lw": F.when(known, F.col("_weight")), "_ly": F.when(known, F.col("_weight") * value)})
    steps = range(-reach, reach + 1)
    at = {f"_l{c}{k + reach}": F.sum(f"_l{c}").over(order.rangeBetween(k, k)) for k in steps for c in "wy"}
    df = df.withColumns(at)

    def total(c: str, power: int) -> Column:
        terms = [F.coalesce(f"_l{c}{k + reach}", F.lit(0.0)) * F.lit((1 - abs(k / (reach + 1)) ** 3) ** 3 * (k / (reach + 1)) ** power) for k in steps if k or not power]
        return reduce(lambda a, b: a + b, terms)

    sums = {"_sw": total("w", 0), "_sd": total("w", 1), "_sdd": total("w", 2), "_sy": total("y", 0), "_sdy": total("y", 1)}
    df = df.withColumns(sums).drop("_lw", "_ly", *at)
    w, d, dd, y, dy = (F.col(c) for c in sums)
    spread = w * dd - d * d
    line = F.when(spread > NOISE * w * w, (dd * y - d * dy) / spread).when(w > 0, y / w)
    # Rows without a period are each other's peers in every frame, at no distance: they have no line.
    return df.withColumn(name, F.when(F.col("_t").isNotNull(), line)).drop(*sums)


def _robust_weight(rows: DataFrame, rest: Column, keys: list[str]) -> DataFrame:
    """_weight: 1 for what is near, falling to next to nothing at six medians of the distance."""
    whole = W.partitionBy(*keys)
    rows = rows.withColumn("_gap", F.abs(rest)).withColumn("_far", F.greatest(ROBUST_REACH * F.median("_gap").over(whole), F.lit(NOISE)))
    share = F.least(F.col("_gap") / F.col("_far"), F.lit(1.0))
    # Never quite 0, so that every season and window keeps a weight.
    weight = F.coalesce(F.greatest(F.pow(1 - share * share, F.lit(2.0)), F.lit(1e-6)), F.lit(1.0))
    return rows.withColumn("_weight", weight).drop("_gap", "_far")


def decomposed(df: DataFrame, value: str, keys: list[str], period: str, robust: bool) -> DataFrame:
    """Adds _t, _trend, _season and _rest of ``value``. Series of less than two years of rows have no season."""
    year, reach = AXES.get(period, AXES["Month"])
    t, part = _place(period)
    whole = W.partitionBy(*keys)
    out = df.withColumns({"_t": t, "_part": part, "_weight": F.lit(1.0), "_long": F.count(F.lit(1)).over(whole) >= 2 * year})
    # A mean over exactly one year holds no season; a median over years no single spike.
    order, half = W.partitionBy(*keys).orderBy("_t"), year // 2
    wide, tight = order.rangeBetween(-half, half), order.rangeBetween(1 - half, half - 1)
    out = out.withColumn("_year", F.when(F.count(value).over(wide) == year + 1, (F.sum(value).over(wide) + F.sum(value).over(tight)) / (2 * year)))
    out = out.withColumn("_level", F.median(F.col(value) - F.col("_year")).over(W.partitionBy(*keys, "_part")))
    out = out.withColumn("_level", F.when(F.col("_long"), F.coalesce("_level", F.lit(0.0))).otherwise(0.0))
    out = out.withColumn("_season", F.col("_level") - F.avg("_level").over(whole)).drop("_year")
    if robust:
        out = _robust_weight(out.withColumn("_centre", F.median(value).over(whole)), F.col(value) - F.col("_centre"), keys).drop("_centre")
    for second in (False, True):
        out = _with_line(out, "_trend", F.col(value) - F.col("_season"), keys, reach)
        left = F.col(value) - F.col("_trend")
        mean = F.sum(left * F.col("_weight")).over(W.partitionBy(*keys, "_part")) / F.sum(F.when(left.isNotNull(), F.col("_weight"))).over(W.partitionBy(*keys, "_part"))
        out = out.withColumn("_level", F.coalesce(F.when(F.col("_long"), mean), F.lit(0.0)))
        out = out.withColumn("_season", F.col("_level") - F.avg("_level").over(whole))
        out = out.withColumn("_rest", F.col(value) - F.col("_trend") - F.col("_season"))
        if robust and not second:
            out = _robust_weight(out, F.col("_rest"), keys)
    return out.drop("_part", "_weight", "_level", "_long")


def _filled(value: Column, keys: list[str]) -> Column:
    """``value`` where it is known, else on the line between its neighbours, else the nearest one; column _t."""
    order = W.partitionBy(*keys).orderBy("_t")
    seen = F.when(value.isNotNull(), F.struct(F.col("_t").alias("t"), value.alias("v")))
    before = F.last(seen, True).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(seen, True).over(order.rowsBetween(0, W.unboundedFollowing))
    between = before["v"] + (after["v"] - before["v"]) * (F.col("_t") - before["t"]) / (after["t"] - before["t"])
    return F.coalesce(value, between, before["v"], after["v"])


def clean_series(df: DataFrame, value: str, keys: list[str], period: str = "Month") -> DataFrame:
    """keys, period and ``cleaned``: the series with remainder outliers replaced.

    Outliers are remainders, on the square-root scale, beyond three interquartile ranges of their
    quartiles; they become the season on the line between their neighbours. Missing values stay missing.
    """
    return with_cleaned(df.select(*keys, period, value), value, keys, period).select(*keys, period, "cleaned")


def with_cleaned(df: DataFrame, value: str, keys: list[str], period: str = "Month") -> DataFrame:
    """Adds ``cleaned``, as :func:`clean_series` says, to all columns."""
    whole, x = W.partitionBy(*keys), F.col(value).cast("double")
    out = df.withColumns({"_y": 2 * (F.sqrt(F.greatest(x, F.lit(0.0))) - 1), "_y_n": F.count(x).over(whole)})
    out = out.withColumn("_y", F.when(x.isNotNull(), F.col("_y")))
    out = decomposed(out, "_y", keys, period, True)
    out = out.withColumns({f"_q{k}": F.percentile("_rest", F.lit(k / 4)).over(whole) for k in (1, 3)})
    width = IQR_REACH * (F.col("_q3") - F.col("_q1")) + F.lit(LEAST_SHARE) * (1 + F.abs(F.col("_y")))
    odd = (F.col("_rest") < F.col("_q1") - width) | (F.col("_rest") > F.col("_q3") + width)
    out = out.withColumn("_odd", F.coalesce(odd & (F.col("_y_n") >= MIN_VALUES), F.lit(False)))
    smooth = _filled(F.when(~F.col("_odd"), F.col("_y") - F.col("_season")), keys) + F.col("_season")
    out = out.withColumn("_smooth", smooth)
    out = out.withColumn("cleaned", F.when(F.col("_odd"), F.pow(1 + F.col("_smooth") / 2, F.lit(2.0))).otherwise(x))
    return out.drop("_y", "_y_n", "_t", "_trend", "_season", "_rest", "_q1", "_q3", "_odd", "_smooth")


def model_seasonal_flags(df: DataFrame, keys: list[str], mad: str = "mad10", period: str = "Month") -> DataFrame:
    """seasonal5, seasonal3 and expected from :func:`clean_series` over the
    values that ``mad`` leaves."""
    masked = df.withColumn("_x", F.when(~F.col(mad), F.col("original")))
    w = W.partitionBy(*keys)
    out = with_cleaned(masked, "_x", keys, period).withColumnRenamed("cleaned", "expected").withColumn("_c", F.median("_x").over(w))
    out = out.withColumn("_m", F.lit(MAD_SCALE) * F.median(F.abs(F.col("_x") - F.col("_c"))).over(w))
    return out.withColumns(
        {f"seasonal{k}": off_season(F.col("_x"), F.col("expected"), F.col("_m"), float(k)) for k in (5, 3)}
    ).drop("_x", "_c", "_m")


def remainder_outliers(
    df: DataFrame, value: str, keys: list[str], deviation: float = 3.0, method: str = "sd", period: str = "Month"
) -> DataFrame:
    """keys, period, value and ``outlier``: is the remainder beyond ``deviation`` SDs (or MADs)?

    NULL for periods without a value, and for series of less than two years of rows or with fewer than 12
    values. Fill gaps first.
    """
    whole = W.partitionBy(*keys)
    out = df.select(*keys, period, F.col(value).cast("double").alias(value))
    out = decomposed(out, value, keys, period, False)
    out = out.withColumns({"_centre": F.median("_rest").over(whole), "_top": F.max(F.abs(value)).over(whole)})
    apart = F.median(F.abs(F.col("_rest") - F.col("_centre"))).over(whole)
    scale = F.stddev_samp("_rest").over(whole) if method == "sd" else F.lit(MAD_SCALE) * apart
    out = out.withColumn("_limit", deviation * scale + F.lit(NOISE) * (1 + F.col("_top")))
    year = AXES.get(period, AXES["Month"])[0]
    enough = (F.count(F.lit(1)).over(whole) >= 2 * year) & (F.count(value).over(whole) >= MIN_VALUES)
    return out.withColumn("_enough", enough).select(*keys, period, value, F.when(F.col("_enough"), F.abs("_rest") > F.col("_limit")).alias("outlier"))

"""Forecasts of many series, ensembles, error measures and impact.

Forecast draws are rows: key columns, ``Month, model, draw, sample``. Models are
fitted to all series at once (:mod:`.series_fits`) and give the mean and spread of each month;
draws are made from those by hash.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import draws as rnd
from ..functions.flags import any_set, flags_through, present
from ..sources.staging import settle
from .reporting import champion_grid, within
from .series_fits import fits
from .totals import aggregate_hierarchy

MODELS = ("a", "e", "s", "t")  # autoregression, smoothing, seasonal naive, trend and season


# -- native point forecasts ------------------------------------------------------------


def seasonal_naive(df: DataFrame, keys: list[str], cut, horizon: int = 12, season: int = 12) -> DataFrame:
    """Value of the latest same season before the cut, for each month ahead."""
    c = F.lit(str(cut)).cast("date")
    last = df.filter((F.col("Month") < c) & (F.col("Month") >= F.add_months(c, -season)))
    cycles = -(-horizon // season)
    return (
        last.select(*keys, "total", F.explode(F.sequence(F.lit(1), F.lit(cycles))).alias("k"), F.col("Month").alias("m0"))
        .withColumn("Month", F.add_months("m0", F.col("k") * season))
        .filter((F.col("Month") >= c) & (F.col("Month") < F.add_months(c, horizon)))
        .select(*keys, "Month", F.col("total").alias("mean"))
    )


def _index(month: Column) -> Column:
    return F.year(month) * 12 + F.month(month)


def trend_forecast(df: DataFrame, keys: list[str], cut, horizon: int = 12) -> DataFrame:
    """Straight line through the values before the cut, extended."""
    c = F.lit(str(cut)).cast("date")
    t = _index(F.col("Month")).cast("double")
    fits = (
        df.filter((F.col("Month") < c) & F.col("total").isNotNull())
        .groupBy(*keys)
        .agg(F.regr_slope("total", t).alias("slope"), F.regr_intercept("total", t).alias("intercept"))
    )
    ahead = F.sequence(c, F.add_months(c, horizon - 1), F.expr("interval 1 month"))
    return fits.withColumn("Month", F.explode(ahead)).select(
        *keys, "Month", (F.col("intercept") + F.col("slope") * _index(F.col("Month"))).alias("mean")
    )


# -- one model per series -----------------------------------------------------------------


def fit_forecast(
    df: DataFrame,
    keys: list[str],
    cut,
    horizon: int = 12,
    models: tuple[str, ...] = MODELS,
    transform: str | None = None,
    covariate: str | None = None,
) -> DataFrame:
    """Fit each model to each series before the cut and forecast ``horizon``
    months: mean and spread on the model's scale, and a status.

    Months without a value are gaps. Of rows that repeat a month the largest counts. A model that
    cannot be fitted gives rows with a status other than ok.
    """
    return fits(df, keys, cut, horizon, tuple(models), transform, covariate)


def fitted_only(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Drop models of a series that failed."""
    return fits.filter(F.col("status") == "ok")


def _back(x: Column, transform: str | None) -> Column:
    if transform == "log1p":
        return F.expm1(x)
    if transform == "sqrt":
        return F.pow(1.0 + x / 2.0, F.lit(2.0))
    return x


def forecast_draws(
    fits: DataFrame, keys: list[str], n_draws: int = 2000, seed: int = 1432, transform: str | None = None
) -> DataFrame:
    """Independent normal draws per series, model and month, on the data scale."""
    ident = [seed, *[F.col(k) for k in keys], F.col("model"), F.col("Month"), F.col("draw")]
    sample = F.col("mean") + F.col("sd") * rnd.normal(*ident)
    return (
        fits.filter(F.col("status") == "ok")
        .withColumn("draw", rnd.draw_ids(n_draws))
        .select(*keys, "Month", "model", "draw", _back(sample, transform).alias("sample"))
    )


def point_forecast(drawn: DataFrame, keys: list[str], level: float = 0.8) -> DataFrame:
    """Mean and interval per series, model and month over its draws."""
    tail = (1 - level) / 2
    return drawn.groupBy(*keys, "Month", "model").agg(
        F.avg("sample").alias("mean"),
        F.percentile("sample", F.lit(tail)).alias("lower"),
        F.percentile("sample", F.lit(1 - tail)).alias("upper"),
    )


def pre_window_forecast(df: DataFrame, keys: list[str], evaluation_month, periods: int = 12, **kw) -> DataFrame:
    """Fit up to one year before the evaluation month and forecast that year."""
    cut = (pd.Timestamp(evaluation_month) - pd.DateOffset(months=periods)).date()
    return fit_forecast(df, keys, cut, periods, **kw)


def window_forecast(df: DataFrame, keys: list[str], evaluation_month, horizon: int = 12, **kw) -> DataFrame:
    """Fit up to the evaluation month and forecast from it."""
    return fit_forecast(df, keys, evaluation_month, horizon, **kw)


# -- ensembles ---------------------------------------------------------------------------------


def ensembles(drawn: DataFrame, keys: list[str], models: list[str], only: list[str] | None = None) -> DataFrame:
    """The given models and every combination of them, as draw-wise means.

    A combination is named by joining its members; it exists where all
    members have the draw. Each draw row is sent to the combinations its
    model belongs to.
    """
    names = sorted(models)
    combos = [c for n in range(1, len(names) + 1) for c in combinations(names, n)]
    if only is not None:
        combos = [c for c in combos if "".join(c) in only]
    sends = F.array(
        *[
            F.struct(F.lit(m).alias("m"), F.lit("".join(c)).alias("combo"), F.lit(len(c)).alias("size"))
            for c in combos
            for m in c
        ]
    )
    return (
        drawn.withColumn("s", F.explode(F.filter(sends, lambda s: s["m"] == F.col("model"))))
        .groupBy(F.col("s.combo").alias("model"), F.col("s.size").alias("size"), *keys, "Month", "draw")
        .agg(F.avg("sample").alias("sample"), F.count("sample").alias("n"))
        .filter(F.col("n") == F.col("size"))
        .select(*keys, "Month", "model", "draw", "sample")
    )


def draw_summary(drawn: DataFrame, keys: list[str]) -> DataFrame:
    return drawn.groupBy(*keys, "Month", "model").agg(
        F.avg("sample").alias("mean"), F.stddev_samp("sample").alias("sd")
    )


# -- error measures -----------------------------------------------------------------------------


def _with_actual(drawn: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    truth = actual.select(*keys, "Month", F.col("total").alias("actual"))
    return drawn.join(truth, [*keys, "Month"])


def swape(drawn: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Symmetric weighted error per model: by draw, then averaged."""
    per_draw = (
        _with_actual(drawn, actual, keys)
        .groupBy(*keys, "model", "draw")
        .agg(
            F.try_divide(
                200 * F.sum(F.abs(F.col("actual") - F.col("sample"))),
                F.sum(F.abs("actual")) + F.sum(F.abs("sample")),
            ).alias("swape")
        )
    )
    return per_draw.groupBy(*keys, "model").agg(F.avg("swape").alias("swape"))


def rank_models(accuracy: DataFrame, metric: str, groups: list[str] | None = None, top: int | None = None) -> DataFrame:
    """Rank by a metric, percent gap to the best, and the model's mean; all
    ranks unless a report asks for the first ``top``."""
    means = accuracy.groupBy("model").agg(F.avg(metric).alias("mean"))
    w = W.partitionBy(*(groups or [F.lit(1)])).orderBy(F.asc(metric), F.asc("model"))
    shown = F.round(metric, 3)
    best = F.first(shown).over(w)
    return (
        accuracy.withColumn("rank", F.row_number().over(w))
        .withColumn("percent_diff", F.round(100 * F.try_divide(shown - best, best), 3))
        .withColumn(metric, shown)
        .filter(F.lit(True) if top is None else F.col("rank") <= top)
        .join(means, "model")
    )


def choose_model(accuracy: DataFrame, how: str = "synchronize", groups: list[str] | None = None) -> DataFrame:
    """``synchronize``: the one model with the lowest mean for all groups;
    ``optimize``: the best of each group."""
    if how == "optimize":
        return rank_models(accuracy, "swape", groups).filter("rank = 1").select(*(groups or []), "model")
    means = accuracy.groupBy("model").agg(F.avg("swape").alias("mean"))
    # Picked in one aggregation: means computed twice may differ in their last digit.
    best = means.agg(F.min_by("model", F.struct("mean", "model"))).scalar()
    return accuracy.filter(F.col("model") == best).select(*(groups or []), "model").distinct()


def best_per_group(drawn: DataFrame, accuracy: DataFrame, groups: list[str]) -> DataFrame:
    """Draws of the best model of each group only."""
    best = choose_model(accuracy.filter(F.col("swape").isNotNull()), "optimize", groups)
    return drawn.join(best, [*groups, "model"], "left_semi")


def wpe(drawn: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted percent difference of actual from forecast per model and draw."""
    e = F.sum(F.col("actual") - F.col("sample"))
    return (
        _with_actual(drawn, actual, keys)
        .groupBy(*keys, "model", "draw")
        .agg((F.try_divide(e, F.sum("sample")) * 100).alias("WPE"))
    )


def wpe_summary(differences: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, SD and median over draws."""
    return differences.groupBy(*keys, "model").agg(
        F.count("WPE").alias("n"),
        F.avg("WPE").alias("mean"),
        F.stddev_samp("WPE").alias("sd"),
        F.median("WPE").alias("median"),
    )


def wpe_histogram(differences: DataFrame, keys: list[str]) -> DataFrame:
    """Draws per unit-wide bin, with the bin of the median marked."""
    mid = wpe_summary(differences, keys).select(*keys, "model", F.round("median", 0).alias("_mid"))
    return (
        differences.groupBy(*keys, "model", F.round("WPE", 0).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(mid, [*keys, "model"])
        .withColumn("is_median", F.col("bin") == F.col("_mid"))
        .drop("_mid")
    )


def change_probability(differences: DataFrame, keys: list[str]) -> DataFrame:
    """Probability of a decrease where the median is negative, else of an increase."""
    down = F.median("WPE") < 0
    return differences.groupBy(*keys, "model").agg(
        F.when(down, "decrease").otherwise("increase").alias("direction"),
        F.when(down, F.avg((F.col("WPE") < 0).cast("double")))
        .otherwise(F.avg((F.col("WPE") > 0).cast("double")))
        .alias("probability"),
    )


def overall_errors(point: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute and mean percent error over all rows."""
    d = _with_actual(point, actual, keys)
    a, p = F.col("actual"), F.col("mean")
    return d.agg(
        F.when(F.avg(a) > 0, F.avg(F.abs(a - p)) / F.avg(a)).alias("mape"),
        F.when(F.avg(p) > 0, F.avg(a - p) / F.avg(p)).alias("mpe"),
    )


def key_mape(point: DataFrame, actual: DataFrame, keys: list[str], horizon: int = 12) -> DataFrame:
    """Error per series with a label position at the middle of the horizon."""
    d = _with_actual(point, actual, keys)
    a, p = F.col("actual"), F.col("mean")
    months = F.array_sort(F.collect_list("Month"))  # one per month of the horizon
    return d.groupBy(*keys).agg(
        F.when(F.avg(p) > 0, F.avg(F.abs(a - p)) / F.avg(p)).alias("mape"),
        F.get(months, F.lit(round(horizon / 2) - 1)).alias("Month"),
        F.max(a).alias("actual"),
    )


def key_mpe(point: DataFrame, actual: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Summed actual, forecast and bounds, and their relative difference."""
    gap = F.col("actual") - F.col("predicted")
    return (
        _with_actual(point, actual, keys)
        .groupBy(*(by if by is not None else keys))
        .agg(
            F.sum("mean").alias("predicted"),
            F.sum("upper").alias("pred_upper"),
            F.sum("lower").alias("pred_lower"),
            F.sum("actual").alias("actual"),
        )
        .withColumns(
            {
                "diff": gap,
                "mpe": F.try_divide(gap, "predicted"),
                "mape": F.try_divide(F.abs(gap), "predicted"),
            }
        )
    )


def mpe_distribution(drawn: DataFrame, actual: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Relative difference of summed actuals per draw; months without an
    actual value count on neither side."""
    d = _with_actual(drawn, actual, keys)
    fore = F.sum(F.when(F.col("actual").isNotNull(), F.col("sample")))
    return (
        d.groupBy(*(by or []), "draw")
        .agg(F.sum("actual").alias("actual"), fore.alias("forecast"))
        .withColumn("mpe", F.try_divide(F.col("actual") - F.col("forecast"), "forecast"))
    )


def share_at_most(distribution: DataFrame, target: float, value: str = "mpe", by: list[str] | None = None) -> DataFrame:
    return distribution.groupBy(*(by or [])).agg(
        F.count(value).alias("n"), F.avg((F.col(value) <= target).cast("double")).alias("share")
    )


def density_interval(drawn: DataFrame, value: str, by: list[str], mass: float = 0.9) -> DataFrame:
    """Narrowest interval holding ``mass`` of the draws of each group.

    A group holds one value per draw, so its sorted values fit in a row.
    """
    sorted_values = F.array_sort(F.collect_list(value))
    s, n = F.col("_s"), F.size("_s")
    k = F.floor(n * F.lit(mass)).cast("int")
    widths = F.zip_with(
        F.slice(s, F.lit(1), n - k),
        F.slice(s, k + 1, n - k),
        lambda a, b: F.struct((b - a).alias("width"), a.alias("lo"), b.alias("hi")),
    )
    return (
        drawn.groupBy(*by)
        .agg(sorted_values.alias("_s"))
        .withColumn("_best", F.array_min(widths))
        .select(*by, F.col("_best.lo").alias("hdi_lower"), F.col("_best.hi").alias("hdi_upper"))
    )


# -- group comparison ---------------------------------------------------------------------------


def group_difference(differences: DataFrame, group_col: str, comparator: str, treated: str) -> DataFrame:
    """Treated minus comparator, draw by draw."""
    side = lambda g, n: differences.filter(F.col(group_col) == g).select("model", "draw", F.col("WPE").alias(n))
    return (
        side(treated, "t")
        .join(side(comparator, "c"), ["model", "draw"])
        .select("model", "draw", (F.col("t") - F.col("c")).alias("WPE"))
    )


def probability_below(difference: DataFrame, thresholds: tuple[float, ...] = (0.0, -10.0, -20.0)) -> DataFrame:
    """Share of draws at or below each threshold."""
    limits = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    return (
        difference.withColumn("threshold", limits)
        .groupBy("model", "threshold")
        .agg(F.avg((F.col("WPE") <= F.col("threshold")).cast("double")).alias("probability"))
    )


def impact_table(differences: DataFrame, group_col: str, comparator: str, treated: str, mass: float = 0.95) -> DataFrame:
    """Per group and for the difference: n, mean, SD, median and interval."""
    gap = group_difference(differences, group_col, comparator, treated).withColumn(
        group_col, F.lit(f"{treated} - {comparator}")
    )
    both = differences.filter(F.col(group_col).isin(comparator, treated)).select(group_col, "model", "draw", "WPE")
    rows = both.unionByName(gap)
    by = [group_col, "model"]
    return wpe_summary(rows, [group_col]).join(density_interval(rows, "WPE", by, mass), by)


def bottom_up(drawn: DataFrame, spec: str) -> DataFrame:
    """Forecasts of every hierarchy node as sums of leaf draws."""
    leaves = drawn.withColumnRenamed("sample", "total")
    return aggregate_hierarchy(leaves, spec, fixed=["model", "draw"]).withColumnRenamed("total", "sample")


def model_ranks(accuracy: DataFrame, group_col: str) -> DataFrame:
    """Per model: mean and SD of its error and mean rank over groups, with the
    order by mean error and by mean rank."""
    w = W.partitionBy(group_col).orderBy("swape", "model")
    per_model = (
        accuracy.withColumn("rank", F.row_number().over(w))
        .groupBy("model")
        .agg(
            F.avg("swape").alias("mean_swape"),
            F.stddev_samp("swape").alias("sd_swape"),
            F.avg("rank").alias("mean_rank"),
        )
    )
    one = W.partitionBy(F.lit(1))  # one row per model
    return per_model.withColumns(
        {
            "rank_by_mean": F.row_number().over(one.orderBy("mean_swape", "model")),
            "rank_of_ranks": F.row_number().over(one.orderBy("mean_rank", "model")),
        }
    )


# -- scenarios --------------------------------------------------------------------------------------


def scenario_totals(df: DataFrame, settings: list[dict], keys: list[str]) -> DataFrame:
    """Monthly totals under many settings in one pass.

    Each setting has ``setting``, ``error`` (a cleaning level or none) and
    the champion options of :func:`champion_grid`. Facts are summed by
    facility first; these sums are sent to the settings in which their facility is
    a champion.
    """
    levels = {s["setting"]: s.get("error", "none") for s in settings}
    value = {
        lv: F.when(~any_set(present(df, flags_through(lv))), F.col("original")) for lv in set(levels.values())
    }
    chosen = reduce(
        lambda acc, kv: acc.when(F.col("setting") == kv[0], F.col(f"_v_{kv[1]}")),
        levels.items(),
        F.when(F.lit(False), F.lit(None).cast("double")),
    )
    sums = df.groupBy("orgUnit", *keys, "Month").agg(*[F.sum(c).alias(f"_v_{lv}") for lv, c in value.items()])
    units = champion_grid(df, settings)
    return (
        sums.join(units, "orgUnit")
        .withColumn("v", chosen)
        .groupBy("setting", *keys, "Month")
        .agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"))
    )


def scenario_errors(
    df: DataFrame, settings: list[dict], keys: list[str], evaluation_month, horizon: int = 12,
    model: str = "t", transform: str | None = None,
) -> DataFrame:
    """Fit and score one model per setting and series.

    The totals, which are fitted and scored, are worked out once and stored.
    """
    totals = settle(scenario_totals(df, settings, keys))
    all_keys = ["setting", *keys]
    fits = fitted_only(window_forecast(totals, all_keys, evaluation_month, horizon, models=(model,), transform=transform), all_keys)
    point = fits.withColumn("mean", _back(F.col("mean"), transform))
    return key_mape(point, within(totals, "Month", evaluation_month), all_keys, horizon)

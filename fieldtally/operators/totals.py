"""Totals over any hierarchy, trend preparation and series statistics."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.flags import is_set
from ..functions.joins import lookup
from ..functions.periods import period_column
from . import reporting
from .conform import fill_gaps
from .derived import pair_rule
from .outliers import cleaned_data

ALL = "<aggregated>"


def total_by(
    df: DataFrame,
    group_cols: list[str],
    start=None,
    end=None,
    covariates: list[str] | None = None,
    merge_datasets: list[str] | None = None,
    mean_merge: bool = False,
) -> DataFrame:
    """Sum ``dataCol`` by any columns.

    Covariates are averaged. Where the table has a numerator and a
    denominator, the pair rule applies and totals are ratios of sums.
    ``merge_datasets`` relabels those data sets as Combined, row by row;
    ``mean_merge`` averages over data sets instead of adding them up.
    ``total`` is the result with 0 for NULL.
    """
    group_cols = [c for c in group_cols if c in df.columns]
    if merge_datasets:
        hit = F.col("dataSet").isin(merge_datasets)
        df = df.withColumn("dataSet", F.when(hit, F.lit("Combined")).otherwise(F.col("dataSet")))
    ratio = {"numerator", "denominator"} <= set(df.columns)
    aggs = [stats.sum0(F.col("dataCol")).alias("dataCol")]
    if ratio:
        df = pair_rule(df)
        aggs += [F.sum(c).alias(c) for c in ("numerator", "denominator")]
    aggs += [F.avg(c).alias(c) for c in (covariates or []) if c not in group_cols]
    out = df.groupBy(*group_cols).agg(*aggs)
    if ratio:
        d = F.col("denominator")
        out = out.withColumn(
            "dataCol",
            F.when(d > 0, F.try_divide("numerator", "denominator")).when(d.isNull() | (d != 0), F.col("dataCol")),
        )
    if mean_merge:
        keys = [c for c in group_cols if c != "dataSet"]
        out = (
            out.groupBy(*keys)
            .agg(F.avg("dataCol").alias("dataCol"))
            .withColumn("dataSet", F.lit("Merged"))
        )
    period = period_column(out)
    if period in out.columns and start is not None and end is not None:
        out = reporting.within(out, period, start, end)
    return out.withColumn("total", F.coalesce("dataCol", F.lit(0.0)))


def hierarchy_sets(spec: str) -> list[tuple[str, ...]]:
    """Grouping sets of a hierarchy formula.

    ``a / b / c`` is nested: the prefixes (), (a), (a,b), (a,b,c).
    ``x * y`` is crossed: every combination of each side's sets.
    """
    sides = []
    for part in spec.replace("(", " ").replace(")", " ").split("*"):
        names = [n.strip().strip("`") for n in part.split("/") if n.strip()]
        sides.append([tuple(names[:i]) for i in range(len(names) + 1)])
    return [tuple(c for s in combo for c in s) for combo in product(*sides)]


def hierarchy_spec(
    level_names: list[str],
    agg_level: str | None = None,
    all_levels: bool = False,
    num_facilities: int = 1,
    num_datasets: int = 1,
    split: list[str] | None = None,
) -> str:
    """Formula text: levels down to ``agg_level`` nested; Selected, dataSet and
    splits crossed when there is more than one of them."""
    levels = level_names
    if not all_levels and agg_level is not None:
        levels = level_names[: level_names.index(agg_level) + 1]
    crossed = list(split or [])
    if num_datasets > 1:
        crossed.append("dataSet")
    if num_facilities > 1:
        crossed.append("Selected")
    path = " / ".join(levels) if (all_levels or agg_level is not None) else ""
    return " * ".join([*crossed, *([path] if path else [])])


def aggregate_hierarchy(
    df: DataFrame,
    spec: str,
    covariates: list[str] | None = None,
    period: str | None = None,
    fixed: list[str] | None = None,
) -> DataFrame:
    """Totals of every node of a hierarchy per period, in one pass.

    ``fixed`` columns are never summed over, like the period.
    Columns that a node sums over hold ``<aggregated>``. Ratio tables get
    ratios of sums; covariates are averaged.
    """
    period = period or period_column(df)
    keep = [period, *(fixed or [])]
    sets = hierarchy_sets(spec)
    names = list(dict.fromkeys(c for s in sets for c in s))
    ratio = {"numerator", "denominator"} <= set(df.columns)
    aggs = [stats.sum0(F.col("total")).alias("total")]
    if ratio:
        df = pair_rule(df)
        aggs += [stats.sum0(F.col(c)).alias(c) for c in ("numerator", "denominator")]
    aggs += [F.avg(c).alias(c) for c in (covariates or [])]
    grouped = df.groupingSets(
        [[F.col(c) for c in (*keep, *s)] for s in sets], *[F.col(c) for c in (*keep, *names)]
    ).agg(*aggs, *[F.grouping(c).alias(f"_g_{c}") for c in names])
    total = F.col("total")
    if ratio:
        total = F.when(F.col("denominator") > 0, F.try_divide("numerator", "denominator")).otherwise(total)
    shown = [
        F.when(F.col(f"_g_{c}") == 1, F.lit(ALL)).otherwise(F.col(c).cast("string")).alias(c) for c in names
    ]
    rest = (["numerator", "denominator"] if ratio else []) + list(covariates or [])
    return grouped.select(*keep, *shown, total.alias("total"), *rest)


def national_node(nodes: DataFrame, level_names: list[str], split: list[str] | None = None) -> DataFrame:
    """Nodes summed over all regions, each value of the splits kept apart."""
    out = nodes
    for c in level_names:
        if c in out.columns:
            out = out.filter(F.col(c) == ALL).drop(c)
    for c in split or []:
        out = out.filter(F.col(c) != ALL)
    return out


def grouped_totals(df: DataFrame, group_cols: list[str], covariates: list[str] | None = None) -> DataFrame:
    keys = [c for c in group_cols if c in df.columns]
    return df.groupBy(*keys).agg(
        stats.sum0(F.col("total")).alias("total"), *[F.avg(c).alias(c) for c in (covariates or [])]
    )


def trend_data(
    nodes: DataFrame,
    keys: list[str],
    start=None,
    end=None,
    selected_only: bool = False,
    covariates: list[str] | None = None,
    drop_aggregates: list[str] | None = None,
    split: str | None = None,
    scale: bool = False,
) -> DataFrame:
    """Regular series for charts and models.

    Champions only when asked for; window; missing periods added; covariates
    joined again as medians over the keys other than Selected; nodes summed
    over ``drop_aggregates`` removed; ``grouping_var`` names the split, and
    with ``scale`` totals are z-scores within it, plus one.
    """
    period = period_column(nodes)
    rows = nodes
    if selected_only and "Selected" in rows.columns:
        rows = rows.filter(F.col("Selected") == "Champion")
    rows = reporting.within(rows, period, start, end)
    for c in drop_aggregates or []:
        rows = rows.filter((F.col(c) != ALL) & F.col(c).isNotNull())
    cov = list(covariates or [])
    out = fill_gaps(rows.drop(*cov), keys, period)
    if cov:
        at = [k for k in keys if k not in ("Selected", "agegrp")]
        medians = nodes.groupBy(*at, period).agg(*[F.median(c).alias(c) for c in cov])
        out = out.join(medians, [*at, period], "left")
    out = out.withColumn("grouping_var", F.col(split) if split else F.lit("Total"))
    if scale:
        sums = out.groupBy("grouping_var").agg(F.avg("total").alias("m"), F.stddev_samp("total").alias("s"))
        scale_of = lookup(sums, "grouping_var", F.struct("m", "s"))
        out = (
            out.filter(F.col("grouping_var").isNotNull())
            .withColumn("_of", F.try_element_at(scale_of, F.col("grouping_var")))
            .withColumn("total", F.try_divide(F.col("total") - F.col("_of.m"), F.col("_of.s")) + 1)
            .drop("_of")
        )
    return out


def model_table(
    df: DataFrame,
    group_cols: list[str],
    error: str | None = None,
    hierarchy: str | None = None,
    covariates: list[str] | None = None,
) -> DataFrame:
    """Label errors, censor, total and aggregate: the input of the models."""
    censored = cleaned_data(df, error)
    period = period_column(df)
    keys = [period, *[c for c in group_cols if c != period]]
    totals = total_by(censored, keys, covariates=covariates)
    if hierarchy:
        return aggregate_hierarchy(totals, hierarchy, covariates, period)
    return grouped_totals(totals, keys, covariates)


SEGMENTS = ["full", "pre", "train", "test", "post", "yr1", "yr2", "yr3"]


def split_segments(
    df: DataFrame, start, eval_start, eval_end, test_months: int = 12, groups: list[str] | None = None
) -> DataFrame:
    """Monthly totals with the segments they belong to, one row per segment.

    Grouped tables have no upper bound on the full segment.
    """
    s, e, z = (F.lit(str(d)).cast("date") for d in (start, eval_start, eval_end))
    m = F.col("Month")
    rows = df.filter(m >= s) if groups else df.filter((m >= s) & (m <= z))
    totals = rows.groupBy("Month", *(groups or [])).agg(stats.sum0(F.col("total")).alias("total"))
    cut = F.add_months(e, -test_months)
    year = lambda k: (m >= F.add_months(e, 12 * (k - 1))) & (m < F.add_months(e, 12 * k))
    members = [
        F.lit("full"),
        F.when(m < e, "pre"),
        F.when(m < cut, "train"),
        F.when((m >= cut) & (m < e), "test"),
        F.when((m >= e) & (m <= z), "post"),
        *[F.when(year(k), f"yr{k}") for k in (1, 2, 3)],
    ]
    return totals.withColumn("segment", F.explode(F.array_compact(F.array(*members))))


def yearly_change(df: DataFrame, value: str = "total", period: str = "Month") -> DataFrame:
    """Annual totals and percent change.

    When the last year is incomplete its change compares the same months of
    the year before; ``subset_total`` is the total over those months.
    """
    monthly = df.groupBy(F.year(period).alias("year"), F.month(period).alias("month")).agg(
        stats.sum0(F.col(value)).alias("v")
    )
    everything = W.partitionBy(F.lit(1))  # one row per calendar month at this point
    marked = monthly.withColumn("last_year", F.max("year").over(everything))
    months = F.collect_set(F.when(F.col("year") == F.col("last_year"), F.col("month"))).over(everything)
    marked = marked.withColumn("months", months)
    partial = F.size("months") < 12
    yearly = marked.groupBy("year", "last_year", "months").agg(
        F.sum("v").alias("total"),
        F.sum(F.when(F.array_contains("months", F.col("month")), F.col("v"))).alias("subset_total"),
    )
    w = W.partitionBy(F.lit(1)).orderBy("year")
    prev, prev_subset = F.lag("total").over(w), F.lag("subset_total").over(w)
    prev_year = F.lag("year").over(w)
    use_subset = partial & (F.col("year") == F.col("last_year"))
    base = F.when(use_subset, F.when(prev_year == F.col("year") - 1, prev_subset)).otherwise(prev)
    change = F.round(F.try_divide(F.col("total") - base, base) * 100, 1)
    return yearly.select(
        "year",
        "total",
        F.when(partial, F.col("subset_total")).alias("subset_total"),
        change.alias("pct_change"),
        F.when(change.isNull(), "baseline")
        .when(change > 0, "positive")
        .when(change < 0, "negative")
        .otherwise("zero")
        .alias("direction"),
    )


def seasonal_index(df: DataFrame, value: str = "original", key: str = "dataElement") -> DataFrame:
    """Mean of each month of the year over the mean of those means."""
    means = df.groupBy(key, F.month("Month").alias("month")).agg(F.avg(value).alias("mean_sum"))
    grand = F.avg("mean_sum").over(W.partitionBy(key))
    return means.withColumn("grand_mean", grand).withColumn(
        "seasonal_index",
        F.when(F.col("grand_mean") > 0, F.col("mean_sum") / F.col("grand_mean")).otherwise(F.lit(1.0)),
    )


# -- statistics of the older toolkit --------------------------------------------------


def series_summary(df: DataFrame, keys: list[str], annual: bool = True) -> DataFrame:
    """Counts, outlier and interpolated shares and error means per series.

    ``df`` has ``raw``, ``value``, ``outlier``, ``interpolate`` and ``resid``.
    """
    group = [*keys, *([F.year("Month").alias("year")] if annual else [])]
    ape = F.abs(F.col("resid")) / F.when(F.col("value") != 0, F.col("value"))
    return df.groupBy(*group).agg(
        F.count("raw").alias("n"),
        F.count_if(F.col("raw").isNull()).alias("n_miss"),
        stats.sum0(F.col("raw")).alias("total_raw"),
        stats.sum0(F.col("value")).alias("total_value"),
        stats.sum0(F.col("outlier")).alias("total_outlier"),
        F.try_divide(stats.sum0(F.col("outlier")), stats.sum0(F.col("raw"))).alias("percent_outlier"),
        stats.sum0(F.col("interpolate")).alias("total_interp"),
        F.try_divide(stats.sum0(F.col("interpolate")), stats.sum0(F.col("value"))).alias("percent_interpolate"),
        stats.harmonic_mean(ape).alias("harmonic_ape"),
        stats.geometric_mean(ape).alias("geometric_ape"),
        stats.geometric_sd(ape).alias("geometric_sd_ape"),
        F.avg(ape).alias("mape"),
    )


def beyond_mean_sd(df: DataFrame, keys: list[str], value: str = "original", threshold: float = 3.0) -> DataFrame:
    """Flag values at least ``threshold`` SDs from the series mean."""
    w = W.partitionBy(*keys)
    z = F.try_divide(F.abs(F.col(value) - F.avg(value).over(w)), F.stddev_samp(value).over(w))
    return df.withColumn("outlier", F.coalesce(z >= threshold, F.lit(False)))


def became_null(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Wide tables before and after cleaning, compared cell by cell."""
    a = before.unpivot(keys, columns, "name", "original")
    b = after.unpivot(keys, columns, "name", "cleaned")
    return a.join(b, [*keys, "name"]).withColumn(
        "is_outlier", F.col("cleaned").isNull() & F.col("original").isNotNull()
    )


def with_and_without(values: DataFrame, outliers: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per series of all values and of those not listed as outliers."""
    rows = values.filter(F.col("data").isNull() | (F.col("data") != "NA_NA"))
    with_all = rows.groupBy("data").agg(stats.sum0(F.col("value")).alias("value"))
    kept = rows.join(outliers.select(*keys).distinct(), keys, "left_anti")
    without = kept.groupBy("data").agg(stats.sum0(F.col("value")).alias("value"))
    return with_all.withColumn("name", F.lit("Original Data")).unionByName(
        without.withColumn("name", F.lit("Removed Outliers"))
    )


def mase_by_series(df: DataFrame, champion_units: DataFrame) -> DataFrame:
    """Scaled error of ``expected`` against a last-value forecast per series.

    Mean absolute error over the mean absolute step from one row to the next;
    NULL without any expected value.
    """
    w = W.partitionBy("orgUnit", "data_id").orderBy("Month")
    step = F.abs(F.col("original") - F.lag("original").over(w))
    per = (
        df.withColumn("_step", step)
        .groupBy("orgUnit", "data_id", "data")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            stats.sum0(F.abs(F.col("original") - F.col("expected"))).alias("err"),
            stats.sum0(F.col("_step")).alias("naive"),
            F.count("expected").alias("n_expected"),
            F.count("original").alias("n"),
            stats.sum0(F.col("expected")).alias("expected"),
            stats.sum0(F.col("original")).alias("actual"),
        )
    )
    rows = F.col("rows")
    value = F.when(
        F.col("n_expected") > 0, F.try_divide(F.col("err") * (rows - 1), rows * F.col("naive"))
    )
    m = F.col("MASE")
    label = (
        F.when(m.isNull(), "NA")
        .when(m == 0, "0")
        .when(m <= 0.25, "0_25")
        .when(m <= 0.5, "25_50")
        .when(m <= 1, "50_100")
        .otherwise("100+")
    )
    out = per.withColumn("MASE", value).withColumn("catMASE", label).drop("err", "naive", "n_expected", "rows")
    return reporting.label_champions(out, champion_units)


def _per_facility(mase: DataFrame) -> DataFrame:
    return mase.filter(F.col("MASE") != 0).groupBy("Selected", "orgUnit").agg(F.median("MASE").alias("MASE"))


def mase_summary(mase: DataFrame) -> DataFrame:
    """Mean and SD over facilities of their median error, zeros left out."""
    return _per_facility(mase).groupBy("Selected").agg(
        F.avg("MASE").alias("mean_mase"), F.stddev_samp("MASE").alias("sd_mase"), F.count(F.lit(1)).alias("facilities")
    )


def mase_around(mase: DataFrame, cutpoint: float = 0.4) -> DataFrame:
    """The same split at a cut point into High and Low."""
    return (
        _per_facility(mase)
        .withColumn("model_error", F.when(F.col("MASE") > cutpoint, "High").otherwise("Low"))
        .groupBy("Selected", "model_error")
        .agg(F.avg("MASE").alias("mean_mase"), F.count(F.lit(1)).alias("facilities"))
    )


def group_characteristics(
    facilities: DataFrame, cases: DataFrame, doses: DataFrame, selected_units: DataFrame, reporting_units: DataFrame
) -> DataFrame:
    """Facilities, cases and doses by selection and intervention group, with
    shares of the whole. ``cases`` and ``doses`` are (orgUnit, value) rows."""
    per = lambda d, n: d.groupBy("orgUnit").agg(stats.sum0(F.col("value")).alias(n))
    marks = selected_units.select("orgUnit").distinct().withColumn("_s", F.lit(True))
    table = (
        facilities.join(reporting_units.select("orgUnit").distinct(), "orgUnit", "left_semi")
        .join(marks, "orgUnit", "left")
        .withColumn("selected", is_set("_s"))
        .join(per(cases, "cases"), "orgUnit", "left")
        .join(per(doses, "doses"), "orgUnit", "left")
        .groupBy("selected", "Intervention")
        .agg(
            F.countDistinct("orgUnit").alias("Facilities"),
            stats.sum0(F.col("cases")).alias("cases"),
            stats.sum0(F.col("doses")).alias("doses"),
        )
    )
    whole = W.partitionBy(F.lit(1))  # one row per group at this point
    return table.withColumns(
        {
            "cases_share": F.try_divide(F.col("cases"), F.sum("cases").over(whole)),
            "doses_share": F.try_divide(F.col("doses"), F.sum("doses").over(whole)),
        }
    )

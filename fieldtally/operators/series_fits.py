"""Forecasting models of many series as sums and folds over each series.

Nothing leaves the JVM. The months of a series, and the months ahead, are rows; regression,
autoregression and the seasonal naive are windows over one shuffle by series. Smoothing folds
over the series' months as an array, which is at most as long as the calendar, once for each
combination of weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.regression import regressed, spread_after, with_lag_product

YEAR = 12
WEIGHTS = [(a, b, g) for a in (0.1, 0.3, 0.6) for b in (0.0, 0.1) for g in (0.05, 0.3)]
FEW, SHORT_NAIVE, SHORT_SMOOTH, ODD = "too few values", "less than 13 months", "less than 24 months", "not finite"


def month_number(month: Column) -> Column:
    return F.year(month) * 12 + F.month(month)


def scaled(value: Column, transform: str | None) -> Column:
    """The value on the model's scale; NULL where it has none."""
    if transform == "log1p":
        return F.when(value > -1, F.log1p(value))
    if transform == "sqrt":
        return F.when(value >= 0, 2 * (F.sqrt(value) - 1))
    return F.when(~F.isnan(value), value)


def laid_out(df: DataFrame, keys: list[str], cut, horizon: int, transform: str | None, covariate: str | None) -> DataFrame:
    """One row per series and month, from the data and for all months ahead: t (months from the cut), y
    (scaled, NULL from the cut on and in gaps), x (NULL becomes the mean of its month of the year, else of
    the series, else 0), season."""
    start = F.lit(str(cut)).cast("date")
    x = F.col(covariate).cast("double") if covariate else F.lit(0.0)
    rows = df.select(*keys, (month_number(F.col("Month")) - month_number(start)).alias("t"), F.col("total").cast("double").alias("y"), x.alias("x"))
    ahead = rows.select(*keys).distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    ahead = ahead.withColumns({"y": F.lit(None).cast("double"), "x": F.lit(None).cast("double")})
    rows = rows.unionByName(ahead).groupBy(*keys, "t").agg(F.max("y").alias("y"), F.max("x").alias("x"))
    rows = rows.withColumns({"y": F.when(F.col("t") < 0, scaled(F.col("y"), transform)), "season": F.pmod(F.col("t") + month_number(start) - 1, F.lit(YEAR))})
    usual = [F.avg("x").over(W.partitionBy(*keys, "season")), F.avg("x").over(W.partitionBy(*keys))]
    rows = rows.withColumn("x", F.coalesce("x", *usual, F.lit(0.0)))
    reach = W.partitionBy(*keys)
    known = F.when(F.col("y").isNotNull(), F.col("t"))
    return rows.withColumns({"months": -F.min(known).over(reach), "values": F.count("y").over(reach)})


def _models_of_rows(rows: DataFrame, keys: list[str], covariate: bool) -> DataFrame:
    """Rows with ``fits``: model, mean, sd of trend and season, autoregression and seasonal naive."""
    rows = regressed(rows, keys, "y", ["t", "x"] if covariate else ["t"], ("season",))
    rows = with_lag_product(rows, keys, "t")
    plain = F.sqrt(F.col("_squares") / F.greatest(F.col("_n") - F.col("_rank"), F.lit(1)))
    carried = F.col("_last") * F.pow("_phi", "_since")
    whole, year = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("t").rangeBetween(-YEAR, -YEAR)
    rows = rows.withColumn("_change", F.col("y") - F.sum("y").over(year))
    same = W.partitionBy(*keys, "season")
    latest = F.max(F.when(F.col("y").isNotNull(), F.struct("t", "y"))).over(same)
    naive_sd = F.coalesce(F.stddev_pop("_change").over(whole), F.stddev_pop("y").over(whole))
    rows = rows.withColumns({"_latest": latest, "_naive_sd": naive_sd})
    fit = lambda m, mean, sd: F.struct(F.lit(m).alias("model"), mean.alias("mean"), sd.alias("sd"))
    return rows.withColumn(
        "fits",
        F.array(
            fit("a", F.col("_fit") + carried, F.col("_noise") * F.sqrt(spread_after(F.col("_phi"), F.col("_since")))),
            fit("s", F.col("_latest.y"), F.col("_naive_sd") * F.sqrt((F.col("t") - F.col("_latest.t")) / YEAR)),
            fit("t", F.col("_fit"), plain),
        ),
    )


def _mean(values: Column) -> Column:
    seen = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda s, v: s + v) / F.size(seen))


def _smoothed(y: Column, first: Column, second: Column) -> Column:
    """Additive Holt-Winters of the array ``y`` (NULL in gaps) by the weights with the least sum of
    squared one-month errors after the first year: level, trend, season (from the
    first month ahead), sd, alpha.

    The season is a queue of twelve whose head is the month at hand. A gap leaves
    level and season as expected."""
    started = F.transform(F.slice(y, 1, YEAR), lambda v: F.coalesce(v - first, F.lit(0.0)))
    zero = F.struct(
        first.alias("level"),
        ((second - first) / YEAR).alias("trend"),
        started.alias("season"),
        F.lit(0.0).alias("squares"),
        F.lit(0.0).alias("sum"),
        F.lit(0).alias("n"),
        F.lit(0).alias("i"),
    )

    def run(w: Column) -> Column:
        def step(s: Column, v: Column) -> Column:
            head = s["season"][0]
            expected = s["level"] + s["trend"]
            level = F.when(v.isNull(), expected).otherwise(w["alpha"] * (v - head) + (1 - w["alpha"]) * expected)
            trend = F.when(v.isNull(), s["trend"]).otherwise(w["beta"] * (level - s["level"]) + (1 - w["beta"]) * s["trend"])
            tail = F.when(v.isNull(), head).otherwise(w["gamma"] * (v - level) + (1 - w["gamma"]) * head)
            error = F.when(s["i"] >= YEAR, v - expected - head)
            return F.struct(
                level.alias("level"),
                trend.alias("trend"),
                F.concat(F.slice(s["season"], 2, YEAR - 1), F.array(tail)).alias("season"),
                (s["squares"] + F.coalesce(error * error, F.lit(0.0))).alias("squares"),
                (s["sum"] + F.coalesce(error, F.lit(0.0))).alias("sum"),
                (s["n"] + error.isNotNull().cast("int")).alias("n"),
                (s["i"] + 1).alias("i"),
            )

        def done(s: Column) -> Column:
            mean = s["sum"] / s["n"]
            sd = F.sqrt(F.greatest(s["squares"] / s["n"] - mean * mean, F.lit(0.0)))
            return F.struct(s["squares"].alias("squares"), w["order"].alias("order"), s["level"].alias("level"), s["trend"].alias("trend"), s["season"].alias("season"), sd.alias("sd"), w["alpha"].alias("alpha"))

        return F.aggregate(y, zero, step, done)

    grid = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(g).alias("gamma")) for i, (a, b, g) in enumerate(WEIGHTS)])
    return F.array_min(F.transform(grid, run))


def _smoothing(rows: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """keys, t, months, values, model, mean, sd of smoothing, for the months ahead."""
    seen = F.when(F.col("y").isNotNull(), F.struct("t", "y"))
    series = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(seen)).alias("seen"), F.max("months").alias("months"), F.max("values").alias("values"))
    # Months from the first value to the cut, gaps kept: values and gaps are added in their order.
    filled = F.aggregate(
        "seen",
        F.array().cast("array<double>"),
        lambda y, v: F.concat(y, F.array_repeat(F.lit(None).cast("double"), v["t"] + F.col("months") - F.size(y)), F.array(v["y"])),
        lambda y: F.concat(y, F.array_repeat(F.lit(None).cast("double"), F.greatest(F.col("months"), F.lit(0)) - F.size(y))),
    )
    series = series.withColumn("y", F.when(F.col("months") >= 2 * YEAR, filled))
    series = series.withColumns({"first": _mean(F.slice("y", 1, YEAR)), "second": _mean(F.slice("y", YEAR + 1, YEAR))})
    usable = F.col("first").isNotNull() & F.col("second").isNotNull()
    series = series.withColumn("best", F.when(usable, _smoothed(F.col("y"), F.col("first"), F.col("second"))))
    best, k = F.col("best"), F.col("t")
    series = series.select(*keys, "months", "values", "best", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("t"))
    return series.select(
        *keys,
        "t",
        F.when(best.isNotNull(), F.col("months")).otherwise(0).alias("months"),
        "values",
        F.lit("e").alias("model"),
        (best["level"] + (k + 1) * best["trend"] + F.get(best["season"], F.pmod(k, F.lit(YEAR)))).alias("mean"),
        (best["sd"] * F.sqrt(1 + k * F.pow(best["alpha"], F.lit(2.0)))).alias("sd"),
    )


def fits(df: DataFrame, keys: list[str], cut, horizon: int, models: tuple[str, ...], transform: str | None, covariate: str | None) -> DataFrame:
    """keys, Month, model, mean, sd, status; models a (autoregression), e (smoothing), s (seasonal
    naive), t (trend and season). A model that fails has NULL in all its months."""
    rows = laid_out(df, keys, cut, horizon, transform, covariate)
    out = []
    if set(models) - {"e"}:
        told = _models_of_rows(rows, keys, covariate is not None).where(F.col("t").between(0, horizon - 1))
        told = told.select(*keys, "t", "months", "values", F.explode("fits").alias("fit")).select(*keys, "t", "months", "values", "fit.*")
        out.append(told.where(F.col("model").isin([m for m in models if m != "e"])))
    if "e" in models:
        out.append(_smoothing(rows, keys, horizon))
    both = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    every = F.min((finite("mean") & finite("sd")).cast("int")).over(W.partitionBy(*keys, "model")) == 1
    status = (
        F.when(F.col("values") < 3, FEW)
        .when((F.col("model") == "s") & (F.col("months") < YEAR + 1), SHORT_NAIVE)
        .when((F.col("model") == "e") & (F.col("months") < 2 * YEAR), SHORT_SMOOTH)
        .when(~every, ODD)
        .otherwise("ok")
    )
    both = both.withColumn("status", status)
    ok = F.col("status") == "ok"
    month = F.add_months(F.lit(str(cut)).cast("date"), F.col("t"))
    return both.select(*keys, month.alias("Month"), "model", F.when(ok, F.col("mean")).alias("mean"), F.when(ok, F.col("sd")).alias("sd"), "status")

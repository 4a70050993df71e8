"""Least squares of many series at once, as sums over each series.

A regressor is freed of those before it, the outcome is freed of the regressor, and
so on: each step needs sums of products per series only, so all steps are windows
over one shuffle by series. Rows without an outcome take no part in the sums and get fitted
values as well, which is how months ahead are forecast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A regressor with less than this share of its own squares left is one of those before it.
TINY = 1e-9
PHI_REACH = 0.95


def regressed(rows: DataFrame, keys: list[str], y: str, xs: list[str], within: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``_fit``, ``_rest`` (NULL where ``y`` is), ``_n``, ``_rank`` and ``_squares``.

    ``within`` names columns of which every combination has a mean of its own (months of the
    year); a combination without outcomes takes the series' mean. Regressors that others
    make superfluous get no weight. ``xs`` have no NULL in rows that have ``y``.
    """
    known, all_of, part = F.col(y).isNotNull(), W.partitionBy(*keys), W.partitionBy(*keys, *within)
    here = lambda c: F.when(known, c)
    centre = {c: F.coalesce(F.avg(here(F.col(c))).over(part), F.avg(here(F.col(c))).over(all_of)) for c in (y, *xs)}
    rows = rows.withColumns({f"_u{j}": F.col(x) - centre[x] for j, x in enumerate(xs)} | {"_fit": centre[y]})
    rows = rows.withColumn("_rest", F.col(y) - F.col("_fit"))
    first = here(F.struct(*within)) if within else here(F.lit(1))
    levels = F.size(F.collect_set(first).over(all_of))
    own = {f"_q{j}": F.sum(here(F.pow(F.col(f"_u{j}"), 2))).over(all_of) for j in range(len(xs))}
    rows = rows.withColumns({"_n": F.count(here(F.lit(1))).over(all_of), "_rank": levels, **own})
    for j in range(len(xs)):
        u = F.col(f"_u{j}")
        sums = {"_s": F.sum(here(u * u)).over(all_of), "_b": F.sum(u * F.col("_rest")).over(all_of)}
        later = range(j + 1, len(xs))
        sums |= {f"_c{k}": F.sum(here(u * F.col(f"_u{k}"))).over(all_of) for k in later}
        rows = rows.withColumns(sums)
        live = F.coalesce(F.col("_s") > TINY * F.col(f"_q{j}"), F.lit(False))
        weight = lambda c: F.when(live, F.col(c) / F.col("_s")).otherwise(0.0)
        rows = rows.withColumns(
            {"_fit": F.col("_fit") + weight("_b") * u, "_rest": F.col("_rest") - weight("_b") * u, "_rank": F.col("_rank") + live.cast("int")}
            | {f"_u{k}": F.col(f"_u{k}") - weight(f"_c{k}") * u for k in later}
        )
    rows = rows.withColumn("_squares", F.sum(F.pow("_rest", F.lit(2.0))).over(all_of))
    return rows.drop("_s", "_b", *[f"_{a}{j}" for a in "ucq" for j in range(len(xs))])


def with_lag_product(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Adds ``_phi`` and ``_noise`` of a first-order autoregression of ``_rest``, from
    neighbouring periods (``at`` counts them) that both have one, and ``_last``, ``_since``: the
    latest ``_rest`` before the row and how many periods ago it was."""
    order = W.partitionBy(*keys).orderBy(at)
    near = F.lag(at).over(order) == F.col(at) - 1
    rows = rows.withColumn("_before", F.when(near & F.col("_rest").isNotNull(), F.lag("_rest").over(order)))
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    seen = F.when(F.col("_rest").isNotNull(), F.col(at))
    rows = rows.withColumns({"_last": F.last("_rest", True).over(earlier), "_since": F.col(at) - F.max(seen).over(earlier)})
    all_of, b = W.partitionBy(*keys), F.col("_before")
    a = F.when(b.isNotNull(), F.col("_rest"))
    sums = {"_m": F.count(b), "_sa": F.sum(a), "_sb": F.sum(b), "_aa": F.sum(a * a), "_ab": F.sum(a * b), "_bb": F.sum(b * b)}
    rows = rows.withColumns({n: c.over(all_of) for n, c in sums.items()})
    phi = F.when(F.col("_bb") > 0, F.greatest(F.least(F.col("_ab") / F.col("_bb"), F.lit(PHI_REACH)), F.lit(-PHI_REACH))).otherwise(0.0)
    rows = rows.withColumn("_phi", phi)
    p, m = F.col("_phi"), F.col("_m")
    mean = (F.col("_sa") - p * F.col("_sb")) / m
    square = (F.col("_aa") - 2 * p * F.col("_ab") + p * p * F.col("_bb")) / m
    noise = F.when(m > 0, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))).otherwise(F.sqrt(F.col("_squares") / F.col("_n")))
    return rows.withColumn("_noise", noise).drop("_before", *sums)


def spread_after(phi: Column, steps: Column) -> Column:
    """Variance of a first-order autoregression after ``steps`` periods, in units of its noise's."""
    return (1 - F.pow(phi, 2 * steps)) / (1 - phi * phi)

"""Derived datasets: include and ratio steps, ratio rules, merged sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.flags import MISSING_FLAGS, SOURCE_FLAGS, present
from ..functions.periods import period_column
from .outliers import clean_to_level, rescan


@dataclass
class Side:
    """One side of a ratio, or the source of an include step."""

    source: DataFrame
    values: list[str]
    cleaning_level: str = "none"


@dataclass
class Step:
    """``include`` uses ``side``; ``ratio`` uses numerator and denominator."""

    operation: str
    output_name: str | None = None
    side: Side | None = None
    numerator: Side | None = None
    denominator: Side | None = None
    na_rm: bool = True
    max_value: float | None = None


def _cleaned(side: Side) -> tuple[DataFrame, list[str], str]:
    d = side.source.filter(F.col("data").isin(side.values))
    d = clean_to_level(d, side.cleaning_level, "_val")
    return d, present(d, SOURCE_FLAGS), period_column(d)


def include_step(step: Step) -> DataFrame:
    """Chosen series with cleaned values and their flags; a single series
    takes the step's name."""
    d, flags, period = _cleaned(step.side)
    name = F.lit(step.output_name) if step.output_name and len(step.side.values) == 1 else F.col("data")
    return d.select("orgUnit", period, name.alias("data"), F.col("_val").alias("original"), *flags)


def ratio_step(step: Step) -> DataFrame:
    """Numerator over denominator per facility and period.

    Each side is summed; without ``na_rm`` one NULL makes the sum NULL. The
    ratio is NULL when a side is missing or the denominator is 0, and never
    below 0.
    """

    num, den = step.numerator, step.denominator
    num_flags, den_flags = present(num.source, SOURCE_FLAGS), present(den.source, SOURCE_FLAGS)
    period = period_column(num.source)

    def aggregates(side: Side, name: str, mine: Column, value: str) -> list[Column]:
        v = F.when(mine, F.col(value))
        rows = F.count_if(mine)
        total = F.when(rows > 0, stats.sum0(v)) if step.na_rm else F.when((rows > 0) & (F.count(v) == rows), F.sum(v))
        flags = present(side.source, SOURCE_FLAGS)
        return [total.alias(name), *[F.coalesce(F.bool_or(mine & F.col(f)), F.lit(False)).alias(f"{f}_{name}") for f in flags]]

    def rows_of(side: Side, value: str) -> DataFrame:
        return clean_to_level(side.source.filter(F.col("data").isin(side.values)), side.cleaning_level, value)

    if num.source is den.source:
        # One table: both sides come out of a single grouping.
        d = num.source.filter(F.col("data").isin([*num.values, *den.values]))
        d = clean_to_level(clean_to_level(d, num.cleaning_level, "_vn"), den.cleaning_level, "_vd")
        both = d.groupBy("orgUnit", period).agg(
            *aggregates(num, "numerator", F.col("data").isin(num.values), "_vn"),
            *aggregates(den, "denominator", F.col("data").isin(den.values), "_vd"),
        )
    else:
        everything = F.lit(True)
        n = rows_of(num, "_v").groupBy("orgUnit", period).agg(*aggregates(num, "numerator", everything, "_v"))
        d = rows_of(den, "_v").groupBy("orgUnit", period).agg(*aggregates(den, "denominator", everything, "_v"))
        both = n.join(d, ["orgUnit", period], "full_outer")

    def either(f: str) -> Column:
        sides = [s for s, have in (("numerator", num_flags), ("denominator", den_flags)) if f in have]
        # A side that is absent for the row leaves an unset flag undecided,
        # which counts as not flagged.
        out = F.lit(False)
        for s in sides:
            out = out | F.col(f"{f}_{s}")
        return F.coalesce(out, F.lit(False)).alias(f)

    n, d = F.col("numerator"), F.col("denominator")
    ratio = F.when(n.isNull() | d.isNull() | (d == 0), None).otherwise(F.greatest(F.try_divide(n, d), F.lit(0.0)))
    flags = [f for f in SOURCE_FLAGS if f in num_flags or f in den_flags]
    return both.select(
        "orgUnit",
        period,
        F.lit(step.output_name).alias("data"),
        "numerator",
        "denominator",
        n.isNull().alias("missing_numerator"),
        d.isNull().alias("missing_denominator"),
        ratio.alias("original"),
        *[either(f) for f in flags],
    )


def build_combined(
    steps: list[Step], tree: DataFrame | None = None, formula_name: str = "Combined", scan: bool = True
) -> DataFrame:
    """Run the steps, stack them, apply step maxima, rescan in stages and
    attach the hierarchy."""
    if not steps:
        raise ValueError("no steps given")
    parts = [ratio_step(s) if s.operation.lower() == "ratio" else include_step(s) for s in steps]
    period = period_column(parts[0])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    for f in [*SOURCE_FLAGS, *MISSING_FLAGS]:
        have = F.coalesce(F.col(f), F.lit(False)) if f in out.columns else F.lit(False)
        out = out.withColumn(f, have)
    over = F.col("over_max")
    for s in steps:
        if s.max_value is not None and s.output_name:
            over = over | ((F.col("data") == s.output_name) & F.coalesce(F.col("original") > s.max_value, F.lit(False)))
    out = out.withColumns(
        {
            "over_max": over,
            "data_id": F.col("data"),
            "value": F.col("original").isNotNull(),
            "dataCol": F.col("original"),
            "effectiveLeaf": F.lit(True),
            "Formula_Name": F.lit(formula_name),
            "key_entry_error": F.lit(False),
        }
    )
    if scan:
        out = rescan(out, ["orgUnit", "data"], period)
    return out if tree is None else out.join(tree, "orgUnit", "left")


# -- paired sums -----------------------------------------------------------------


def pair_rule(df: DataFrame) -> DataFrame:
    """Make numerator and denominator fit to be summed.

    Without a positive denominator both are NULL; a numerator above its
    denominator voids both; a missing numerator with a valid denominator is 0.
    """
    n, d = F.col("numerator"), F.col("denominator")
    valid = d.isNotNull() & (d != 0) & ~F.coalesce(n > d, F.lit(False))
    return df.withColumns(
        {
            "numerator": F.when(valid, F.coalesce(n, F.lit(0.0))),
            "denominator": F.when(valid, d),
        }
    )


def paired_totals(df: DataFrame, group_cols: list[str]) -> DataFrame:
    """Apply the pair rule, sum both sides and divide the sums."""
    return (
        pair_rule(df)
        .groupBy(*group_cols)
        .agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
        .withColumn("ratio", F.try_divide("numerator", "denominator"))
    )


def validity_counts(df: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Rows per validity class of numerator and denominator."""
    n, d = F.col("numerator"), F.col("denominator")
    out = [
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(n.isNull() & (d > 0)).alias("missing_num_valid_den"),
        F.count_if((d > 0) & (n <= d)).alias("both_valid"),
        F.count_if(n.isNotNull() & (d.isNull() | (d == 0))).alias("orphaned_numerator"),
        F.count_if(n > d).alias("impossible_ratio"),
        F.count_if(n.isNull() & d.isNull()).alias("both_missing"),
    ]
    return df.groupBy(*(group_cols or [])).agg(*out)


def ratio_methods(df: DataFrame) -> DataFrame:
    """National ratio per period by three rules, long: zero for missing
    numerators, only complete pairs, and sums that ignore pairing."""
    period = period_column(df)
    n, d = F.col("numerator"), F.col("denominator")
    usable = (d > 0) & (n.isNull() | (n <= d))
    paired = (d > 0) & (n <= d)
    wide = df.groupBy(period).agg(
        F.try_divide(
            F.sum(F.when(n.isNull() & (d > 0), F.lit(0.0)).otherwise(n)), F.sum(F.when(usable, d))
        ).alias("zero_imputed"),
        F.try_divide(F.sum(F.when(paired, n)), F.sum(F.when(paired, d))).alias("paired"),
        F.try_divide(F.sum(n), F.sum(d)).alias("naive"),
        F.count_if(usable).alias("n_used"),
    )
    return wide.unpivot([period, "n_used"], ["zero_imputed", "paired", "naive"], "method", "ratio")


def prefer_source(df: DataFrame, target: str, preferred: list[str]) -> DataFrame:
    """Values of a series, replaced by the sum of preferred series where any
    of those was reported."""
    period = period_column(df)
    lab = (
        df.filter(F.col("data").isin(preferred) & F.col("original").isNotNull())
        .groupBy("orgUnit", period)
        .agg(F.sum("original").alias("_lab"))
    )
    return (
        df.filter(F.col("data") == target)
        .join(lab, ["orgUnit", period], "left")
        .withColumn("original", F.coalesce("_lab", "original"))
        .drop("_lab")
    )


def double_count_table(df: DataFrame, sources: dict[str, list[str]]) -> DataFrame:
    """One column per named source with its sum per facility and period."""
    period = period_column(df)
    pairs = [F.struct(F.lit(v).alias("v"), F.lit(n).alias("n")) for n, vs in sources.items() for v in vs]
    kinds = F.transform(
        F.filter(F.array(*pairs), lambda p: p["v"] == F.col("data")), lambda p: p["n"]
    )
    return (
        df.filter(F.col("original").isNotNull())
        .withColumn("kind", F.explode(kinds))
        .groupBy("orgUnit", period)
        .pivot("kind", list(sources))
        .agg(F.sum("original"))
    )


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Distinct values with their average rank over all rows.

    Values are counted first and ranked piecewise, so no task sorts all rows.
    """
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    r = stats.running_totals(counts, [], "_v", F.col("_c"), [])
    return r.select(F.col("_v").alias(value), (F.col("_end") - (F.col("_c") - 1) / 2).alias(name))


def double_count_check(table: DataFrame, whole: str, parts: list[str]) -> DataFrame:
    """Agreement of a series with the sum of its parts: rows, share within one
    unit, and Spearman rank correlation."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    rows = table.withColumn("_sum", total).filter(F.col(whole).isNotNull() & F.col("_sum").isNotNull())
    ranked = rows.join(average_ranks(rows, whole, "_ra"), whole).join(average_ranks(rows, "_sum", "_rb"), "_sum")
    return ranked.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.abs(F.col(whole) - F.col("_sum")) <= 1).cast("double")).alias("share_within_one"),
        F.corr("_ra", "_rb").alias("spearman"),
    )

"""Totals, hierarchy, trend and series-statistics queries."""

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import outliers as ol
from ..operators import totals as tt
from . import fixtures as fx
from .fixtures import SQL
from .q_derived import pairs
from .q_outliers import flagged
from .q_reporting import champs, selected
from .registry import query

# Facts with a data set, a split column and a covariate, for the totals.
SQL["sel2"] = """
SELECT *, dataElement AS dataSet, substr(data, length(data), 1) AS agegrp, CAST(month(Month) AS DOUBLE) * length(District) AS avg_mm FROM selected
"""


def sel2(spark, sf):
    return (
        selected(spark, sf)
        .withColumn("dataSet", F.col("dataElement"))
        .withColumn("agegrp", F.substring("data", -1, 1))
        .withColumn("avg_mm", F.month("Month").cast("double") * F.length("District"))
    )


@query(
    "total_by_region",
    """SELECT Month, Region, Selected, dataSet, coalesce(sum(dataCol), 0) AS dataCol, avg(avg_mm) AS avg_mm, coalesce(sum(dataCol), 0) AS total
       FROM sel2 WHERE Month BETWEEN DATE '1997-01-01' AND DATE '2000-12-01' GROUP BY ALL""",
    dates="Month",
    nums="dataCol avg_mm total",
)
def total_by_region(spark, sf):
    return tt.total_by(
        sel2(spark, sf), ["Month", "Region", "Selected", "dataSet"], "1997-01-01", "2000-12-01", ["avg_mm"]
    )


SQL["ratio_total"] = """
SELECT Region, Month, 0.0 AS dataCol0, sum(numerator) AS numerator, sum(denominator) AS denominator FROM pairs_ruled GROUP BY ALL
"""


@query(
    "total_by_ratio",
    """SELECT Region, Month, numerator, denominator, CASE WHEN denominator > 0 THEN numerator / denominator ELSE s END AS dataCol,
       coalesce(CASE WHEN denominator > 0 THEN numerator / denominator ELSE s END, 0) AS total
       FROM ratio_total JOIN (SELECT Region, Month, coalesce(sum(numerator / denominator), 0) AS s FROM pairs GROUP BY ALL) USING (Region, Month)""",
    dates="Month",
    nums="numerator denominator dataCol total",
)
def total_by_ratio(spark, sf):
    d = pairs(spark, sf).withColumn("dataCol", F.try_divide("numerator", "denominator"))
    return tt.total_by(d, ["Region", "Month"])


@query(
    "total_merged_datasets",
    """SELECT Month, CASE WHEN dataSet IN ('Cases A', 'Cases R') THEN 'Combined' ELSE dataSet END AS dataSet, coalesce(sum(dataCol), 0) AS dataCol,
       coalesce(sum(dataCol), 0) AS total FROM sel2 GROUP BY ALL""",
    dates="Month",
    nums="dataCol total",
)
def total_merged_datasets(spark, sf):
    return tt.total_by(sel2(spark, sf), ["Month", "dataSet"], merge_datasets=["Cases A", "Cases R"])


@query(
    "total_mean_of_datasets",
    """SELECT Month, Region, avg(v) AS dataCol, 'Merged' AS dataSet, avg(v) AS total FROM (
       SELECT Month, Region, dataSet, coalesce(sum(dataCol), 0) AS v FROM sel2 GROUP BY ALL) GROUP BY Month, Region""",
    dates="Month",
    nums="dataCol total",
)
def total_mean_of_datasets(spark, sf):
    return tt.total_by(sel2(spark, sf), ["Month", "Region", "dataSet"], mean_merge=True)


SPEC = tt.hierarchy_spec(fx.LEVELS, "District", num_facilities=2, split=["agegrp"])
_G = lambda c: f"CASE WHEN grouping({c}) = 1 THEN '<aggregated>' ELSE {c} END AS {c}"
_SETS = ", ".join(
    "(" + ", ".join(["Month", *[f'"{c}"' if c == "National" else c for c in s]]) + ")" for s in tt.hierarchy_sets(SPEC)
)
SQL["node_in"] = """
SELECT Month, agegrp, Selected, "National", Region, District, coalesce(sum(dataCol), 0) AS total, avg(avg_mm) AS avg_mm FROM sel2 GROUP BY ALL
"""
SQL["nodes"] = f"""
SELECT Month, {_G('agegrp')}, {_G('Selected')}, {_G('"National"')}, {_G('Region')}, {_G('District')}, sum(total) AS total, avg(avg_mm) AS avg_mm
FROM node_in GROUP BY GROUPING SETS ({_SETS})
"""


def nodes(spark, sf):
    t = tt.total_by(
        sel2(spark, sf), ["Month", "agegrp", "Selected", "National", "Region", "District"], covariates=["avg_mm"]
    )
    return tt.aggregate_hierarchy(t, SPEC, ["avg_mm"])


@query("hierarchy_nodes", "SELECT * FROM nodes", dates="Month", nums="total avg_mm")
def hierarchy_nodes(spark, sf):
    return nodes(spark, sf)


@query(
    "hierarchy_ratio_national",
    """SELECT Month, CASE WHEN d > 0 THEN n / d ELSE t END AS total, n AS numerator, d AS denominator FROM (
       SELECT Month, coalesce(sum(coalesce(dataCol, 0)), 0) AS t, coalesce(sum(CASE WHEN ok THEN coalesce(numerator, 0) END), 0) AS n, coalesce(sum(CASE WHEN ok THEN denominator END), 0) AS d
       FROM (SELECT *, numerator / denominator AS dataCol, denominator IS NOT NULL AND denominator <> 0 AND NOT coalesce(numerator > denominator, FALSE) AS ok FROM pairs) GROUP BY 1)""",
    dates="Month",
    nums="total numerator denominator",
)
def hierarchy_ratio_national(spark, sf):
    d = pairs(spark, sf).withColumn("total", F.coalesce(F.try_divide("numerator", "denominator"), F.lit(0.0)))
    return tt.national_node(tt.aggregate_hierarchy(d, "Region"), ["Region"])


@query(
    "national_by_split",
    """SELECT Month, agegrp, Selected, total, avg_mm FROM nodes WHERE "National" = '<aggregated>' AND Region = '<aggregated>' AND District = '<aggregated>'
       AND agegrp <> '<aggregated>'""",
    dates="Month",
    nums="total avg_mm",
)
def national_by_split(spark, sf):
    return tt.national_node(nodes(spark, sf), ["National", "Region", "District"], ["agegrp"])


@query(
    "grouped_totals",
    "SELECT Month, Region, sum(total) AS total, avg(avg_mm) AS avg_mm FROM node_in GROUP BY ALL",
    dates="Month",
    nums="total avg_mm",
)
def grouped_totals(spark, sf):
    t = tt.total_by(
        sel2(spark, sf), ["Month", "agegrp", "Selected", "National", "Region", "District"], covariates=["avg_mm"]
    )
    return tt.grouped_totals(t, ["Month", "Region"], ["avg_mm"])


SQL["trend_in"] = """
SELECT Month, Region, Selected, agegrp, sum(total) AS total, avg(avg_mm) AS avg_mm FROM node_in WHERE NOT (Region = 'ASIA' AND month(Month) = 7) GROUP BY ALL
"""
SQL["trend"] = """
WITH r AS (SELECT * FROM trend_in WHERE Selected = 'Champion' AND Month BETWEEN DATE '1997-01-01' AND DATE '2000-06-01'),
k AS (SELECT DISTINCT Region, Selected, agegrp FROM r), m AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1997-01-01', TIMESTAMP '2000-06-01', INTERVAL 1 MONTH)) AS DATE) AS Month),
c AS (SELECT Region, Month, median(avg_mm) AS avg_mm FROM trend_in GROUP BY ALL)
SELECT k.Region, k.Selected, k.agegrp, m.Month, r.total, c.avg_mm, k.agegrp AS grouping_var
FROM k CROSS JOIN m LEFT JOIN r ON r.Region = k.Region AND r.Selected = k.Selected AND r.agegrp = k.agegrp AND r.Month = m.Month
LEFT JOIN c ON c.Region = k.Region AND c.Month = m.Month
"""


@query(
    "trend_data",
    "SELECT * REPLACE ((total - avg(total) OVER (PARTITION BY grouping_var)) / stddev_samp(total) OVER (PARTITION BY grouping_var) + 1 AS total) FROM trend",
    dates="Month",
    nums="total avg_mm",
)
def trend_data(spark, sf):
    t = tt.total_by(
        sel2(spark, sf), ["Month", "agegrp", "Selected", "National", "Region", "District"], covariates=["avg_mm"]
    )
    g = tt.grouped_totals(t, ["Month", "Region", "Selected", "agegrp"], ["avg_mm"]).filter(
        ~((F.col("Region") == "ASIA") & (F.month("Month") == 7))
    )
    return tt.trend_data(
        g,
        ["Region", "Selected", "agegrp"],
        "1997-01-01",
        "2000-06-01",
        selected_only=True,
        covariates=["avg_mm"],
        split="agegrp",
        scale=True,
    )


@query(
    "model_table",
    """SELECT Month, Region, dataElement, coalesce(sum(CASE WHEN list_position(['All','key_entry_error','over_max','mad15','mad10','seasonal5','seasonal3','none'], error) > 5 THEN original END), 0) AS total
       FROM (SELECT *, CASE WHEN NOT key_entry_error AND NOT over_max AND NOT mad15 AND NOT mad10 AND NOT seasonal5 AND NOT seasonal3 THEN 'none'
          WHEN seasonal3 THEN 'seasonal3' WHEN seasonal5 THEN 'seasonal5' WHEN mad10 THEN 'mad10' WHEN mad15 THEN 'mad15'
          WHEN over_max THEN 'over_max' WHEN key_entry_error THEN 'key_entry_error' ELSE 'none' END AS error FROM flagged) GROUP BY ALL""",
    dates="Month",
    nums="total",
)
def model_table(spark, sf):
    return tt.model_table(flagged(spark, sf), ["Region", "dataElement"], "mad10")


@query(
    "model_table_hierarchy",
    f"""SELECT Month, {_G('"National"')}, {_G('Region')}, {_G('agegrp')}, sum(coalesce(original, 0)) AS total FROM
        (SELECT *, substr(data, length(data), 1) AS agegrp FROM fact)
        GROUP BY GROUPING SETS ((Month), (Month, "National"), (Month, "National", Region), (Month, agegrp), (Month, agegrp, "National"), (Month, agegrp, "National", Region))""",
    dates="Month",
    nums="total",
)
def model_table_hierarchy(spark, sf):
    f = fx.fact(spark, sf).withColumn("agegrp", F.substring("data", -1, 1))
    return tt.model_table(f, ["National", "Region", "agegrp"], hierarchy="agegrp * National / Region")


SQL["segments"] = """
WITH t AS (SELECT Month, sum(total) AS total FROM node_in WHERE Month BETWEEN DATE '1996-06-01' AND DATE '2001-06-01' GROUP BY 1)
SELECT Month, total, unnest(list_filter([ 'full', CASE WHEN Month < DATE '1999-01-01' THEN 'pre' END, CASE WHEN Month < DATE '1998-01-01' THEN 'train' END,
  CASE WHEN Month >= DATE '1998-01-01' AND Month < DATE '1999-01-01' THEN 'test' END, CASE WHEN Month >= DATE '1999-01-01' THEN 'post' END,
  CASE WHEN Month >= DATE '1999-01-01' AND Month < DATE '2000-01-01' THEN 'yr1' END, CASE WHEN Month >= DATE '2000-01-01' AND Month < DATE '2001-01-01' THEN 'yr2' END,
  CASE WHEN Month >= DATE '2001-01-01' AND Month < DATE '2002-01-01' THEN 'yr3' END ], lambda s: s IS NOT NULL)) AS segment FROM t
"""


@query("split_segments", "SELECT * FROM segments", dates="Month", nums="total")
def split_segments(spark, sf):
    t = tt.total_by(sel2(spark, sf), ["Month", "Region"])
    return tt.split_segments(t, "1996-06-01", "1999-01-01", "2001-06-01")


@query(
    "yearly_change",
    """
    WITH m AS (SELECT year(Month) AS y, month(Month) AS k, coalesce(sum(original), 0) AS v FROM fact GROUP BY ALL),
    l AS (SELECT max(y) AS ly FROM m), lm AS (SELECT k FROM m, l WHERE y = ly),
    t AS (SELECT y, sum(v) AS total, sum(CASE WHEN k IN (SELECT k FROM lm) THEN v END) AS sub FROM m GROUP BY 1),
    c AS (SELECT y, total, sub, (SELECT count(*) FROM lm) < 12 AS partial, lag(total) OVER (ORDER BY y) AS p, lag(sub) OVER (ORDER BY y) AS ps, y = (SELECT ly FROM l) AS is_last FROM t),
    r AS (SELECT y, total, CASE WHEN partial THEN sub END AS subset_total, round((total - CASE WHEN partial AND is_last THEN ps ELSE p END) / CASE WHEN partial AND is_last THEN ps ELSE p END * 100, 1) AS pct_change FROM c)
    SELECT y AS "year", total, subset_total, pct_change, CASE WHEN pct_change IS NULL THEN 'baseline' WHEN pct_change > 0 THEN 'positive' WHEN pct_change < 0 THEN 'negative' ELSE 'zero' END AS direction FROM r
    """,
    nums="total subset_total pct_change",
)
def yearly_change(spark, sf):
    return tt.yearly_change(fx.fact(spark, sf), "original")


@query(
    "seasonal_index",
    """SELECT dataElement, k AS "month", m AS mean_sum, avg(m) OVER (PARTITION BY dataElement) AS grand_mean,
       CASE WHEN avg(m) OVER (PARTITION BY dataElement) > 0 THEN m / avg(m) OVER (PARTITION BY dataElement) ELSE 1 END AS seasonal_index
       FROM (SELECT dataElement, month(Month) AS k, avg(original) AS m FROM fact GROUP BY ALL)""",
    nums="mean_sum grand_mean seasonal_index",
)
def seasonal_index(spark, sf):
    return tt.seasonal_index(fx.fact(spark, sf))


# -- statistics ------------------------------------------------------------------------

SQL["series_parts"] = """
SELECT orgUnit, data, Month, original AS raw, coalesce(expected, original, 0) AS "value", CASE WHEN mad10 THEN original END AS outlier,
       CASE WHEN original IS NULL THEN 10.0 END AS interpolate, round(coalesce(expected, original, 0) - original, 6) AS resid FROM flagged
"""


@query(
    "series_summary",
    """
    WITH a AS (SELECT *, abs(resid) / nullif("value", 0) AS ape FROM series_parts)
    SELECT data, orgUnit, year(Month) AS "year", count(raw) AS n, count(*) FILTER (raw IS NULL) AS n_miss, coalesce(sum(raw), 0) AS total_raw, coalesce(sum("value"), 0) AS total_value,
      coalesce(sum(outlier), 0) AS total_outlier, coalesce(sum(outlier), 0) / nullif(sum(raw), 0) AS percent_outlier, coalesce(sum(interpolate), 0) AS total_interp,
      coalesce(sum(interpolate), 0) / nullif(sum("value"), 0) AS percent_interpolate, 1 / avg(1 / CASE WHEN ape > 0.00001 THEN ape WHEN ape IS NOT NULL THEN 0.00001 END) AS harmonic_ape,
      exp(sum(CASE WHEN ape > 0 THEN ln(ape) END) / count(*)) AS geometric_ape, exp(stddev_samp(CASE WHEN ape > 0 THEN ln(ape) END)) AS geometric_sd_ape, avg(ape) AS mape
    FROM a GROUP BY ALL
    """,
    nums="total_raw total_value total_outlier percent_outlier total_interp percent_interpolate harmonic_ape geometric_ape geometric_sd_ape mape",
)
def series_summary(spark, sf):
    o, e = F.col("original"), F.col("expected")
    value = F.coalesce(e, o, F.lit(0.0))
    parts = flagged(spark, sf).select(
        "orgUnit",
        "data",
        "Month",
        o.alias("raw"),
        value.alias("value"),
        F.when(F.col("mad10"), o).alias("outlier"),
        F.when(o.isNull(), F.lit(10.0)).alias("interpolate"),
        F.round(value - o, 6).alias("resid"),
    )
    return tt.series_summary(parts, ["data", "orgUnit"])


@query(
    "weighted_statistics",
    """
    WITH r AS (SELECT l_suppkey AS k, l_extendedprice AS x, l_quantity AS w FROM lineitem),
    s AS (SELECT k, x, sum(w) OVER (PARTITION BY k ORDER BY x, w ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY k) AS t FROM r),
    m AS (SELECT k, CASE WHEN max(t) % 2 = 0 THEN (min(CASE WHEN c > t / 2 THEN x END) + coalesce(max(CASE WHEN c <= t / 2 THEN x END), min(CASE WHEN c > t / 2 THEN x END))) / 2
                         ELSE min(CASE WHEN c > t / 2 THEN x END) END AS wmed FROM s GROUP BY 1),
    b AS (SELECT k, count(*) AS n, sum(w) AS sw, avg(w) AS wb, sum(w * x) / sum(w) AS xb FROM r GROUP BY 1),
    v AS (SELECT r.k, max(n) / ((max(n) - 1) * max(sw) * max(sw)) * (sum((w * x - wb * xb) * (w * x - wb * xb)) - 2 * max(xb) * sum((w - wb) * (w * x - wb * xb)) + max(xb) * max(xb) * sum((w - wb) * (w - wb))) AS wvar
          FROM r JOIN b ON r.k = b.k GROUP BY 1)
    SELECT m.k AS supplier, wmed, round(wvar, 1) AS wvar FROM m JOIN v ON m.k = v.k
    """,
    nums="wmed wvar",
)
def weighted_statistics(spark, sf):
    r = fx.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("supplier"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("w")
    )
    med = stats.weighted_median(r, ["supplier"], "x", "w", "wmed")
    var = stats.weighted_mean_variance(r, ["supplier"], "x", "w", "wvar")
    return med.join(var.withColumn("wvar", F.round("wvar", 1)), "supplier")


@query(
    "positive_means",
    """SELECT Region, 1 / avg(CASE WHEN original IS NOT NULL THEN 1 / greatest(original, 0.00001) END) AS hm, sqrt(pow(avg(1 / original), -4) * var_samp(1 / original) / count(*)) AS hm_sd,
       exp(sum(ln(original)) / count(*)) AS gm, exp(stddev_samp(ln(original))) AS gsd FROM fact GROUP BY 1""",
    nums="hm hm_sd gm gsd",
)
def positive_means(spark, sf):
    x = F.col("original")
    return (
        fx.fact(spark, sf)
        .groupBy("Region")
        .agg(
            stats.harmonic_mean(x).alias("hm"),
            stats.harmonic_mean_sd(x).alias("hm_sd"),
            stats.geometric_mean(x).alias("gm"),
            stats.geometric_sd(x).alias("gsd"),
        )
    )


@query(
    "transforms",
    """SELECT orgUnit, data_id, Month, 2 * (sqrt(original) - 1) AS bc, original AS back, ln(1 + original) AS l1,
       (original - avg(original) OVER w) / stddev_samp(original) OVER w + 1 AS z FROM fact WINDOW w AS (PARTITION BY orgUnit, data_id)""",
    dates="Month",
    nums="bc back l1 z",
)
def transforms(spark, sf):
    x = F.col("original")
    bc = stats.box_cox_half(x)
    return fx.fact(spark, sf).select(
        "orgUnit",
        "data_id",
        "Month",
        bc.alias("bc"),
        stats.inv_box_cox_half(bc).alias("back"),
        F.log1p(x).alias("l1"),
        stats.scaled(x, ["orgUnit", "data_id"]).alias("z"),
    )


@query(
    "beyond_mean_sd",
    """SELECT orgUnit, data_id, Month, coalesce(abs(original - avg(original) OVER w) / nullif(stddev_samp(original) OVER w, 0) >= 3, FALSE) AS outlier
       FROM fact WINDOW w AS (PARTITION BY orgUnit, data_id)""",
    dates="Month",
    bools="outlier",
)
def beyond_mean_sd(spark, sf):
    return tt.beyond_mean_sd(fx.fact(spark, sf), ol.SERIES).select("orgUnit", "data_id", "Month", "outlier")


@query(
    "became_null",
    """WITH c AS (SELECT orgUnit, Month, data, original, CASE WHEN original <= 400 THEN original END AS cleaned FROM fact WHERE data IN ('Cases A_F', 'Cases N_O')),
       k AS (SELECT DISTINCT orgUnit, Month FROM c)
       SELECT k.orgUnit, k.Month, n.name, c.original, c.cleaned, c.cleaned IS NULL AND c.original IS NOT NULL AS is_outlier
       FROM k CROSS JOIN (VALUES ('Cases A_F'), ('Cases N_O')) n(name) LEFT JOIN c ON c.orgUnit = k.orgUnit AND c.Month = k.Month AND c.data = n.name""",
    dates="Month",
    bools="is_outlier",
    nums="original cleaned",
)
def became_null(spark, sf):
    cols = ["Cases A_F", "Cases N_O"]
    f = fx.fact(spark, sf).filter(F.col("data").isin(cols))
    before = f.groupBy("orgUnit", "Month").pivot("data", cols).agg(F.sum("original"))
    after = before.select("orgUnit", "Month", *[F.when(F.col(f"`{c}`") <= 400, F.col(f"`{c}`")).alias(c) for c in cols])
    return tt.became_null(before, after, ["orgUnit", "Month"], cols)


@query(
    "with_and_without_outliers",
    """SELECT data, coalesce(sum(original), 0) AS "value", 'Original Data' AS name FROM flagged GROUP BY 1
       UNION ALL SELECT data, coalesce(sum(original), 0), 'Removed Outliers' FROM flagged WHERE NOT coalesce(mad10, FALSE) GROUP BY 1""",
    nums='"value"',
)
def with_and_without_outliers(spark, sf):
    f = flagged(spark, sf)
    keys = ["orgUnit", "data_id", "Month"]
    return tt.with_and_without(f.withColumnRenamed("original", "value"), f.filter("mad10"), keys)


SQL["mase"] = """
WITH s AS (SELECT *, abs(original - lag(original) OVER (PARTITION BY orgUnit, data_id ORDER BY Month)) AS step FROM flagged),
g AS (SELECT orgUnit, data_id, data, count(*) AS r, coalesce(sum(abs(original - expected)), 0) AS err, coalesce(sum(step), 0) AS naive, count(expected) AS ne,
        count(original) AS n, coalesce(sum(expected), 0) AS expected, coalesce(sum(original), 0) AS actual FROM s GROUP BY ALL),
m AS (SELECT *, CASE WHEN ne > 0 THEN err * (r - 1) / nullif(r * naive, 0) END AS "MASE" FROM g)
SELECT m.orgUnit, data_id, data, n, expected, actual, "MASE", CASE WHEN "MASE" IS NULL THEN 'NA' WHEN "MASE" = 0 THEN '0' WHEN "MASE" <= 0.25 THEN '0_25' WHEN "MASE" <= 0.5 THEN '25_50'
  WHEN "MASE" <= 1 THEN '50_100' ELSE '100+' END AS catMASE, CASE WHEN c.orgUnit IS NULL THEN 'Non-Champion' ELSE 'Champion' END AS Selected
FROM m LEFT JOIN champs c ON m.orgUnit = c.orgUnit
"""


def mase(spark, sf):
    return tt.mase_by_series(flagged(spark, sf), champs(spark, sf))


@query("mase_by_series", "SELECT * FROM mase", nums='expected actual "MASE"')
def mase_by_series(spark, sf):
    return mase(spark, sf)


SQL["mase_units"] = """SELECT Selected, orgUnit, median("MASE") AS m FROM mase WHERE "MASE" <> 0 GROUP BY ALL"""


@query(
    "mase_summary",
    "SELECT Selected, avg(m) AS mean_mase, stddev_samp(m) AS sd_mase, count(*) AS facilities FROM mase_units GROUP BY 1",
    nums="mean_mase sd_mase",
)
def mase_summary(spark, sf):
    return tt.mase_summary(mase(spark, sf))


@query(
    "mase_around_cutpoint",
    "SELECT Selected, CASE WHEN m > 0.4 THEN 'High' ELSE 'Low' END AS model_error, avg(m) AS mean_mase, count(*) AS facilities FROM mase_units GROUP BY ALL",
    nums="mean_mase",
)
def mase_around_cutpoint(spark, sf):
    return tt.mase_around(mase(spark, sf))


@query(
    "group_characteristics",
    """
    WITH f AS (SELECT orgUnit, Region AS Intervention FROM tree), t AS (
    SELECT c.orgUnit IS NOT NULL AS selected, Intervention, count(DISTINCT f.orgUnit) AS "Facilities", coalesce(sum(cases), 0) AS cases, coalesce(sum(doses), 0) AS doses
    FROM f JOIN (SELECT DISTINCT orgUnit FROM fact) r ON f.orgUnit = r.orgUnit LEFT JOIN champs c ON f.orgUnit = c.orgUnit
    LEFT JOIN (SELECT orgUnit, coalesce(sum(original), 0) AS cases FROM fact WHERE dataElement = 'Cases A' GROUP BY 1) a ON a.orgUnit = f.orgUnit
    LEFT JOIN (SELECT orgUnit, coalesce(sum(original), 0) AS doses FROM fact WHERE dataElement = 'Cases N' AND year(Month) < 1999 GROUP BY 1) d ON d.orgUnit = f.orgUnit GROUP BY ALL)
    SELECT *, cases / sum(cases) OVER () AS cases_share, doses / sum(doses) OVER () AS doses_share FROM t
    """,
    bools="selected",
    nums="cases doses cases_share doses_share",
)
def group_characteristics(spark, sf):
    f = fx.fact(spark, sf)
    v = F.col("original").alias("value")
    return tt.group_characteristics(
        fx.tree(spark, sf).select("orgUnit", F.col("Region").alias("Intervention")),
        f.filter("dataElement = 'Cases A'").select("orgUnit", v),
        f.filter("dataElement = 'Cases N' AND year(Month) < 1999").select("orgUnit", v),
        champs(spark, sf),
        f,
    )

"""Derived datasets and validation-rule queries."""

from pyspark.sql import functions as F

from ..operators import consistency as cs
from ..operators import derived as dv
from . import fixtures as fx
from .fixtures import SQL
from .q_outliers import flagged, madded
from .registry import query

_SRC = ["over_max", "mad15", "mad10", "seasonal5", "seasonal3"]
_FLAGGED10 = "(coalesce(key_entry_error, FALSE) OR coalesce(over_max, FALSE) OR coalesce(mad15, FALSE) OR coalesce(mad10, FALSE))"


@query(
    "include_step",
    f"""SELECT orgUnit, Month, 'Confirmed' AS data, CASE WHEN {_FLAGGED10} THEN expected ELSE original END AS original, {', '.join(_SRC)}
        FROM flagged WHERE data = 'Cases A_F'""",
    dates="Month",
    bools=" ".join(_SRC),
    nums="original",
)
def include_step(spark, sf):
    return dv.include_step(dv.Step("include", "Confirmed", dv.Side(flagged(spark, sf), ["Cases A_F"], "mad10")))


def _side_sql(values: str, na_rm: bool, level10: bool) -> str:
    v = f"CASE WHEN {_FLAGGED10} THEN expected ELSE original END" if level10 else "original"
    total = f"coalesce(sum({v}), 0)" if na_rm else f"CASE WHEN count({v}) = count(*) THEN sum({v}) END"
    flags = ", ".join(f"coalesce(bool_or({f}), FALSE) AS {f}" for f in _SRC)
    return f"(SELECT orgUnit, Month, {total} AS v, {flags} FROM flagged WHERE data IN ({values}) GROUP BY ALL)"


def _ratio_sql(na_rm: bool) -> str:
    flags = ", ".join(f"coalesce(n.{f} OR d.{f}, FALSE) AS {f}" for f in _SRC)
    return f"""
    SELECT coalesce(n.orgUnit, d.orgUnit) AS orgUnit, coalesce(n.Month, d.Month) AS Month, 'TPR' AS data, n.v AS numerator, d.v AS denominator,
           n.v IS NULL AS missing_numerator, d.v IS NULL AS missing_denominator,
           CASE WHEN n.v IS NULL OR d.v IS NULL OR d.v = 0 THEN NULL ELSE greatest(n.v / d.v, 0) END AS original, {flags}
    FROM {_side_sql("'Cases R_F', 'Cases R_O'", na_rm, True)} n
    FULL OUTER JOIN {_side_sql("'Cases A_F', 'Cases A_O'", na_rm, False)} d ON n.orgUnit = d.orgUnit AND n.Month = d.Month
    """


SQL["ratio_loose"] = _ratio_sql(True)
SQL["ratio_strict"] = _ratio_sql(False)
_RB = "missing_numerator missing_denominator " + " ".join(_SRC)


def ratio(f, na_rm):
    return dv.Step(
        "ratio",
        "TPR",
        numerator=dv.Side(f, ["Cases R_F", "Cases R_O"], "mad10"),
        denominator=dv.Side(f, ["Cases A_F", "Cases A_O"], "none"),
        na_rm=na_rm,
        max_value=1.0,
    )


@query("ratio_step", "SELECT * FROM ratio_loose", dates="Month", bools=_RB, nums="numerator denominator original")
def ratio_step(spark, sf):
    return dv.ratio_step(ratio(flagged(spark, sf), True))


@query("ratio_step_strict", "SELECT * FROM ratio_strict", dates="Month", bools=_RB, nums="numerator denominator original")
def ratio_step_strict(spark, sf):
    return dv.ratio_step(ratio(flagged(spark, sf), False))


@query(
    "combined_dataset",
    f"""
    WITH c AS (SELECT orgUnit, Month, data, numerator, original, missing_numerator, over_max OR coalesce(original > 1, FALSE) AS over_max FROM ratio_loose
      UNION ALL SELECT orgUnit, Month, 'Confirmed', NULL, original, FALSE, coalesce(over_max, FALSE) OR coalesce(original > 500, FALSE) FROM flagged WHERE data = 'Cases N_O')
    SELECT c.*, t.Region FROM c LEFT JOIN tree t ON c.orgUnit = t.orgUnit
    """,
    dates="Month",
    bools="missing_numerator over_max",
    nums="numerator original",
)
def combined_dataset(spark, sf):
    f = flagged(spark, sf)
    steps = [ratio(f, True), dv.Step("include", "Confirmed", dv.Side(f, ["Cases N_O"], "none"), max_value=500.0)]
    out = dv.build_combined(steps, fx.tree(spark, sf), scan=False)
    return out.select("orgUnit", "Month", "data", "numerator", "original", "missing_numerator", "over_max", "Region")


@query("combined_dataset_scanned")
def combined_dataset_scanned(spark, sf):
    """The same with the staged rescan of the combined series."""
    f = madded(spark, sf)
    steps = [
        dv.Step(
            "ratio",
            "TPR",
            numerator=dv.Side(f, ["Cases R_F", "Cases R_O"]),
            denominator=dv.Side(f, ["Cases A_F", "Cases A_O"]),
            max_value=1.0,
        ),
        dv.Step("include", "Confirmed", dv.Side(f, ["Cases N_O"]), max_value=500.0),
    ]
    out = dv.build_combined(steps, fx.tree(spark, sf))
    return out.select("orgUnit", "Month", "data", "original", "over_max", "mad15", "mad10", "seasonal5", "seasonal3")


# Numerator and denominator side by side, with missing sides and impossible pairs.
SQL["pairs"] = """
SELECT orgUnit, Region, Month, sum(CASE WHEN data = 'Cases R_F' THEN original END) AS numerator,
       sum(CASE WHEN data = 'Cases A_F' THEN original END) AS denominator
FROM fact WHERE data IN ('Cases R_F', 'Cases A_F') GROUP BY ALL
"""
SQL["pairs_ruled"] = """
SELECT orgUnit, Region, Month, CASE WHEN ok THEN coalesce(numerator, 0) END AS numerator, CASE WHEN ok THEN denominator END AS denominator
FROM (SELECT *, denominator IS NOT NULL AND denominator <> 0 AND NOT coalesce(numerator > denominator, FALSE) AS ok FROM pairs)
"""


def pairs(spark, sf):
    v = lambda n: F.sum(F.when(F.col("data") == n, F.col("original")))
    return (
        fx.fact(spark, sf)
        .filter(F.col("data").isin("Cases R_F", "Cases A_F"))
        .groupBy("orgUnit", "Region", "Month")
        .agg(v("Cases R_F").alias("numerator"), v("Cases A_F").alias("denominator"))
    )


@query("pair_rule", "SELECT * FROM pairs_ruled", dates="Month", nums="numerator denominator")
def pair_rule(spark, sf):
    return dv.pair_rule(pairs(spark, sf))


@query(
    "paired_totals",
    """SELECT Region, Month, sum(numerator) AS numerator, sum(denominator) AS denominator, sum(numerator) / sum(denominator) AS ratio
       FROM pairs_ruled GROUP BY ALL""",
    dates="Month",
    nums="numerator denominator ratio",
)
def paired_totals(spark, sf):
    return dv.paired_totals(pairs(spark, sf), ["Region", "Month"])


@query(
    "validity_counts",
    """SELECT Region, count(*) AS total_rows, count(*) FILTER (numerator IS NULL AND denominator > 0) AS missing_num_valid_den,
       count(*) FILTER (denominator > 0 AND numerator <= denominator) AS both_valid,
       count(*) FILTER (numerator IS NOT NULL AND (denominator IS NULL OR denominator = 0)) AS orphaned_numerator,
       count(*) FILTER (numerator > denominator) AS impossible_ratio,
       count(*) FILTER (numerator IS NULL AND denominator IS NULL) AS both_missing FROM pairs GROUP BY 1""",
)
def validity_counts(spark, sf):
    return dv.validity_counts(pairs(spark, sf), ["Region"])


@query(
    "ratio_methods",
    """
    WITH w AS (SELECT Month, sum(CASE WHEN numerator IS NULL AND denominator > 0 THEN 0 ELSE numerator END)
        / sum(CASE WHEN denominator > 0 AND (numerator IS NULL OR numerator <= denominator) THEN denominator END) AS a,
      sum(CASE WHEN denominator > 0 AND numerator <= denominator THEN numerator END) / sum(CASE WHEN denominator > 0 AND numerator <= denominator THEN denominator END) AS b,
      sum(numerator) / sum(denominator) AS c, count(*) FILTER (denominator > 0 AND (numerator IS NULL OR numerator <= denominator)) AS n_used FROM pairs GROUP BY 1)
    SELECT Month, n_used, 'zero_imputed' AS method, a AS ratio FROM w UNION ALL SELECT Month, n_used, 'paired', b FROM w UNION ALL SELECT Month, n_used, 'naive', c FROM w
    """,
    dates="Month",
    nums="ratio",
)
def ratio_methods(spark, sf):
    return dv.ratio_methods(pairs(spark, sf))


@query(
    "prefer_source",
    """
    SELECT f.orgUnit, f.Month, coalesce(l.v, f.original) AS original FROM fact f
    LEFT JOIN (SELECT orgUnit, Month, sum(original) AS v FROM fact WHERE data IN ('Cases N_F', 'Cases N_O') AND original IS NOT NULL GROUP BY ALL) l
      ON f.orgUnit = l.orgUnit AND f.Month = l.Month WHERE f.data = 'Cases A_F'
    """,
    dates="Month",
    nums="original",
)
def prefer_source(spark, sf):
    out = dv.prefer_source(fx.fact(spark, sf), "Cases A_F", ["Cases N_F", "Cases N_O"])
    return out.select("orgUnit", "Month", "original")


SQL["sources_wide"] = """
SELECT orgUnit, Month, sum(CASE WHEN data LIKE 'Cases N%' THEN original END) AS confirmed, sum(CASE WHEN data = 'Cases A_F' THEN original END) AS rdt,
       sum(CASE WHEN data = 'Cases R_F' THEN original END) AS micro
FROM fact WHERE original IS NOT NULL AND data IN ('Cases N_F', 'Cases N_O', 'Cases A_F', 'Cases R_F') GROUP BY ALL
"""


def sources_wide(spark, sf):
    return dv.double_count_table(
        fx.fact(spark, sf),
        {"confirmed": ["Cases N_F", "Cases N_O"], "rdt": ["Cases A_F"], "micro": ["Cases R_F"]},
    )


@query("double_count_table", "SELECT * FROM sources_wide", dates="Month", nums="confirmed rdt micro")
def double_count_table(spark, sf):
    return sources_wide(spark, sf)


@query(
    "double_count_check",
    """
    WITH r AS (SELECT confirmed AS a, rdt + micro AS b FROM sources_wide WHERE confirmed IS NOT NULL AND rdt + micro IS NOT NULL),
    k AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra,
                 rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM r)
    SELECT count(*) AS n, avg(CAST(abs(a - b) <= 1 AS INTEGER)) AS share_within_one, corr(ra, rb) AS spearman FROM k
    """,
    nums="share_within_one spearman",
)
def double_count_check(spark, sf):
    return dv.double_count_check(sources_wide(spark, sf), "confirmed", ["rdt", "micro"])


# -- validation rules --------------------------------------------------------------

SQL["rule_vals"] = """
WITH p AS (SELECT orgUnit, orgUnitName, Month, split_part(data_id, '_', 1) AS uid, data_id AS ref, sum(original) AS v FROM fact
           WHERE effectiveLeaf AND original IS NOT NULL AND split_part(data_id, '_', 1) IN (SELECT dataElement_id FROM elements) GROUP BY ALL)
SELECT orgUnit, orgUnitName, Month, ref, v FROM p
UNION ALL SELECT orgUnit, orgUnitName, Month, uid, sum(v) FROM p GROUP BY ALL
"""
SQL["rule_terms"] = r"""
SELECT id, name, operator, replace(regexp_extract(left_raw, '#\{([^}]*)\}', 1), '.', '_') AS l,
       replace(regexp_extract(right_raw, '#\{([^}]*)\}', 1), '.', '_') AS r,
       CASE WHEN right_raw LIKE '%* 2 + 10' THEN 2.0 ELSE 1.0 END AS mul, CASE WHEN right_raw LIKE '%* 2 + 10' THEN 10.0 ELSE 0.0 END AS plus
FROM rules
"""
SQL["rule_eval"] = """
WITH s AS (
SELECT t.id, t.name, t.operator, t.l, t.r, u.orgUnit, u.orgUnitName, u.Month,
  CASE WHEN t.id LIKE 'rule_neg%' THEN a.v + 1 WHEN t.id LIKE 'rule_zero%' OR t.id LIKE 'rule_odd%' THEN NULL ELSE a.v END AS ls,
  CASE WHEN t.id LIKE 'rule_nest%' THEN b.v / nullif(a.v / nullif(b.v, 0), 0) ELSE b.v * mul + plus END AS rs
FROM rule_terms t CROSS JOIN (SELECT DISTINCT orgUnit, orgUnitName, Month FROM rule_vals) u
LEFT JOIN rule_vals a ON a.orgUnit = u.orgUnit AND a.Month = u.Month AND a.ref = t.l
LEFT JOIN rule_vals b ON b.orgUnit = u.orgUnit AND b.Month = u.Month AND b.ref = t.r)
SELECT id, name, orgUnit, orgUnitName, Month, ls, rs,
  CASE operator WHEN 'greater_than' THEN ls > rs WHEN 'less_than_or_equal_to' THEN ls <= rs
    WHEN 'equal_to' THEN ls = rs WHEN 'compulsory_pair' THEN (ls IS NULL) = (rs IS NULL) END AS pass,
  NOT (l IN (SELECT ref FROM rule_vals) AND r IN (SELECT ref FROM rule_vals)) OR id LIKE 'rule_odd%' AS incomplete
FROM s
"""
SQL["rule_counts"] = """
SELECT id AS rule_id, name AS rule_name, year(Month) AS "year", incomplete,
       count(CASE WHEN NOT incomplete THEN pass END) AS n_evaluated, count(*) FILTER (pass AND NOT incomplete) AS n_passed,
       count(*) FILTER (NOT pass AND NOT incomplete) AS n_failed
FROM rule_eval GROUP BY ALL
"""


def results(spark, sf):
    return cs.evaluate_rules(fx.fact(spark, sf), fx.rules(spark, sf))


@query("evaluate_rules", "SELECT * FROM rule_counts", bools="incomplete")
def evaluate_rules(spark, sf):
    return results(spark, sf)


@query(
    "evaluate_rules_of_series",
    """
    WITH w AS (SELECT DISTINCT orgUnit, Month FROM rule_vals WHERE starts_with(ref, 'deN') OR starts_with(ref, 'deR'))
    SELECT id AS rule_id, name AS rule_name, year(e.Month) AS "year", incomplete,
           count(CASE WHEN NOT incomplete THEN pass END) AS n_evaluated, count(*) FILTER (pass AND NOT incomplete) AS n_passed,
           count(*) FILTER (NOT pass AND NOT incomplete) AS n_failed
    FROM rule_eval e JOIN w ON e.orgUnit = w.orgUnit AND e.Month = w.Month
    WHERE id IN (SELECT id FROM rules WHERE left_raw LIKE '%deR00000001%' OR right_raw LIKE '%deR00000001%') GROUP BY ALL
    """,
    bools="incomplete",
)
def evaluate_rules_of_series(spark, sf):
    return cs.evaluate_rules(fx.fact(spark, sf), fx.rules(spark, sf), ["deR00000001_ccF00000001"])


@query(
    "rule_values",
    "SELECT * FROM rule_vals",
    dates="Month",
    nums="v",
)
def rule_values(spark, sf):
    return cs.rule_values(fx.fact(spark, sf), fx.rules(spark, sf))


@query(
    "compare_by_operator",
    """SELECT o, a > b AS gt, count(*) AS n, count(*) FILTER (CASE o WHEN 'EQUAL_TO' THEN a = b WHEN 'NOT_EQUAL' THEN a <> b WHEN 'LESS_THAN' THEN a < b
         WHEN 'GREATER_THAN' THEN a > b WHEN 'LESS_THAN_OR_EQUAL_TO' THEN a <= b WHEN 'GREATER_THAN_OR_EQUAL_TO' THEN a >= b
         WHEN 'COMPULSORY_PAIR' THEN (a IS NULL) = (b IS NULL) END) AS passed
       FROM (SELECT numerator AS a, denominator AS b FROM pairs) CROSS JOIN (VALUES ('EQUAL_TO'), ('NOT_EQUAL'), ('LESS_THAN'), ('GREATER_THAN'),
         ('LESS_THAN_OR_EQUAL_TO'), ('GREATER_THAN_OR_EQUAL_TO'), ('COMPULSORY_PAIR'), ('UNKNOWN')) v(o) GROUP BY ALL""",
    bools="gt",
)
def compare_by_operator(spark, sf):
    names = [*cs.COMPARISONS, cs.PAIR, "UNKNOWN"]
    a, b = F.col("numerator"), F.col("denominator")
    rows = pairs(spark, sf).withColumn("o", F.explode(F.array(*[F.lit(n) for n in names])))
    return rows.groupBy("o", (a > b).alias("gt")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(cs.holds_by_name(a, b, F.col("o"))).alias("passed")
    )


@query(
    "annual_pass_rate",
    """SELECT "year", CAST(sum(n_evaluated) AS BIGINT) AS n_evaluated, CAST(sum(n_passed) AS BIGINT) AS n_passed, sum(n_passed) / sum(n_evaluated) AS pct_passed
       FROM rule_counts WHERE NOT incomplete GROUP BY 1""",
    nums="pct_passed",
)
def annual_pass_rate(spark, sf):
    return cs.annual_pass_rate(results(spark, sf))


@query(
    "rule_table",
    """SELECT rule_id, rule_name, CASE WHEN bool_or(incomplete) THEN 'Incomplete (missing elements)' ELSE 'Evaluated' END AS status,
       CAST(sum(n_evaluated) AS BIGINT) AS facility_periods, CAST(sum(n_passed) AS BIGINT) AS passed, CAST(sum(n_failed) AS BIGINT) AS failed,
       round(CASE WHEN sum(n_evaluated) > 0 THEN 100 * sum(n_passed) / sum(n_evaluated) END, 1) AS pct_passed FROM rule_counts GROUP BY ALL""",
    nums="pct_passed",
)
def rule_table(spark, sf):
    return cs.rule_table(results(spark, sf))


@query(
    "rule_detail",
    """
    WITH w AS (SELECT DISTINCT orgUnit, orgUnitName, Month FROM rule_vals WHERE starts_with(ref, 'deA') OR starts_with(ref, 'deN')),
    b AS (SELECT w.orgUnitName, w.Month, year(w.Month) AS "year", ls AS left_side, rs AS right_side, CASE WHEN pass IS NULL THEN 'Incomplete' ELSE 'Failed' END AS result
          FROM rule_eval e JOIN w ON e.orgUnit = w.orgUnit AND e.Month = w.Month WHERE id = 'rule_gt_A' AND NOT coalesce(pass, FALSE))
    SELECT *, (SELECT count(*) FROM b) AS n_total FROM b
    """,
    dates="Month",
    nums="left_side right_side",
)
def rule_detail(spark, sf):
    return cs.rule_detail(fx.fact(spark, sf), fx.rules(spark, sf), "rule_gt_A")


@query(
    "incomplete_rules",
    """SELECT id, string_agg(ref, ', ' ORDER BY ref) AS missing FROM (SELECT id, l AS ref FROM rule_terms UNION SELECT id, r FROM rule_terms)
       WHERE ref NOT IN (SELECT ref FROM rule_vals) GROUP BY 1""",
)
def incomplete_rules(spark, sf):
    rules = fx.rules(spark, sf)
    return cs.incomplete_rules(rules, cs.rule_values(fx.fact(spark, sf), rules))


@query(
    "yearly_predictability",
    """
    WITH b AS (SELECT orgUnit, year(Month) AS y, original AS o, expected AS e FROM flagged WHERE original IS NOT NULL AND expected IS NOT NULL),
    y AS (SELECT DISTINCT year(Month) AS y FROM flagged)
    SELECT y.y AS "Year", (SELECT count(DISTINCT orgUnit) FROM b WHERE b.y <= y.y) AS Facilities,
           CASE WHEN (SELECT count(*) FROM y z WHERE z.y <= y.y) > 2 THEN (SELECT 2 * sum(abs(o - e)) / (sum(o) + sum(e)) FROM b WHERE b.y <= y.y) END AS swape
    FROM y
    """,
    nums="swape",
)
def yearly_predictability(spark, sf):
    return cs.yearly_predictability(flagged(spark, sf))

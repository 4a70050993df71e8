"""Outlier queries."""

from pyspark.sql import functions as F

from ..functions.flags import FLAG_ORDER, with_error_label
from ..operators import outliers as ol
from ..operators import conform as cf
from ..operators import reporting as rp
from ..operators import seasonal_models as sm
from . import fixtures as fx
from .fixtures import SQL
from .q_reporting import champs
from .registry import query

S = "PARTITION BY orgUnit, data_id"


def scale_sql(src: str, x: str) -> str:
    """Rows of ``src`` with centre ``ctr``, robust scale ``sc`` and largest value ``top`` of x."""
    return f"""(SELECT *, CASE WHEN md < 0.01 * ctr THEN 0.6745 * sd ELSE md END AS sc FROM (
      SELECT *, 1.4826 * median(abs({x} - ctr)) OVER ({S}) AS md,
             stddev_samp(CASE WHEN {x} > lo AND {x} < hi THEN {x} END) OVER ({S}) AS sd FROM (
        SELECT *, median({x}) OVER ({S}) AS ctr, quantile_cont({x}, 0.01) OVER ({S}) AS lo,
               quantile_cont({x}, 0.99) OVER ({S}) AS hi, max({x}) OVER ({S}) AS top FROM {src})))"""


def season_sql(src: str, x: str) -> str:
    """Rows of ``src`` with the seasonal expectation ``ex``, MAD ``m`` and largest value ``top``."""
    return f"""(SELECT *, CASE WHEN {x} IS NOT NULL THEN lvl * coalesce(idx, 1.0) END AS ex,
      1.4826 * median(abs({x} - ctr)) OVER ({S}) AS m FROM (
      SELECT *, median({x} / nullif(lvl, 0)) OVER ({S}, month(Month)) AS idx FROM (
        SELECT *, median({x}) OVER ({S} ORDER BY Month ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS lvl,
               median({x}) OVER ({S}) AS ctr, max({x}) OVER ({S}) AS top FROM {src})))"""


def off_sql(x: str, k: int) -> str:
    return f"CASE WHEN m > 0 THEN abs(ex - {x}) / m >= {k} WHEN abs(ex - {x}) > 0 THEN TRUE END"


SQL["key_values"] = """
WITH c AS (SELECT dataElement, original, count(*) AS n FROM fact
           WHERE effectiveLeaf AND length(CAST(CAST(original AS BIGINT) AS VARCHAR)) > 3 GROUP BY ALL),
t AS (SELECT dataElement, median(n) AS m FROM (
        SELECT *, row_number() OVER (PARTITION BY dataElement ORDER BY n DESC, original) AS r FROM c) WHERE r <= 10 GROUP BY 1)
SELECT c.dataElement, c.original FROM c JOIN t ON c.dataElement = t.dataElement WHERE c.n > 3 * t.m
"""
_BEYOND = "CASE WHEN top > 50 THEN scan_value > ctr + {k} * sc OR scan_value < ctr - {k} * sc END AS mad{k}"
SQL["scan_input"] = f"""
SELECT *, CASE WHEN NOT coalesce(over_max, FALSE) AND NOT coalesce(key_entry_error, FALSE) AND NOT AllSmall
               THEN original END AS scan_value FROM (
  SELECT f.*,
    CASE WHEN f.dataElement IN (SELECT dataElement FROM key_values) AND f.original IS NOT NULL
         THEN k.original IS NOT NULL END AS key_entry_error,
    CASE WHEN data ILIKE '%stock%' AND (data ILIKE '%out%' OR data ILIKE '%rupture%') AND f.original IS NOT NULL
         THEN f.original > 31 END AS over_max,
    coalesce(max(f.original) OVER (PARTITION BY f.orgUnit, f.data_id) <= 50, TRUE) AS AllSmall
  FROM fact f LEFT JOIN key_values k ON f.dataElement = k.dataElement AND f.original = k.original)
"""
SQL["madded"] = f"""
SELECT * EXCLUDE (ctr, lo, hi, top, md, sd, sc), {", ".join(_BEYOND.format(k=k) for k in (15, 10, 5))}
FROM {scale_sql("scan_input", "scan_value")}
"""
SQL["mad_masked"] = "SELECT *, CASE WHEN NOT mad10 THEN original END AS nm FROM madded"
SQL["flagged"] = f"""
SELECT * EXCLUDE (nm, lvl, ctr, top, idx, ex, m),
  CASE WHEN top > 50 THEN {off_sql("nm", 5)} END AS seasonal5,
  CASE WHEN top > 50 THEN {off_sql("nm", 3)} END AS seasonal3,
  CASE WHEN top > 50 THEN ex ELSE nm END AS expected
FROM {season_sql("mad_masked", "nm")}
"""


def madded(spark, sf):
    return ol.mad_flags(fx.stored_fact(spark, sf))


def flagged(spark, sf):
    return ol.seasonal_flags(madded(spark, sf))


def _any(flags):
    return "(" + " OR ".join(f"coalesce({f}, FALSE)" for f in flags) + ")"


_FIRST = "CASE " + " ".join(f"WHEN coalesce({f}, FALSE) THEN '{f}'" for f in FLAG_ORDER) + " END"


@query("key_entry_values", "SELECT * FROM key_values", nums="original")
def key_entry_values(spark, sf):
    return ol.key_entry_values(fx.fact(spark, sf))


@query(
    "over_maximum",
    "SELECT orgUnit, data_id, Month, original, over_max, AllSmall FROM madded",
    dates="Month",
    bools="over_max AllSmall",
    nums="original",
)
def over_maximum(spark, sf):
    return madded(spark, sf).select(
        "orgUnit", "data_id", "Month", "original", "over_max", "AllSmall"
    )


@query(
    "mad_flags",
    """SELECT orgUnit, data_id, Month, original, key_entry_error, over_max, AllSmall, scan_value, mad15, mad10, mad5 FROM madded""",
    dates="Month",
    bools="key_entry_error over_max AllSmall mad15 mad10 mad5",
    nums="original scan_value",
)
def mad_flags(spark, sf):
    return madded(spark, sf).select(
        "orgUnit", "data_id", "Month", "original", "key_entry_error", "over_max", "AllSmall", "scan_value", "mad15", "mad10", "mad5"
    )


@query(
    "extreme_values",
    f"""SELECT orgUnit, data_id, Month, CASE WHEN top > 100 THEN original > ctr + 8 * sc OR original < ctr - 8 * sc END AS extreme
        FROM {scale_sql('fact', 'original')}""",
    dates="Month",
    bools="extreme",
)
def extreme_values(spark, sf):
    out = ol.extreme_values(fx.fact(spark, sf), "original", ol.SERIES, 8.0, 100.0)
    return out.select("orgUnit", "data_id", "Month", "extreme")


@query(
    "seasonal_flags",
    "SELECT orgUnit, data_id, Month, seasonal5, seasonal3, expected FROM flagged",
    dates="Month",
    bools="seasonal5 seasonal3",
    nums="expected",
)
def seasonal_flags(spark, sf):
    return flagged(spark, sf).select("orgUnit", "data_id", "Month", "seasonal5", "seasonal3", "expected")


# Staged rescan: each stage sees what the earlier ones left.
SQL["rs0"] = "SELECT orgUnit, data_id, Month, original, coalesce(over_max, FALSE) AS over_max, CASE WHEN NOT coalesce(over_max, FALSE) THEN original END AS x FROM madded"
SQL["rs1"] = f"SELECT orgUnit, data_id, Month, original, over_max, coalesce(CASE WHEN top > 0 THEN x > ctr + 15.0 * sc OR x < ctr - 15.0 * sc END, FALSE) AS mad15 FROM {scale_sql('rs0', 'x')}"
SQL["rs1x"] = "SELECT *, CASE WHEN NOT over_max AND NOT mad15 THEN original END AS x FROM rs1"
SQL["rs2"] = f"SELECT orgUnit, data_id, Month, original, over_max, mad15, coalesce(CASE WHEN top > 0 THEN x > ctr + 10.0 * sc OR x < ctr - 10.0 * sc END, FALSE) AS mad10 FROM {scale_sql('rs1x', 'x')}"
SQL["rs2x"] = "SELECT *, CASE WHEN NOT over_max AND NOT mad15 AND NOT mad10 THEN original END AS x FROM rs2"
SQL["rs3"] = f"SELECT orgUnit, data_id, Month, original, over_max, mad15, mad10, coalesce(CASE WHEN top > 0 THEN {off_sql('x', 5)} END, FALSE) AS seasonal5 FROM {season_sql('rs2x', 'x')}"
SQL["rs3x"] = "SELECT *, CASE WHEN NOT over_max AND NOT mad15 AND NOT mad10 AND NOT seasonal5 THEN original END AS x FROM rs3"


@query(
    "staged_rescan",
    f"SELECT orgUnit, data_id, Month, over_max, mad15, mad10, seasonal5, coalesce(CASE WHEN top > 0 THEN {off_sql('x', 3)} END, FALSE) AS seasonal3 FROM {season_sql('rs3x', 'x')}",
    dates="Month",
    bools="over_max mad15 mad10 seasonal5 seasonal3",
)
def staged_rescan(spark, sf):
    base = madded(spark, sf).select("orgUnit", "data_id", "Month", "original", "over_max")
    for f in ("mad15", "mad10", "seasonal5", "seasonal3"):
        base = base.withColumn(f, F.lit(False))
    out = ol.rescan(base, ol.SERIES, "Month")
    return out.select("orgUnit", "data_id", "Month", "over_max", "mad15", "mad10", "seasonal5", "seasonal3")


@query(
    "error_labels",
    """
    SELECT error, error_rank, CAST(count(*) AS BIGINT) AS n, sum(original) AS total FROM (
      SELECT original, error, CAST(list_position(['All','key_entry_error','over_max','mad15','mad10','seasonal5','seasonal3','none'], error) AS INTEGER) AS error_rank FROM (
        SELECT original, CASE WHEN NOT key_entry_error AND NOT over_max AND NOT mad15 AND NOT mad10 AND NOT seasonal5 AND NOT seasonal3 THEN 'none'
          WHEN seasonal3 THEN 'seasonal3' WHEN seasonal5 THEN 'seasonal5' WHEN mad10 THEN 'mad10' WHEN mad15 THEN 'mad15'
          WHEN over_max THEN 'over_max' WHEN key_entry_error THEN 'key_entry_error' ELSE 'none' END AS error FROM flagged)) GROUP BY ALL
    """,
    nums="total",
)
def error_labels(spark, sf):
    return with_error_label(flagged(spark, sf)).groupBy("error", "error_rank").agg(
        F.count(F.lit(1)).alias("n"), F.sum("original").alias("total")
    )


@query(
    "clean_to_level",
    f"""SELECT data, Month, sum(CASE WHEN {_any(FLAG_ORDER[:4])} THEN expected ELSE original END) AS mad10_total,
        sum(CASE WHEN {_any(FLAG_ORDER)} THEN expected ELSE original END) AS seasonal3_total, sum(original) AS none_total
        FROM flagged GROUP BY ALL""",
    dates="Month",
    nums="mad10_total seasonal3_total none_total",
)
def clean_to_level(spark, sf):
    d = ol.clean_to_level(flagged(spark, sf), "mad10", "a")
    d = ol.clean_to_level(ol.clean_to_level(d, "seasonal3", "b"), "none", "c")
    return d.groupBy("data", "Month").agg(
        F.sum("a").alias("mad10_total"), F.sum("b").alias("seasonal3_total"), F.sum("c").alias("none_total")
    )


@query(
    "cleaned_data",
    f"""SELECT data, Month, sum(CASE WHEN NOT {_any(["key_entry_error", "over_max", "mad15"])} OR coalesce(seasonal3, FALSE) OR coalesce(seasonal5, FALSE) OR coalesce(mad10, FALSE) THEN original END) AS by_label,
        sum(CASE WHEN NOT {_any(["key_entry_error", "over_max", "mad15"])} THEN original END) AS by_union,
        sum(original) AS as_reported FROM flagged GROUP BY ALL""",
    dates="Month",
    nums="by_label by_union as_reported",
)
def cleaned_data(spark, sf):
    f = flagged(spark, sf)
    key = ["data", "Month"]
    a = ol.cleaned_data(f, "mad15").groupBy(*key).agg(F.sum("dataCol").alias("by_label"))
    b = ol.cleaned_data(f, "mad15", union_of_levels=True).groupBy(*key).agg(F.sum("dataCol").alias("by_union"))
    c = ol.cleaned_data(f).groupBy(*key).agg(F.sum("dataCol").alias("as_reported"))
    return a.join(b, key).join(c, key)


@query(
    "censor_levels",
    f"""SELECT data, count(CASE WHEN NOT {_any(FLAG_ORDER[:3])} THEN original END) AS mad15,
        count(CASE WHEN NOT {_any(FLAG_ORDER[:5])} THEN original END) AS seasonal5 FROM flagged GROUP BY 1""",
)
def censor_levels(spark, sf):
    d = ol.censor(ol.censor(flagged(spark, sf), "mad15", "a"), "seasonal5", "b")
    return d.groupBy("data").agg(F.count("a").alias("mad15"), F.count("b").alias("seasonal5"))


@query(
    "flagged_values",
    f"""
    WITH w AS (SELECT *, {_any(FLAG_ORDER)} AS fl, median(original) OVER ({S}) AS series_median,
                      count(*) FILTER ({_any(FLAG_ORDER)}) OVER ({S}) AS flags_in_series FROM flagged)
    SELECT Region, w.orgUnit, orgUnitName, data, data_id, Month, original, series_median,
           CASE WHEN series_median > 0 THEN round(original / series_median, 1) END AS ratio, {_FIRST} AS flag_type,
           c.orgUnit IS NOT NULL AS champion, flags_in_series
    FROM w LEFT JOIN champs c ON w.orgUnit = c.orgUnit WHERE fl
    """,
    dates="Month",
    bools="champion",
    nums="original series_median ratio",
)
def flagged_values(spark, sf):
    return ol.flagged_values(flagged(spark, sf), champs(spark, sf), ["Region"])


@query(
    "series_detail",
    f"""SELECT Month, original, series_median, CASE WHEN series_median > 0 THEN round(original / series_median, 1) END AS ratio,
        {_any(FLAG_ORDER)} AS any_flag, coalesce({_FIRST}, 'none') AS flag_type
        FROM (SELECT *, median(original) OVER ({S}) AS series_median FROM flagged) WHERE orgUnit = 'F5' AND data_id = 'deA00000001_ccF00000001'""",
    dates="Month",
    bools="any_flag",
    nums="original series_median ratio",
)
def series_detail(spark, sf):
    return ol.series_detail(flagged(spark, sf), "F5", "deA00000001_ccF00000001")


@query(
    "removal_effect",
    "SELECT Month, coalesce(sum(original), 0) AS original_total, "
    + ", ".join(
        f"coalesce(sum(CASE WHEN NOT {_any(FLAG_ORDER[:i])} THEN original END), 0) AS without_{FLAG_ORDER[i - 1]}"
        for i in (3, 4, 5, 6)
    )
    + " FROM flagged GROUP BY 1",
    dates="Month",
    nums="original_total without_mad15 without_mad10 without_seasonal5 without_seasonal3",
)
def removal_effect(spark, sf):
    return ol.removal_effect(flagged(spark, sf))


_SUM = ["AllSmall", "key_entry_error", "over_max", "mad15", "mad10", "mad5", "seasonal5", "seasonal3"]
_SUM_ERR = _SUM[1:]


@query(
    "outlier_summary",
    f"""
    WITH o AS (SELECT {', '.join(_SUM)}, count(original) AS n, coalesce(sum(original), 0) AS total, min(original) AS lo,
                      median(original) AS med, max(original) AS hi FROM flagged GROUP BY ALL),
    a AS (SELECT sum(n) AS n_all, sum(total) AS total_all FROM o),
    r AS ({' UNION ALL '.join(f"SELECT '{f}' AS err, CAST(sum(n) AS BIGINT) AS n, sum(total) AS total, min(lo) AS smallest, median(med) AS median, max(hi) AS largest FROM o WHERE {f}" for f in _SUM)}
      UNION ALL SELECT 'No Error Flags', CAST(sum(n) AS BIGINT), sum(total), min(lo), max(med), max(hi) FROM o WHERE NOT {_any(_SUM_ERR)})
    SELECT err, n, n / n_all AS share_n, total, total / total_all AS share_total, smallest, median, largest FROM r CROSS JOIN a WHERE n IS NOT NULL
    """,
    nums="share_n total share_total smallest median largest",
)
def outlier_summary(spark, sf):
    return ol.outlier_summary(flagged(spark, sf))


_ALG = ["mad15", "mad10", "seasonal5", "seasonal3"]
SQL["monthly"] = f"""
WITH e AS ({' UNION ALL '.join(f"SELECT Month, data, '{f}' AS Alg, coalesce(sum(original), 0) AS e, count(*) AS n_e FROM flagged WHERE {f} GROUP BY ALL" for f in _ALG)}
  UNION ALL SELECT Month, data, 'Combined', coalesce(sum(original), 0), count(*) FROM flagged WHERE {_any(_ALG)} GROUP BY ALL),
t AS (SELECT Month, data, coalesce(sum(original), 0) AS t, count(*) AS n_t FROM flagged GROUP BY ALL),
u AS (SELECT t.Month, t.data, Alg, e, n_e, t, n_t FROM t JOIN e ON t.Month = e.Month AND t.data = e.data
  UNION ALL SELECT x.Month, 'All', Alg, e, n_e, t, n_t FROM (SELECT Month, sum(t) AS t, sum(n_t) AS n_t FROM t GROUP BY 1) x
    LEFT JOIN (SELECT Month, Alg, sum(e) AS e, sum(n_e) AS n_e FROM e GROUP BY ALL) y ON x.Month = y.Month)
SELECT Month, year(Month) AS "year", data, Alg, e, CAST(n_e AS BIGINT) AS n_e, t, CAST(n_t AS BIGINT) AS n_t, e / nullif(t, 0) AS pe, n_e / n_t AS pn FROM u
"""
SQL["yearly"] = """
SELECT "year", data, sum(e) AS e, CAST(sum(n_e) AS BIGINT) AS n_e, sum(t) AS t, CAST(sum(n_t) AS BIGINT) AS n_t, sum(e) / nullif(sum(t), 0) AS pe, sum(n_e) / sum(n_t) AS pn
FROM monthly WHERE Alg = 'Combined' GROUP BY ALL
"""


@query("monthly_outliers", "SELECT * FROM monthly", dates="Month", nums="e t pe pn")
def monthly_outliers(spark, sf):
    return ol.monthly_outliers(flagged(spark, sf))


@query("yearly_outliers", "SELECT * FROM yearly", nums="e t pe pn")
def yearly_outliers(spark, sf):
    return ol.yearly_outliers(ol.monthly_outliers(flagged(spark, sf)))


@query(
    "outlier_percentages",
    """SELECT "year", 'percent_no_error' AS name, 1 - pn AS "value" FROM yearly WHERE data = 'All'
       UNION ALL SELECT "year", 'percent_value_no_error', pe FROM yearly WHERE data = 'All'""",
    nums='"value"',
)
def outlier_percentages(spark, sf):
    return ol.outlier_percentages(ol.yearly_outliers(ol.monthly_outliers(flagged(spark, sf))))


@query(
    "flag_counts",
    f"""SELECT data, count(*) AS n, count(*) FILTER ({_any(FLAG_ORDER)}) AS flagged,
        {', '.join(f"count(*) FILTER ({f}) AS {f}" for f in FLAG_ORDER)},
        round(100 * count(*) FILTER ({_any(FLAG_ORDER)}) / count(*), 1) AS pct FROM flagged GROUP BY 1""",
    nums="pct",
)
def flag_counts(spark, sf):
    return rp.flag_counts(flagged(spark, sf))


@query(
    "top_flagged_periods",
    f"""SELECT data, Month, flagged, CAST(r AS INTEGER) AS "rank" FROM (
        SELECT *, row_number() OVER (PARTITION BY data ORDER BY flagged DESC, Month) AS r FROM (
          SELECT data, Month, count(*) AS flagged FROM flagged WHERE {_any(FLAG_ORDER)} GROUP BY ALL)) WHERE r <= 5""",
    dates="Month",
)
def top_flagged_periods(spark, sf):
    return rp.top_flagged_periods(flagged(spark, sf))


def loess_sql(source: str, name: str, robust: bool) -> None:
    """Fixtures <name>_2: trend, season and rest of the column y of ``source`` (orgUnit, data_id, Month)."""
    k = "orgUnit, data_id"
    rho = lambda gap: f"coalesce(greatest(power(1 - power(least({gap} / greatest(6 * median({gap}) OVER (PARTITION BY {k}), 1e-9), 1), 2), 2), 1e-6), 1)"
    SQL[f"{name}_0"] = f"""
WITH b AS (SELECT *, year(Month) * 12 + month(Month) AS t, month(Month) AS part, median(y) OVER (PARTITION BY {k}) AS mid, count(*) OVER (PARTITION BY {k}) >= 24 AS long FROM {source}),
g AS (SELECT *, {rho("abs(y - mid)") if robust else "1.0::DOUBLE"} AS w, CASE WHEN count(y) OVER u = 13 THEN (sum(y) OVER u + sum(y) OVER v) / 24 END AS ma FROM b
    WINDOW u AS (PARTITION BY {k} ORDER BY t RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING), v AS (PARTITION BY {k} ORDER BY t RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
l AS (SELECT * EXCLUDE (ma), coalesce(CASE WHEN long THEN median(y - ma) OVER (PARTITION BY {k}, part) END, 0) AS lev FROM g)
SELECT * EXCLUDE (lev), lev - avg(lev) OVER (PARTITION BY {k}) AS season FROM l
"""
    for n in (1, 2):
        weight = rho("abs(rest)") if robust and n == 1 else "w"
        SQL[f"{name}_{n}"] = f"""
WITH near AS (SELECT a.orgUnit, a.data_id, a.t, b.y - b.season AS v, (b.t - a.t) / 10.0 AS d, power(1 - power(abs(b.t - a.t) / 10.0, 3), 3) * b.w AS w
    FROM {name}_{n - 1} a JOIN {name}_{n - 1} b ON a.orgUnit = b.orgUnit AND a.data_id = b.data_id AND b.t BETWEEN a.t - 9 AND a.t + 9 WHERE b.y IS NOT NULL),
sums AS (SELECT {k}, t, sum(w) AS w, sum(w * d) AS d, sum(w * d * d) AS dd, sum(w * v) AS y, sum(w * d * v) AS dy FROM near GROUP BY ALL),
line AS (SELECT {k}, t, CASE WHEN w * dd - d * d > 1e-9 * w * w THEN (dd * y - d * dy) / (w * dd - d * d) WHEN w > 0 THEN y / w END AS trend FROM sums),
x AS (SELECT p.* EXCLUDE (season), l.trend, p.y - l.trend AS r FROM (SELECT {k}, Month, y, original, t, part, w, season, long FROM {name}_{n - 1}) p LEFT JOIN line l ON l.orgUnit = p.orgUnit AND l.data_id = p.data_id AND l.t = p.t),
m AS (SELECT *, coalesce(CASE WHEN long THEN sum(r * w) OVER s / sum(w) FILTER (r IS NOT NULL) OVER s END, 0) AS lev FROM x WINDOW s AS (PARTITION BY {k}, part)),
o AS (SELECT * EXCLUDE (lev), lev - avg(lev) OVER (PARTITION BY {k}) AS season FROM m), z AS (SELECT *, y - trend - season AS rest FROM o)
SELECT * EXCLUDE (w), {weight} AS w FROM z
"""


SQL["ls_in"] = "SELECT *, CASE WHEN x IS NOT NULL THEN 2 * (sqrt(greatest(x, 0)) - 1) END AS y FROM (SELECT orgUnit, data_id, Month, original, CASE WHEN NOT mad10 THEN original END AS x FROM madded)"
loess_sql("ls_in", "ls", True)
SQL["ls_odd"] = """
WITH q AS (SELECT *, CASE WHEN y IS NULL THEN NULL ELSE power(1 + y / 2, 2) END AS x, quantile_cont(rest, 0.25) OVER w AS q1, quantile_cont(rest, 0.75) OVER w AS q3, count(y) OVER w AS n FROM ls_2 WINDOW w AS (PARTITION BY orgUnit, data_id))
SELECT *, coalesce((rest < q1 - 3 * (q3 - q1) - 0.01 * (1 + abs(y)) OR rest > q3 + 3 * (q3 - q1) + 0.01 * (1 + abs(y))) AND n >= 12, FALSE) AS odd FROM q
"""
SQL["ls_clean"] = """
WITH f AS (SELECT * EXCLUDE (x), original AS x0, CASE WHEN NOT odd AND y IS NOT NULL THEN y - season END AS adj FROM ls_odd),
b AS (SELECT *, last_value(adj IGNORE NULLS) OVER p AS bv, last_value(CASE WHEN adj IS NOT NULL THEN t END IGNORE NULLS) OVER p AS bt,
      first_value(adj IGNORE NULLS) OVER a AS av, first_value(CASE WHEN adj IS NOT NULL THEN t END IGNORE NULLS) OVER a AS at_
      FROM f WINDOW p AS (PARTITION BY orgUnit, data_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY orgUnit, data_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT orgUnit, data_id, Month, CASE WHEN y IS NOT NULL THEN x0 END AS x,
    CASE WHEN odd THEN power(1 + (coalesce(bv + (av - bv) * (t - bt) / nullif(at_ - bt, 0), bv, av) + season) / 2, 2) WHEN y IS NOT NULL THEN x0 END AS expected FROM b
"""
SQL["ls_flags"] = """
WITH c AS (SELECT *, median(x) OVER (PARTITION BY orgUnit, data_id) AS c FROM ls_clean),
m AS (SELECT *, 1.4826 * median(abs(x - c)) OVER (PARTITION BY orgUnit, data_id) AS m, abs(expected - x) AS gap FROM c)
SELECT orgUnit, data_id, Month, CASE WHEN m > 0 THEN gap / m >= 5 WHEN gap > 0 THEN TRUE END AS seasonal5, CASE WHEN m > 0 THEN gap / m >= 3 WHEN gap > 0 THEN TRUE END AS seasonal3, expected FROM m
"""


@query("model_seasonal_flags", "SELECT * FROM ls_flags", dates="Month", bools="seasonal5 seasonal3", nums="expected")
def model_seasonal_flags(spark, sf):
    """Seasonal flags from a decomposition of each series."""
    out = sm.model_seasonal_flags(madded(spark, sf), ol.SERIES)
    return out.select("orgUnit", "data_id", "Month", "seasonal5", "seasonal3", "expected")


SQL["rm_in"] = """
SELECT g.orgUnit, g.data_id, g.Month, f.original, f.original AS y FROM (
    SELECT orgUnit, data_id, CAST(unnest(generate_series((SELECT min(Month) FROM fact), (SELECT max(Month) FROM fact), INTERVAL 1 MONTH)) AS DATE) AS Month
    FROM (SELECT DISTINCT orgUnit, data_id FROM fact)) g
LEFT JOIN fact f ON f.orgUnit = g.orgUnit AND f.data_id = g.data_id AND f.Month = g.Month
"""
loess_sql("rm_in", "rm", False)


@query(
    "remainder_outliers",
    """SELECT orgUnit, data_id, Month, original, CASE WHEN count(*) OVER w >= 24 AND count(original) OVER w >= 12 THEN abs(rest) > 3 * stddev_samp(rest) OVER w + 1e-9 * (1 + max(abs(original)) OVER w) END AS outlier
       FROM rm_2 WINDOW w AS (PARTITION BY orgUnit, data_id)""",
    dates="Month",
    bools="outlier",
    nums="original",
)
def remainder_outliers(spark, sf):
    f = fx.fact(spark, sf).select("orgUnit", "data_id", "Month", "original")
    return sm.remainder_outliers(cf.fill_gaps(f, ol.SERIES), "original", ol.SERIES)


@query(
    "date_window",
    "SELECT data, CAST(count(*) AS BIGINT) AS n FROM fact WHERE Month >= DATE '1997-03-01' AND Month <= (SELECT max(Month) - INTERVAL 1 MONTH FROM fact) GROUP BY 1",
)
def date_window(spark, sf):
    """Rows from a start to the month before the newest."""
    f = fx.fact(spark, sf)
    newest = f.agg(F.add_months(F.max("Month"), -1)).scalar()
    return rp.within(f, "Month", "1997-03-01").filter(F.col("Month") <= newest).groupBy("data").agg(
        F.count(F.lit(1)).alias("n")
    )

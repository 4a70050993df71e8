"""Burden queries: case counts stand for confirmed, tested and attendance."""

from pyspark.sql import functions as F

from ..functions import draws, stats
from ..operators import burden as bd
from ..operators import metadata as md
from ..sources.staging import settle
from . import fixtures as fx
from .fixtures import SQL, sql_hash, sql_normal, sql_uniform
from .q_metadata import geo
from .q_reporting import champs
from .registry import query

N = 1000
TARGETS = ["Cases A_F", "Cases R_O"]
ATTEND = "Cases N_O"
TESTED = "Cases N_F"
START, END = "1998-01-01", "1999-12-01"
_T = ", ".join(f"'{t}'" for t in TARGETS)
_WIN = f"Month BETWEEN DATE '{START}' AND DATE '{END}'"

# One region has no champions, so that it borrows from others.
SQL["bd"] = """
SELECT f.orgUnit, Month, data, original AS "value", Region,
       CASE WHEN c.orgUnit IS NULL OR Region = 'ASIA' THEN 'Non-Champion' ELSE 'Champion' END AS Selected
FROM fact f LEFT JOIN champs c ON f.orgUnit = c.orgUnit
"""


def bdata(spark, sf, facts=None):
    facts = fx.stored_fact(spark, sf) if facts is None else facts
    marks = champs(spark, sf, facts).withColumn("_m", F.lit(True))
    f = facts.join(marks, "orgUnit", "left")
    label = F.when(F.col("_m").isNull() | (F.col("Region") == "ASIA"), "Non-Champion").otherwise("Champion")
    return f.select("orgUnit", "Month", "data", F.col("original").alias("value"), "Region", label.alias("Selected"))


def stored_bdata(spark, sf):
    """The input as a written table, for methods that read it several times."""
    facts = settle(fx.stored_fact(spark, sf).select("orgUnit", "Month", "data", "original", "Region"))
    return settle(bdata(spark, sf, facts))


# Regions next to each other by key.
SQL["neigh"] = """
SELECT a.r_name AS region, b.r_name AS neighbour FROM region a JOIN region b ON b.r_regionkey IN (a.r_regionkey + 1, a.r_regionkey - 1)
"""


def neigh(spark, sf):
    r = fx.table(spark, sf, "region")
    other = r.select(F.col("r_name").alias("neighbour"), F.col("r_regionkey").alias("k2"))
    return (
        r.select(
            F.col("r_name").alias("region"),
            F.explode(F.array(F.col("r_regionkey") + 1, F.col("r_regionkey") - 1)).alias("k2"),
        )
        .join(other, "k2")
        .select("region", "neighbour")
    )


def _ci(x="sample"):
    q = lambda p: f"CAST(round_even(round(quantile_cont({x}, {p}), 6), 0) AS BIGINT)"
    return f"CAST(round_even(round(avg({x}), 6), 0) AS BIGINT) AS estimate, {q(0.025)} AS lower, {q(0.975)} AS upper"


def result_sql(samples: str, method: str, sub: str | None = None) -> str:
    return f"""
    SELECT 'subnational' AS "level", '{method}' AS "method", region, category, {_ci()} FROM {sub or samples} GROUP BY region, category
    UNION ALL
    SELECT 'national', '{method}', 'National', category, {_ci()} FROM (SELECT category, draw, sum(sample) AS sample FROM {samples} GROUP BY ALL) GROUP BY category
    """


SQL["draw_ids"] = f"SELECT CAST(unnest(generate_series(1, {N})) AS BIGINT) AS draw"
SQL["univ"] = "SELECT DISTINCT orgUnit, Region AS region, Selected FROM bd WHERE Region IS NOT NULL"
SQL["bframe"] = f"""
SELECT u.*, c.category, t.total IS NOT NULL AS known, coalesce(t.total, 0) AS total
FROM univ u CROSS JOIN (SELECT unnest([{_T}]) AS category) c
LEFT JOIN (SELECT orgUnit, data, sum("value") AS total FROM bd WHERE data IN ({_T}) AND "value" IS NOT NULL AND {_WIN} GROUP BY ALL) t
  ON t.orgUnit = u.orgUnit AND t.data = c.category
"""
SQL["a_pools"] = """
SELECT 'own|' || region AS pool, category, orgUnit, total FROM bframe WHERE Selected = 'Champion'
UNION ALL SELECT 'near|' || n.region, category, orgUnit, total FROM neigh n JOIN bframe f ON f.region = n.neighbour WHERE Selected = 'Champion'
UNION ALL SELECT 'all', category, orgUnit, total FROM bframe WHERE Selected = 'Champion'
"""
SQL["a_idx"] = """
SELECT *, row_number() OVER (PARTITION BY pool, category ORDER BY substr(md5(orgUnit), 1, 2), orgUnit) - 1 AS i, count(*) OVER (PARTITION BY pool, category) AS n FROM a_pools
"""
SQL["a_plan"] = """
WITH r AS (SELECT region, category, count(*) FILTER (Selected = 'Champion') AS nc, coalesce(sum(total) FILTER (Selected = 'Champion'), 0) AS cs FROM bframe GROUP BY ALL),
p AS (SELECT pool, category, sum(total) AS s FROM a_pools GROUP BY ALL)
SELECT r.region, r.category, nc = 0 OR cs = 0 AS fb, CASE WHEN nc = 0 OR cs = 0 THEN 0 ELSE cs END AS base,
       CASE WHEN NOT (nc = 0 OR cs = 0) THEN 'own|' || r.region WHEN np.s > 0 THEN 'near|' || r.region WHEN ap.s > 0 THEN 'all' END AS pool
FROM r LEFT JOIN p np ON np.pool = 'near|' || r.region AND np.category = r.category LEFT JOIN p ap ON ap.pool = 'all' AND ap.category = r.category
"""
SQL["a_samples"] = f"""
WITH w AS (SELECT f.orgUnit, f.region, f.category, p.pool, d.draw FROM bframe f JOIN a_plan p ON f.region = p.region AND f.category = p.category CROSS JOIN draw_ids d
           WHERE p.pool IS NOT NULL AND (fb OR Selected <> 'Champion')),
n AS (SELECT DISTINCT pool, category, n FROM a_idx),
x AS (SELECT w.region, w.category, draw, sum(total) AS s FROM w JOIN n ON n.pool = w.pool AND n.category = w.category
      JOIN a_idx a ON a.pool = w.pool AND a.category = w.category AND a.i = {sql_hash("1", "'A'", "w.orgUnit", "w.category", "w.draw")} % n.n GROUP BY ALL)
SELECT p.region, p.category, p.pool, d.draw, base + coalesce(x.s, 0) AS sample FROM a_plan p CROSS JOIN draw_ids d
LEFT JOIN x ON x.region = p.region AND x.category = p.category AND x.draw = d.draw
"""
SQL["res_a"] = result_sql("a_samples", "A", "(SELECT * FROM a_samples WHERE pool IS NOT NULL)")


def res_a(spark, sf, data=None):
    return bd.champion_multiple(
        stored_bdata(spark, sf) if data is None else data, TARGETS, "Region", START, END, neighbours=neigh(spark, sf), n_draws=N
    )


@query("champion_multiple", "SELECT * FROM res_a")
def champion_multiple(spark, sf):
    return res_a(spark, sf)


# Method B. Planted gap: the attendance of every tenth facility by hash has no values.
SQL["b_in"] = f"""SELECT * REPLACE (CASE WHEN data = '{ATTEND}' AND {sql_hash("'unseen'", "orgUnit")} % 10 = 0 THEN NULL ELSE "value" END AS "value") FROM bd WHERE {_WIN}"""
SQL["b_tgt"] = f"""
SELECT t.*, a.attend FROM (SELECT orgUnit, data AS category, Region AS region, Selected, sum("value") AS total FROM b_in WHERE data IN ({_T}) AND "value" IS NOT NULL GROUP BY ALL) t
LEFT JOIN (SELECT orgUnit, sum("value") AS attend FROM b_in WHERE data = '{ATTEND}' AND "value" IS NOT NULL GROUP BY 1) a ON a.orgUnit = t.orgUnit
"""
SQL["b_fit"] = """
SELECT category, regr_slope(ln(total), ln(attend)) AS sl, regr_intercept(ln(total), ln(attend)) AS ic,
       sqrt((regr_syy(ln(total), ln(attend)) - pow(regr_sxy(ln(total), ln(attend)), 2) / regr_sxx(ln(total), ln(attend))) / (count(*) - 2)) AS sg
FROM b_tgt WHERE Selected = 'Champion' AND total > 0 AND attend > 0 GROUP BY 1 HAVING count(*) >= 3
"""
SQL["b_pools"] = """
SELECT 'own|' || region AS pool, category, orgUnit, total FROM b_tgt WHERE Selected = 'Champion' AND total > 0
UNION ALL SELECT 'all', category, orgUnit, total FROM b_tgt WHERE Selected = 'Champion' AND total > 0
"""
SQL["b_idx"] = """
SELECT *, row_number() OVER (PARTITION BY pool, category ORDER BY substr(md5(orgUnit), 1, 2), orgUnit) - 1 AS i, count(*) OVER (PARTITION BY pool, category) AS n FROM b_pools
"""
SQL["b_samples"] = f"""
WITH o AS (SELECT t.*, sl, ic, sg FROM b_tgt t JOIN b_fit f ON t.category = f.category WHERE Selected <> 'Champion'),
p AS (SELECT region, category, draw, sum(exp(ic + sl * ln(attend) + sg * {sql_normal("1", "'B'", "orgUnit", "category", "draw")})) AS p FROM o CROSS JOIN draw_ids WHERE attend > 0 GROUP BY ALL),
k AS (SELECT region, category, count(*) AS k, CASE WHEN ('own|' || region, category) IN (SELECT (pool, category) FROM b_pools) THEN 'own|' || region ELSE 'all' END AS pool FROM o WHERE attend IS NULL GROUP BY ALL),
m AS (SELECT DISTINCT pool, category, n FROM b_idx),
b AS (SELECT k.region, k.category, d.draw, sum(k.k * x.total) AS b FROM k CROSS JOIN draw_ids d JOIN m ON m.pool = k.pool AND m.category = k.category
      JOIN b_idx x ON x.pool = k.pool AND x.category = k.category AND x.i = {sql_hash("1", "'B0'", "k.region", "k.category", "d.draw")} % m.n GROUP BY ALL),
s AS (SELECT region, t.category, coalesce(sum(total) FILTER (Selected = 'Champion'), 0) AS base FROM b_tgt t JOIN b_fit f ON t.category = f.category GROUP BY ALL)
SELECT s.region, s.category, d.draw, base + coalesce(p.p, 0) + coalesce(b.b, 0) AS sample FROM s CROSS JOIN draw_ids d
LEFT JOIN p ON p.region = s.region AND p.category = s.category AND p.draw = d.draw LEFT JOIN b ON b.region = s.region AND b.category = s.category AND b.draw = d.draw
"""
SQL["res_b"] = result_sql("b_samples", "B")


def b_in(spark, sf):
    gone = (F.col("data") == ATTEND) & (draws.hash32("unseen", F.col("orgUnit")) % 10 == 0)
    return stored_bdata(spark, sf).withColumn("value", F.when(~gone, F.col("value")))


@query("attendance_multiple", "SELECT * FROM res_b")
def attendance_multiple(spark, sf):
    return bd.attendance_multiple(b_in(spark, sf), TARGETS, [ATTEND], "Region", None, START, END, n_draws=N)


# Method C1.
SQL["c_hist"] = f"""
WITH t AS (SELECT orgUnit, Region AS region, Selected, data AS category, Month, "value" FROM bd WHERE data IN ({_T}) AND Region IS NOT NULL),
r AS (SELECT region, category, month(Month) AS m, avg("value") AS v FROM t WHERE Selected = 'Champion' AND "value" IS NOT NULL GROUP BY ALL),
n AS (SELECT category, month(Month) AS m, avg("value") AS v FROM t WHERE Selected = 'Champion' AND "value" IS NOT NULL GROUP BY ALL)
SELECT t.*, coalesce(r.v, n.v) AS cm FROM t LEFT JOIN r ON r.region = t.region AND r.category = t.category AND r.m = month(t.Month)
LEFT JOIN n ON n.category = t.category AND n.m = month(t.Month)
"""
SQL["c_fit"] = """
SELECT orgUnit, category, count(*) AS n, regr_intercept(ln(1 + "value"), cm) AS a, regr_slope(ln(1 + "value"), cm) AS b,
       sqrt(greatest((regr_syy(ln(1 + "value"), cm) - pow(regr_sxy(ln(1 + "value"), cm), 2) / nullif(regr_sxx(ln(1 + "value"), cm), 0)) / nullif(count(*) - 2, 0), 0)) AS s
FROM c_hist WHERE "value" IS NOT NULL AND cm IS NOT NULL GROUP BY ALL HAVING count(*) >= 3 AND regr_slope(ln(1 + "value"), cm) IS NOT NULL
"""
SQL["c_rows"] = f"SELECT h.*, f.a, f.b, f.s FROM c_hist h LEFT JOIN c_fit f ON f.orgUnit = h.orgUnit AND f.category = h.category WHERE {_WIN}"
SQL["c_unit"] = """SELECT region, category, orgUnit, coalesce(sum("value"), 0) AS actual, bool_or(b IS NOT NULL) AS modelled FROM c_rows GROUP BY ALL"""
SQL["c_pools"] = """
SELECT 'own|' || region AS pool, category, orgUnit, total FROM bframe WHERE Selected = 'Champion'
UNION ALL SELECT 'all', category, orgUnit, total FROM bframe WHERE Selected = 'Champion' AND known
"""
SQL["c_idx"] = """
SELECT *, row_number() OVER (PARTITION BY pool, category ORDER BY substr(md5(orgUnit), 1, 2), orgUnit) - 1 AS i, count(*) OVER (PARTITION BY pool, category) AS n FROM c_pools
"""
def imputed_sql(rows: str, unit: str, method: str, borrow: bool = False) -> str:
    """Draws of an imputation: what was reported, draws for missing months (mu, sg of ``rows``), borrowed totals.
    With ``borrow`` facilities that are not modelled borrow as well, in place of what they reported."""
    more = f"UNION ALL SELECT orgUnit, region, category, {_POOL} AS pool FROM {unit} f WHERE NOT modelled" if borrow else ""
    return f"""
WITH d AS (SELECT region, category, draw, sum(greatest(exp(mu + sg * {sql_normal("1", f"'{method}'", "orgUnit", "category", "Month", "draw")}) - 1, 0)) AS d
           FROM {rows} CROSS JOIN draw_ids WHERE "value" IS NULL AND mu IS NOT NULL AND sg IS NOT NULL GROUP BY ALL),
w AS (SELECT f.orgUnit, f.region, f.category, {_POOL} AS pool
      FROM bframe f ANTI JOIN {unit} u ON u.region = f.region AND u.category = f.category AND u.orgUnit = f.orgUnit WHERE f.Selected <> 'Champion' {more}),
m AS (SELECT DISTINCT pool, category, n FROM c_idx),
x AS (SELECT w.region, w.category, dd.draw, sum(c.total) AS x FROM w CROSS JOIN draw_ids dd JOIN m ON m.pool = w.pool AND m.category = w.category
      JOIN c_idx c ON c.pool = w.pool AND c.category = w.category AND c.i = {sql_hash("1", f"'{method}0'", "w.orgUnit", "w.category", "dd.draw")} % m.n GROUP BY ALL),
b AS (SELECT region, category, sum(actual) {"FILTER (modelled)" if borrow else ""} AS base FROM {unit} GROUP BY ALL)
SELECT f.region, f.category, dd.draw, coalesce(b.base, 0) + coalesce(d.d, 0) + coalesce(x.x, 0) AS sample
FROM (SELECT DISTINCT region, category FROM bframe) f CROSS JOIN draw_ids dd LEFT JOIN b ON b.region = f.region AND b.category = f.category
LEFT JOIN d ON d.region = f.region AND d.category = f.category AND d.draw = dd.draw LEFT JOIN x ON x.region = f.region AND x.category = f.category AND x.draw = dd.draw
"""


def imputed_result_sql(samples: str, unit: str, method: str) -> str:
    return f"""
SELECT r.*, c.n_with_data, c.n_not_ts FROM ({result_sql(samples, method)}) r
LEFT JOIN (SELECT region, category, count(*) AS n_with_data, count(*) FILTER (NOT modelled) AS n_not_ts FROM {unit} GROUP BY ALL) c ON c.region = r.region AND c.category = r.category
"""


_POOL = "CASE WHEN f.region IN (SELECT region FROM bframe WHERE Selected = 'Champion') THEN 'own|' || f.region ELSE 'all' END"
SQL["c1_rows"] = "SELECT *, a + b * cm AS mu, s AS sg FROM c_rows"
SQL["c_samples"] = imputed_sql("c1_rows", "c_unit", "C1")
SQL["res_c1"] = imputed_result_sql("c_samples", "c_unit", "C1")

# Methods C2 and CA: the outcome freed of one regressor after the other, then of its own past.
_BY = "(PARTITION BY orgUnit, category)"
SQL["s_start"] = f"""
WITH t AS (SELECT *, ln(1 + "value") AS y, coalesce(cm, 0) AS x1, sin(2 * pi() * month(Month) / 12) AS x2, cos(2 * pi() * month(Month) / 12) AS x3, year(Month) * 12 + month(Month) AS t FROM c_hist),
k AS (SELECT *, avg(y) OVER w AS fit, x1 - avg(x1) FILTER (y IS NOT NULL) OVER w AS u1, x2 - avg(x2) FILTER (y IS NOT NULL) OVER w AS u2, x3 - avg(x3) FILTER (y IS NOT NULL) OVER w AS u3
      FROM t WINDOW w AS {_BY})
SELECT *, y - fit AS r, count(y) OVER {_BY} AS n, 1 AS rank, sum(u1 * u1) FILTER (y IS NOT NULL) OVER {_BY} AS q1, sum(u2 * u2) FILTER (y IS NOT NULL) OVER {_BY} AS q2, sum(u3 * u3) FILTER (y IS NOT NULL) OVER {_BY} AS q3 FROM k
"""
for _i, _later in ((1, (2, 3)), (2, (3,)), (3, ())):
    _sums = ", ".join(f"sum(u{_i} * u{_k}) FILTER (y IS NOT NULL) OVER {_BY} AS c{_k}" for _k in _later)
    _freed = ", ".join(f"u{_k} - CASE WHEN s > 1e-9 * q{_i} THEN c{_k} / s ELSE 0 END * u{_i} AS u{_k}" for _k in _later)
    _b = f"CASE WHEN s > 1e-9 * q{_i} THEN b / s ELSE 0 END * u{_i}"
    SQL[f"s_step{_i}"] = f"""
SELECT * EXCLUDE (s, b{"".join(f", c{_k}" for _k in _later)}) REPLACE (fit + {_b} AS fit, r - {_b} AS r, rank + coalesce(CAST(s > 1e-9 * q{_i} AS INTEGER), 0) AS rank {", " + _freed if _later else ""})
FROM (SELECT *, sum(u{_i} * u{_i}) FILTER (y IS NOT NULL) OVER {_BY} AS s, sum(u{_i} * r) OVER {_BY} AS b {", " + _sums if _later else ""} FROM {"s_start" if _i == 1 else f"s_step{_i - 1}"})
"""
SQL["s_fit"] = """
WITH k AS (SELECT orgUnit, category, t, r FROM s_step3 WHERE r IS NOT NULL),
p AS (SELECT x.orgUnit, x.category, greatest(least(sum(x.r * z.r) / nullif(sum(z.r * z.r), 0), 0.95), -0.95) AS phi FROM k x JOIN k z ON x.orgUnit = z.orgUnit AND x.category = z.category AND x.t = z.t + 1 GROUP BY ALL),
l AS (SELECT x.*, coalesce(p.phi, 0) AS phi, z.t AS zt, z.r AS zr FROM s_step3 x LEFT JOIN p ON p.orgUnit = x.orgUnit AND p.category = x.category
      ASOF LEFT JOIN k z ON z.orgUnit = x.orgUnit AND z.category = x.category AND z.t < x.t),
f AS (SELECT *, fit + CASE WHEN zr IS NULL THEN 0 ELSE power(phi, t - zt) * zr END AS whole FROM l),
g AS (SELECT *, sqrt(sum((y - whole) * (y - whole)) OVER (PARTITION BY orgUnit, category) / greatest(n - rank - 1, 1)) AS sigma FROM f)
SELECT orgUnit, category, Month, CASE WHEN n >= 12 AND sigma > 0 THEN whole END AS fitted, CASE WHEN n >= 12 AND sigma > 0 THEN sigma END AS sigma_ts FROM g
"""
SQL["s_rows"] = """
SELECT c.*, fitted, CASE WHEN fitted IS NULL THEN a + b * cm ELSE fitted END AS mu, CASE WHEN fitted IS NULL THEN s ELSE sigma_ts END AS sg
FROM c_rows c LEFT JOIN s_fit f ON f.orgUnit = c.orgUnit AND f.category = c.category AND f.Month = c.Month
"""
SQL["s_unit"] = """SELECT region, category, orgUnit, coalesce(sum("value"), 0) AS actual, bool_or(b IS NOT NULL OR fitted IS NOT NULL) AS modelled FROM s_rows GROUP BY ALL"""
SQL["s_samples"] = imputed_sql("s_rows", "s_unit", "C2")
SQL["res_c2"] = imputed_result_sql("s_samples", "s_unit", "C2")
SQL["ca_samples"] = imputed_sql("s_rows", "s_unit", "CA", True)
SQL["res_ca"] = imputed_result_sql("ca_samples", "s_unit", "CA")


def res_c1(spark, sf, data=None):
    return bd.linear_imputation(stored_bdata(spark, sf) if data is None else data, TARGETS, "Region", START, END, n_draws=N)


@query("linear_imputation", "SELECT * FROM res_c1")
def linear_imputation(spark, sf):
    return res_c1(spark, sf)


@query("series_imputation", "SELECT * FROM res_c2")
def series_imputation(spark, sf):
    return bd.series_imputation(stored_bdata(spark, sf), TARGETS, "Region", START, END, n_draws=N)


@query("burden_cascade", "SELECT * FROM res_ca")
def burden_cascade(spark, sf):
    return bd.cascade(stored_bdata(spark, sf), TARGETS, "Region", START, END, n_draws=N)


_DK = ["1", "'D'", '"method"', '"level"', "region", "category"]


@query(
    "care_seeking_adjustment",
    f"""
    WITH r AS (SELECT *, CASE WHEN category = 'Cases A_F' THEN 0.7 ELSE 0.8 END AS p FROM res_a),
    s AS (SELECT "method", "level", region, category, p, greatest(0, (estimate + greatest(1, (upper - lower) / 3.92) * {sql_normal(*_DK, "draw")})
       / (greatest(0.01, p - 0.05) + (least(0.99, p + 0.05) - greatest(0.01, p - 0.05)) * {sql_uniform(*_DK, "draw", "'p'")})) AS sample FROM r CROSS JOIN draw_ids)
    SELECT "method" AS base_method, region, category, "level", {_ci()}, round(p, 3) AS care_p FROM s GROUP BY ALL
    """,
    nums="care_p",
)
def care_seeking_adjustment(spark, sf):
    return bd.care_seeking_adjustment(res_a(spark, sf), {"Cases A_F": 0.7}, n_draws=N)


# Method E.
_E = ["1", "'E'", "region", "category", "draw"]
_mix = lambda lo, hi, name: f"({lo} + ({hi} - {lo}) * {sql_uniform(*_E, repr(name))})"
SQL["e_reg"] = f"""
WITH a AS (SELECT orgUnit, Region AS region, data, sum("value") AS v, count(DISTINCT month(Month)) AS k FROM bd
           WHERE {_WIN} AND "value" IS NOT NULL AND Selected = 'Champion' GROUP BY ALL),
j AS (SELECT c.region, c.data AS category, c.v AS conf, t.v AS test, n.v AS att, p.v AS pop, c.k >= 6 AND coalesce(t.k >= 6, FALSE) AND coalesce(n.k >= 6, FALSE) AS ok
      FROM a c LEFT JOIN a t ON t.orgUnit = c.orgUnit AND t.region = c.region AND t.data = '{TESTED}' LEFT JOIN a n ON n.orgUnit = c.orgUnit AND n.region = c.region AND n.data = '{ATTEND}'
      LEFT JOIN a p ON p.orgUnit = c.orgUnit AND p.region = c.region AND p.data = 'Stock out days' WHERE c.data IN ({_T}))
SELECT region, category, count(*) FILTER (ok) AS n_champions, sum(conf) FILTER (ok) AS conf, sum(test) FILTER (ok) AS test, sum(att) FILTER (ok) AS att, sum(pop) FILTER (ok) AS pop
FROM j GROUP BY ALL
"""
SQL["e_draw"] = f"""
WITH a AS (SELECT region, category, draw, greatest(0, test - conf) AS d, conf AS e, greatest(0, att - test) AS f, CASE WHEN pop > 0 THEN pop END AS pop,
    {_mix(0.49, 0.61, "beta")} AS be, {_mix(0.42, 0.55, "alpha")} AS al, {_mix(0.5, 0.95, "lambda")} AS lm, 1000.0 AS si FROM e_reg CROSS JOIN draw_ids WHERE n_champions > 0),
b AS (SELECT *, least(al * e / nullif(d + e, 0), 0.999) AS t FROM a),
c AS (SELECT *, greatest(0, (f - d * (1 - be) / be) / ((1 - be) / be + t / (1 - t) + 1)) AS bb FROM b),
g AS (SELECT *, e + greatest(0, t / (1 - t) * bb) AS cs FROM c),
h AS (SELECT *, 1 + (lm - 1) * (cs / greatest(1, bb + cs + d)) AS lam FROM g),
i AS (SELECT *, (d + bb + (1 - lam) * cs) / pop * 1000 AS nmf FROM h)
SELECT region, category, draw, CASE WHEN d + e = 0 THEN 0 ELSE greatest(cs, 0) END AS sample,
       CASE WHEN d + e = 0 THEN NULL WHEN nmf > 0 THEN cs / pop * 1000 * lam * (si / nmf) ELSE cs / pop * 1000 END AS inc FROM i
"""


@query(
    "robust_incidence",
    f"""
    SELECT 'subnational' AS "level", 'E' AS "method", r.region, r.category, s.estimate, s.lower, s.upper, r.n_champions, s.i AS incidence_per_1k, s.il AS incidence_lower, s.iu AS incidence_upper
    FROM e_reg r LEFT JOIN (SELECT region, category, {_ci()}, round(avg(inc), 1) AS i, round(quantile_cont(inc, 0.025), 1) AS il, round(quantile_cont(inc, 0.975), 1) AS iu FROM e_draw GROUP BY ALL) s
      ON s.region = r.region AND s.category = r.category
    UNION ALL SELECT 'national', 'E', 'National', category, {_ci()}, NULL, NULL, NULL, NULL FROM (SELECT category, draw, sum(sample) AS sample FROM e_draw GROUP BY ALL) GROUP BY category
    """,
    nums="incidence_per_1k incidence_lower incidence_upper",
)
def robust_incidence(spark, sf):
    return bd.robust_incidence(
        bdata(spark, sf), TARGETS, [ATTEND], [TESTED], "Region", "Stock out days", start=START, end=END, min_months=6, n_draws=N
    )


# Attendance, tested and confirmed by facility and month, in order of size.
SQL["triples"] = """
SELECT orgUnit, Month, greatest(a, b, c) AS attendance, a + b + c - greatest(a, b, c) - least(a, b, c) AS tested, least(a, b, c) AS confirmed FROM (
  SELECT orgUnit, Month, sum(CASE WHEN data = 'Cases A_F' THEN "value" END) AS a, sum(CASE WHEN data = 'Cases N_O' THEN "value" END) AS b,
         sum(CASE WHEN data = 'Stock out days' THEN "value" END) AS c FROM bd GROUP BY ALL)
"""


def triples(spark, sf):
    v = lambda n: F.sum(F.when(F.col("data") == n, F.col("value")))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return (
        bdata(spark, sf)
        .groupBy("orgUnit", "Month")
        .agg(v("Cases A_F").alias("a"), v("Cases N_O").alias("b"), v("Stock out days").alias("c"))
        .select(
            "orgUnit",
            "Month",
            F.greatest(a, b, c).alias("attendance"),
            (a + b + c - F.greatest(a, b, c) - F.least(a, b, c)).alias("tested"),
            F.least(a, b, c).alias("confirmed"),
        )
    )


_ADJ = """CASE WHEN confirmed < tested AND tested < attendance THEN CASE WHEN (tested - confirmed) / (attendance - confirmed) >= 0.589 THEN {0} ELSE {1} END END"""


@query(
    "adjusted_cases",
    f"""SELECT *, {_ADJ.format("confirmed / attendance", "(confirmed + (0.589 * attendance - tested) * (confirmed / tested)) / attendance")} AS adj_rate,
        {_ADJ.format("confirmed", "round_even(round(confirmed + (0.589 * attendance - tested) * (confirmed / tested), 6), 0)")} AS adj_cases FROM triples""",
    dates="Month",
    nums="attendance tested confirmed adj_rate adj_cases",
)
def adjusted_cases(spark, sf):
    return bd.adjusted_cases(triples(spark, sf))


@query(
    "corrected_incidence",
    """
    WITH a AS (SELECT orgUnit, Month, tested - confirmed AS d, confirmed AS e, attendance - tested AS f, 5000.0 AS pop, (1 - 0.589) / 0.589 AS o FROM triples),
    b AS (SELECT *, 0.475 * e / nullif(d + e, 0) AS t FROM a), c AS (SELECT *, t / (1 - t) AS od, (f - d * o) / (o + t / (1 - t) + 1) AS bb FROM b),
    g AS (SELECT *, od * bb AS cc FROM c), h AS (SELECT *, 1 + (0.75 - 1) * ((cc + e) / nullif(bb + cc + d + e, 0)) AS lam FROM g),
    i AS (SELECT *, 10000 / nullif((bb + d + (1 - lam) * (cc + e)) / pop * 1000, 0) AS r FROM h)
    SELECT orgUnit, Month, round((cc + e) / pop * r * 1000, 2) AS corrected_incidence, (cc + e) / nullif(e, 0) AS testing_correction, round(r, 2) AS incidence_correction,
           round((cc + e) * lam / pop * r * 1000, 2) AS corrected_incidence_attributable FROM i
    """,
    dates="Month",
    nums="corrected_incidence testing_correction incidence_correction corrected_incidence_attributable",
)
def corrected_incidence(spark, sf):
    out = bd.corrected_incidence(triples(spark, sf).withColumn("population", F.lit(5000.0)))
    two = ["corrected_incidence", "incidence_correction", "corrected_incidence_attributable"]
    return out.select("orgUnit", "Month", "testing_correction", *[F.round(c, 2).alias(c) for c in two])


SQL["pops"] = f"""
WITH y AS (SELECT Region AS region, year(Month) AS y, sum("value") AS v FROM bd WHERE data = '{ATTEND}' AND "value" IS NOT NULL AND Region IS NOT NULL AND {_WIN} GROUP BY ALL),
r AS (SELECT region, avg(v) AS population FROM y GROUP BY 1) SELECT * FROM r UNION ALL SELECT 'National', sum(population) FROM r
"""
SQL["rated"] = """
SELECT a.*, population, round(estimate / population * 100000, 1) AS rate_per_100k, round(lower / population * 100000, 1) AS rate_lower,
       round(upper / population * 100000, 1) AS rate_upper FROM res_a a LEFT JOIN pops p ON a.region = p.region
"""


def rated(spark, sf):
    data = stored_bdata(spark, sf)
    return bd.population_rates(res_a(spark, sf, data), data, ATTEND, "Region", START, END)


@query("population_rates", "SELECT * FROM rated", nums="population rate_per_100k rate_lower rate_upper")
def population_rates(spark, sf):
    return rated(spark, sf)


_TXT = "format('{:,d} [{:,d}-{:,d}]', estimate, lower, upper)"


@query(
    "burden_summary_table",
    f"""SELECT region, category, max(CASE WHEN "method" = 'A' THEN {_TXT} END) AS "A", max(CASE WHEN "method" = 'C1' THEN {_TXT} END) AS "C1"
        FROM (SELECT * FROM res_a UNION ALL SELECT * EXCLUDE (n_with_data, n_not_ts) FROM res_c1) WHERE "level" = 'subnational' GROUP BY ALL""",
)
def burden_summary_table(spark, sf):
    data = stored_bdata(spark, sf)
    both = res_a(spark, sf, data).unionByName(res_c1(spark, sf, data).select(*bd.RESULT))
    return bd.summary_table(both, ["A", "C1"], "subnational")


_Z = "3.919927969080108"


@query(
    "burden_category_totals",
    f"""
    SELECT * FROM res_a UNION ALL
    SELECT "level", "method", region, 'Total', CAST(sum(estimate) AS BIGINT), CAST(round_even(round(sum(estimate) - {stats.Z975} * sqrt(sum(pow((upper - lower) / {_Z}, 2))), 6), 0) AS BIGINT),
           CAST(round_even(round(sum(estimate) + {stats.Z975} * sqrt(sum(pow((upper - lower) / {_Z}, 2))), 6), 0) AS BIGINT) FROM res_a GROUP BY ALL
    """,
)
def burden_category_totals(spark, sf):
    return bd.category_totals(res_a(spark, sf))


_P = stats
_cdf_t = f"(1 / (1 + {_P._CDF_P} * abs(z)))"
_poly = "0.0"
for _b in reversed(_P._CDF_B):
    _poly = f"(({_poly} + {_b}) * {_cdf_t})"
_tail = f"(exp(-z * z / 2) / 2.5066282746310002 * {_poly})"


@query(
    "compare_regions",
    f"""
    WITH a AS (SELECT s.*, r.estimate AS re, greatest((s.upper - s.lower) / {_Z}, 1) AS s1, greatest((r.upper - r.lower) / {_Z}, 1) AS s2
               FROM res_a s JOIN res_a r ON s.category = r.category AND r.region = 'EUROPE' WHERE s."level" = 'subnational'),
    b AS (SELECT *, (estimate - re) / sqrt(s1 * s1 + s2 * s2) AS z FROM a), c AS (SELECT *, CASE WHEN z >= 0 THEN 1 - {_tail} ELSE {_tail} END AS p FROM b)
    SELECT "method", region, category, estimate - re AS diff, p AS p_higher, CASE WHEN p IS NULL THEN 'No data' WHEN region = 'EUROPE' THEN 'Reference' WHEN p > 0.9 THEN 'Significantly higher'
      WHEN p < 1 - 0.9 THEN 'Significantly lower' ELSE 'Not significantly different' END AS sig_cat FROM c
    """,
    nums="p_higher",
)
def compare_regions(spark, sf):
    return bd.compare_with(res_a(spark, sf), "EUROPE")


@query(
    "burden_facility_counts",
    """SELECT CASE WHEN grouping(region) = 1 THEN 'National' ELSE region END AS region, count(DISTINCT CASE WHEN Selected = 'Champion' THEN orgUnit END) AS n_champ,
       count(DISTINCT orgUnit) AS n_total, count(DISTINCT CASE WHEN Selected = 'Champion' THEN orgUnit END) || ' / ' || count(DISTINCT orgUnit) AS champ_total FROM univ GROUP BY ROLLUP (region)""",
)
def burden_facility_counts(spark, sf):
    return bd.facility_counts(bdata(spark, sf), "Region")


@query(
    "not_modelled_share",
    """SELECT region, CAST(sum(n_not_ts) AS BIGINT) AS n_not_ts, CAST(sum(n_with_data) AS BIGINT) AS n_with_data, round(100 * sum(n_not_ts) / greatest(sum(n_with_data), 1), 0) AS pct_not_ts
       FROM res_c1 WHERE "level" = 'subnational' GROUP BY 1""",
    nums="pct_not_ts",
)
def not_modelled_share(spark, sf):
    return bd.not_modelled_share(res_c1(spark, sf))


@query(
    "touching_regions",
    """
    WITH g AS (SELECT n_name AS name, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation)
    SELECT a.name AS region, b.name AS neighbour FROM g a JOIN g b ON a.name <> b.name AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1
    """,
)
def touching_regions(spark, sf):
    return bd.touching_regions(md.polygons_at(geo(spark, sf), 3))


@query("run_burden_methods")
def run_burden_methods(spark, sf):
    return bd.run_methods(
        bdata(spark, sf, settle(fx.stored_fact(spark, sf).select("orgUnit", "Month", "data", "original", "Region"))),
        TARGETS,
        "Region",
        attendance=[ATTEND],
        tested=[TESTED],
        population="Stock out days",
        neighbours=neigh(spark, sf),
        start=START,
        end=END,
        run_d=True,
        n_draws=N,
    )

"""Forecast, ensemble, error-measure and impact queries.

Draws for the checked queries are a hash-made spread around last year's
value, so both engines hold the same draws; fitted models are separate
queries.
"""

from pyspark.sql import functions as F

from ..functions import draws as rnd
from ..operators import forecast as fc
from ..operators import outliers as ol
from ..sources.staging import settle
from . import fixtures as fx
from .fixtures import SQL, sql_hash, sql_normal, sql_uniform
from .q_outliers import madded
from .q_reporting import SERIES
from .registry import query
from .sql_fits import sql_fits

K = ["Region"]
CUT, LAST = "2000-01-01", "2000-12-01"
N = 30
MODELS = ["a", "e", "t"]

SQL["act"] = "SELECT Region, Month, coalesce(sum(original), 0) AS total FROM fact GROUP BY ALL"
SQL["act_test"] = f"SELECT * FROM act WHERE Month BETWEEN DATE '{CUT}' AND DATE '{LAST}'"
SQL["drw"] = f"""
SELECT a.Region, CAST(a.Month + INTERVAL 12 MONTH AS DATE) AS Month, model, CAST(draw AS INTEGER) AS draw,
       a.total * (CASE model WHEN 'a' THEN 0.8 WHEN 'e' THEN 0.85 ELSE 0.75 END + 0.4 * {sql_uniform("7", "model", "a.Region", "a.Month", "draw")}) AS sample
FROM act a CROSS JOIN (SELECT unnest(['a', 'e', 't']) AS model) CROSS JOIN (SELECT unnest(generate_series(1, {N})) AS draw)
WHERE a.Month BETWEEN DATE '1999-01-01' AND DATE '1999-12-01'
"""


def act(spark, sf):
    return fx.fact(spark, sf).groupBy("Region", "Month").agg(F.coalesce(F.sum("original"), F.lit(0.0)).alias("total"))


def act_test(spark, sf):
    return act(spark, sf).filter(F.col("Month").between(F.lit(CUT).cast("date"), F.lit(LAST).cast("date")))


def drw(spark, sf):
    base = act(spark, sf).filter(F.year("Month") == 1999)
    u = rnd.uniform(7, F.col("model"), F.col("Region"), F.col("Month"), F.col("draw"))
    start = F.when(F.col("model") == "a", 0.8).when(F.col("model") == "e", 0.85).otherwise(0.75)
    return (
        base.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
        .withColumn("draw", rnd.draw_ids(N))
        .select(
            "Region",
            F.add_months("Month", 12).alias("Month"),
            "model",
            "draw",
            (F.col("total") * (start + 0.4 * u)).alias("sample"),
        )
    )


@query(
    "seasonal_naive",
    """SELECT Region, CAST(Month + INTERVAL 12 MONTH AS DATE) AS Month, total AS mean FROM act WHERE year(Month) = 1999
       UNION ALL SELECT Region, CAST(Month + INTERVAL 24 MONTH AS DATE), total FROM act WHERE Month BETWEEN DATE '1999-01-01' AND DATE '1999-06-01'""",
    dates="Month",
    nums="mean",
)
def seasonal_naive(spark, sf):
    return fc.seasonal_naive(act(spark, sf), K, CUT, 18)


@query(
    "trend_forecast",
    f"""WITH f AS (SELECT Region, regr_slope(total, year(Month) * 12 + month(Month)) AS b, regr_intercept(total, year(Month) * 12 + month(Month)) AS a FROM act WHERE Month < DATE '{CUT}' GROUP BY 1)
        SELECT Region, CAST(DATE '{CUT}' + to_months(CAST(k AS INTEGER)) AS DATE) AS Month, round(a + b * (24000 + 1 + k), 2) AS mean FROM f CROSS JOIN generate_series(0, 11) g(k)""",
    dates="Month",
    nums="mean",
)
def trend_forecast(spark, sf):
    return fc.trend_forecast(act(spark, sf), K, CUT).withColumn("mean", F.round("mean", 2))


# Months of a region, of which every ninth by hash is a gap.
SQL["gaps"] = f"SELECT Region, Month, CASE WHEN {sql_hash("'gap'", "Region", "Month")} % 9 = 0 THEN NULL ELSE total END AS total FROM act"


def gaps(spark, sf):
    seen = rnd.hash32("gap", F.col("Region"), F.col("Month")) % 9 != 0
    return act(spark, sf).withColumn("total", F.when(seen, F.col("total")))


def rounded(fits):
    return fits.withColumns({"mean": F.round("mean", 2), "sd": F.round("sd", 2)})


@query("fit_models", f"SELECT Region, Month, model, round(mean, 2) AS mean, round(sd, 2) AS sd, status FROM ({sql_fits('gaps', ['Region'], CUT, 12)}) WHERE status = 'ok'", dates="Month", nums="mean sd")
def fit_models(spark, sf):
    """Every model family on every region, one year ahead of the cut."""
    return rounded(fc.fitted_only(fc.fit_forecast(gaps(spark, sf), K, CUT), K))


SQL["unit_series"] = "SELECT orgUnit, data, Month, original AS total FROM fact"


@query(
    "fit_status",
    f"SELECT model, status, count(*) AS n, count(mean) AS n_mean, round(sum(mean), 0) AS mean, round(sum(sd), 0) AS sd FROM ({sql_fits('unit_series', ['orgUnit', 'data'], '1997-03-01', 3)}) GROUP BY ALL",
    nums="mean sd",
)
def fit_status(spark, sf):
    """What becomes of every model on every series of a facility, of which many are short."""
    series = fx.fact(spark, sf).select("orgUnit", "data", "Month", F.col("original").alias("total"))
    fits = fc.fit_forecast(series, ["orgUnit", "data"], "1997-03-01", 3)
    sums = [F.round(F.sum(c), 0).alias(c) for c in ("mean", "sd")]
    return fits.groupBy("model", "status").agg(F.count("*").alias("n"), F.count("mean").alias("n_mean"), *sums)


_DRAW = ["1432", "Region", "model", "Month", "draw"]


@query(
    "fit_pre_window",
    f"""
    WITH d AS (SELECT Region, Month, model, exp(mean + sd * {sql_normal(*_DRAW)}) - 1 AS sample
        FROM ({sql_fits('gaps', ['Region'], '1999-01-01', 12, 'log1p')}), (SELECT unnest(generate_series(1, 100)) AS draw) WHERE status = 'ok')
    SELECT Region, Month, model, round(avg(sample), 1) AS mean, round(quantile_cont(sample, 0.1), 1) AS lower, round(quantile_cont(sample, 0.9), 1) AS upper FROM d GROUP BY ALL
    """,
    dates="Month",
    nums="mean lower upper",
)
def fit_pre_window(spark, sf):
    fits = fc.pre_window_forecast(gaps(spark, sf), K, CUT, transform="log1p")
    told = fc.point_forecast(fc.forecast_draws(fits, K, 100, transform="log1p"), K)
    return told.withColumns({c: F.round(c, 1) for c in ("mean", "lower", "upper")})


SQL["with_units"] = "SELECT Region, Month, sum(original) AS total, CAST(count(DISTINCT orgUnit) AS DOUBLE) AS facilities FROM fact GROUP BY ALL"


@query("fit_with_covariate", f"SELECT Region, Month, model, round(mean, 2) AS mean, round(sd, 2) AS sd, status FROM ({sql_fits('with_units', ['Region'], CUT, 12, 'sqrt', 'facilities')}) WHERE model IN ('a', 't')", dates="Month", nums="mean sd")
def fit_with_covariate(spark, sf):
    d = (
        fx.fact(spark, sf)
        .groupBy("Region", "Month")
        .agg(F.sum("original").alias("total"), F.countDistinct("orgUnit").cast("double").alias("facilities"))
    )
    return rounded(fc.window_forecast(d, K, CUT, models=("a", "t"), covariate="facilities", transform="sqrt"))


@query(
    "forecast_draws",
    f"""SELECT Region, Month, model, CAST(draw AS INTEGER) AS draw, round(mean + sd * {sql_normal(*_DRAW)}, 1) AS sample
        FROM ({sql_fits('gaps', ['Region'], CUT, 12)}), (SELECT unnest(generate_series(1, 50)) AS draw) WHERE status = 'ok' AND model IN ('s', 't')""",
    dates="Month",
    nums="sample",
)
def forecast_draws(spark, sf):
    fits = fc.fit_forecast(gaps(spark, sf), K, CUT, models=("s", "t"))
    return fc.forecast_draws(fits, K, 50).withColumn("sample", F.round("sample", 1))


SQL["combos"] = """
SELECT Region, Month, c.combo AS model, draw, avg(sample) AS sample FROM drw
JOIN (VALUES ('a', 'a'), ('e', 'e'), ('t', 't'), ('ae', 'a'), ('ae', 'e'), ('at', 'a'), ('at', 't'), ('et', 'e'), ('et', 't'), ('aet', 'a'), ('aet', 'e'), ('aet', 't')) c(combo, m) ON drw.model = c.m
GROUP BY ALL
"""


def combos(spark, sf):
    return fc.ensembles(drw(spark, sf), K, MODELS)


@query("ensembles", "SELECT * FROM combos", dates="Month", nums="sample")
def ensembles(spark, sf):
    return combos(spark, sf)


@query(
    "ensemble_summary",
    "SELECT Region, Month, model, avg(sample) AS mean, stddev_samp(sample) AS sd FROM combos GROUP BY ALL",
    dates="Month",
    nums="mean sd",
)
def ensemble_summary(spark, sf):
    return fc.draw_summary(combos(spark, sf), K)


SQL["acc"] = """
SELECT Region, model, avg(s) AS swape FROM (
  SELECT d.Region, model, draw, 200 * sum(abs(total - sample)) / (sum(abs(total)) + sum(abs(sample))) AS s FROM combos d JOIN act_test a ON a.Region = d.Region AND a.Month = d.Month GROUP BY ALL) GROUP BY ALL
"""


def acc(spark, sf):
    return fc.swape(combos(spark, sf), act_test(spark, sf), K)


@query("swape", "SELECT * FROM acc", nums="swape")
def swape(spark, sf):
    return acc(spark, sf)


SQL["ranked"] = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY Region ORDER BY swape, model) AS rk, round(swape, 3) AS s FROM acc),
b AS (SELECT *, first_value(s) OVER (PARTITION BY Region ORDER BY swape, model) AS f FROM r)
SELECT Region, b.model, s AS swape, CAST(rk AS INTEGER) AS "rank", round(100 * (s - f) / f, 3) AS percent_diff, m.mean FROM b
JOIN (SELECT model, avg(swape) AS mean FROM acc GROUP BY 1) m ON m.model = b.model
"""


@query("rank_models", 'SELECT * FROM ranked WHERE "rank" <= 3', nums="swape percent_diff mean")
def rank_models(spark, sf):
    return fc.rank_models(acc(spark, sf), "swape", K, 3)


@query(
    "choose_model",
    """SELECT 'synchronize' AS how, Region, model FROM acc WHERE model = (SELECT model FROM acc GROUP BY 1 ORDER BY avg(swape) LIMIT 1)
       UNION ALL SELECT 'optimize', Region, model FROM ranked WHERE "rank" = 1""",
)
def choose_model(spark, sf):
    a = acc(spark, sf)
    one = fc.choose_model(a, "synchronize", K).withColumn("how", F.lit("synchronize"))
    return one.unionByName(fc.choose_model(a, "optimize", K).withColumn("how", F.lit("optimize")))


@query(
    "best_per_group",
    """SELECT c.* FROM combos c JOIN ranked r ON r.Region = c.Region AND r.model = c.model WHERE "rank" = 1""",
    dates="Month",
    nums="sample",
)
def best_per_group(spark, sf):
    return fc.best_per_group(combos(spark, sf), acc(spark, sf), K)


SQL["wpes"] = """
SELECT d.Region, model, draw, sum(total - sample) / sum(sample) * 100 AS "WPE" FROM drw d JOIN act_test a ON a.Region = d.Region AND a.Month = d.Month GROUP BY ALL
"""


def wpes(spark, sf):
    return fc.wpe(drw(spark, sf), act_test(spark, sf), K)


@query("wpe_draws", "SELECT * FROM wpes", nums='"WPE"')
def wpe_draws(spark, sf):
    return wpes(spark, sf)


@query(
    "wpe_summary",
    'SELECT Region, model, count(*) AS n, avg("WPE") AS mean, stddev_samp("WPE") AS sd, median("WPE") AS median FROM wpes GROUP BY ALL',
    nums="mean sd median",
)
def wpe_summary(spark, sf):
    return fc.wpe_summary(wpes(spark, sf), K)


@query(
    "wpe_histogram",
    """SELECT w.Region, w.model, round("WPE", 0) AS bin, count(*) AS n, round("WPE", 0) = any_value(m) AS is_median FROM wpes w
       JOIN (SELECT Region, model, round(median("WPE"), 0) AS m FROM wpes GROUP BY ALL) s ON s.Region = w.Region AND s.model = w.model GROUP BY w.Region, w.model, round("WPE", 0)""",
    bools="is_median",
    nums="bin",
)
def wpe_histogram(spark, sf):
    return fc.wpe_histogram(wpes(spark, sf), K)


@query(
    "change_probability",
    """SELECT Region, model, CASE WHEN median("WPE") < 0 THEN 'decrease' ELSE 'increase' END AS direction,
       CASE WHEN median("WPE") < 0 THEN avg(CAST("WPE" < 0 AS INTEGER)) ELSE avg(CAST("WPE" > 0 AS INTEGER)) END AS probability FROM wpes GROUP BY ALL""",
    nums="probability",
)
def change_probability(spark, sf):
    return fc.change_probability(wpes(spark, sf), K)


SQL["pts"] = """
SELECT Region, Month, avg(sample) AS mean, quantile_cont(sample, 0.1) AS lower, quantile_cont(sample, 0.9) AS upper FROM drw WHERE model = 'a' GROUP BY ALL
"""


def pts(spark, sf):
    return fc.point_forecast(drw(spark, sf).filter("model = 'a'"), K).drop("model")


@query(
    "overall_errors",
    """SELECT CASE WHEN avg(total) > 0 THEN avg(abs(total - mean)) / avg(total) END AS mape, CASE WHEN avg(mean) > 0 THEN avg(total - mean) / avg(mean) END AS mpe
       FROM pts p JOIN act a ON a.Region = p.Region AND a.Month = p.Month""",
    nums="mape mpe",
)
def overall_errors(spark, sf):
    return fc.overall_errors(pts(spark, sf), act(spark, sf), K)


@query(
    "key_mape",
    """SELECT p.Region, avg(abs(total - mean)) / avg(mean) AS mape, list_sort(list(p.Month))[6] AS Month, max(total) AS actual
       FROM pts p JOIN act a ON a.Region = p.Region AND a.Month = p.Month GROUP BY 1""",
    dates="Month",
    nums="mape actual",
)
def key_mape(spark, sf):
    return fc.key_mape(pts(spark, sf), act(spark, sf), K)


@query(
    "key_mpe",
    """SELECT Region, predicted, pred_upper, pred_lower, actual, actual - predicted AS diff, (actual - predicted) / predicted AS mpe, abs(actual - predicted) / predicted AS mape FROM (
       SELECT p.Region, sum(mean) AS predicted, sum(upper) AS pred_upper, sum(lower) AS pred_lower, sum(total) AS actual FROM pts p JOIN act a ON a.Region = p.Region AND a.Month = p.Month GROUP BY 1)""",
    nums="predicted pred_upper pred_lower actual diff mpe mape",
)
def key_mpe(spark, sf):
    return fc.key_mpe(pts(spark, sf), act(spark, sf), K)


SQL["mpes"] = """
SELECT model, draw, sum(total) AS actual, sum(sample) AS forecast, (sum(total) - sum(sample)) / sum(sample) AS mpe FROM drw d JOIN act_test a ON a.Region = d.Region AND a.Month = d.Month GROUP BY ALL
"""


def mpes(spark, sf):
    return fc.mpe_distribution(drw(spark, sf), act_test(spark, sf), K, ["model"])


@query("mpe_distribution", "SELECT * FROM mpes", nums="actual forecast mpe")
def mpe_distribution(spark, sf):
    return mpes(spark, sf)


_HDI = """SELECT {by}, first(lo ORDER BY w, lo) AS hdi_lower, first(hi ORDER BY w, lo) AS hdi_upper FROM (
  SELECT {by}, v AS lo, lead(v, CAST(floor(n * {mass}) AS INTEGER)) OVER (PARTITION BY {by} ORDER BY v) AS hi, lead(v, CAST(floor(n * {mass}) AS INTEGER)) OVER (PARTITION BY {by} ORDER BY v) - v AS w
  FROM (SELECT {by}, {v} AS v, count(*) OVER (PARTITION BY {by}) AS n FROM {src})) WHERE hi IS NOT NULL GROUP BY {by}"""


@query(
    "mpe_share_and_interval",
    f"""SELECT h.*, n, share FROM ({_HDI.format(by='model', v='mpe', src='mpes', mass=0.9)}) h
        JOIN (SELECT model, count(mpe) AS n, avg(CAST(mpe <= 0.02 AS INTEGER)) AS share FROM mpes GROUP BY 1) s ON s.model = h.model""",
    nums="hdi_lower hdi_upper share",
)
def mpe_share_and_interval(spark, sf):
    m = mpes(spark, sf)
    return fc.density_interval(m, "mpe", ["model"]).join(fc.share_at_most(m, 0.02, by=["model"]), "model")


SQL["gap"] = """
SELECT t.model, t.draw, t."WPE" - c."WPE" AS "WPE" FROM wpes t JOIN wpes c ON t.model = c.model AND t.draw = c.draw AND t.Region = 'ASIA' AND c.Region = 'EUROPE'
"""


@query("group_difference", "SELECT * FROM gap", nums='"WPE"')
def group_difference(spark, sf):
    return fc.group_difference(wpes(spark, sf), "Region", "EUROPE", "ASIA")


@query(
    "probability_below",
    'SELECT model, CAST(t AS DOUBLE) AS threshold, avg(CAST("WPE" <= t AS INTEGER)) AS probability FROM gap CROSS JOIN (VALUES (0.0), (-10.0), (-20.0)) v(t) GROUP BY ALL',
    nums="threshold probability",
)
def probability_below(spark, sf):
    return fc.probability_below(fc.group_difference(wpes(spark, sf), "Region", "EUROPE", "ASIA"))


SQL["impact_rows"] = """
SELECT Region, model, draw, "WPE" FROM wpes WHERE Region IN ('ASIA', 'EUROPE') UNION ALL SELECT 'ASIA - EUROPE', model, draw, "WPE" FROM gap
"""


@query(
    "impact_table",
    f"""SELECT s.Region, s.model, n, mean, sd, median, hdi_lower, hdi_upper FROM (SELECT Region, model, count(*) AS n, avg("WPE") AS mean, stddev_samp("WPE") AS sd, median("WPE") AS median FROM impact_rows GROUP BY ALL) s
        JOIN ({_HDI.format(by='Region, model', v='"WPE"', src='impact_rows', mass=0.95)}) h ON h.Region = s.Region AND h.model = s.model""",
    nums="mean sd median hdi_lower hdi_upper",
)
def impact_table(spark, sf):
    return fc.impact_table(wpes(spark, sf), "Region", "EUROPE", "ASIA")


@query(
    "bottom_up",
    """SELECT Month, model, draw, CASE WHEN grouping(Region) = 1 THEN '<aggregated>' ELSE Region END AS Region, sum(sample) AS sample FROM drw
       GROUP BY GROUPING SETS ((Month, model, draw), (Month, model, draw, Region))""",
    dates="Month",
    nums="sample",
)
def bottom_up(spark, sf):
    return fc.bottom_up(drw(spark, sf), "Region")


@query(
    "model_ranks",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY Region ORDER BY swape, model) AS rk FROM acc),
       m AS (SELECT model, avg(swape) AS mean_swape, stddev_samp(swape) AS sd_swape, avg(rk) AS mean_rank FROM r GROUP BY 1)
       SELECT *, CAST(row_number() OVER (ORDER BY mean_swape, model) AS INTEGER) AS rank_by_mean, CAST(row_number() OVER (ORDER BY mean_rank, model) AS INTEGER) AS rank_of_ranks FROM m""",
    nums="mean_swape sd_swape mean_rank",
)
def model_ranks(spark, sf):
    return fc.model_ranks(acc(spark, sf), "Region")


SCENARIOS = [
    {"setting": f"{error}-{k}", "error": error, "start": "1996-01-01", "end": "1999-12-01", "missing_reports": k,
     "reporting_rule": "all_elements", "categories": SERIES}
    for error in ("none", "mad15", "mad10")
    for k in (5, 8)
]


def _scenario_sql():
    from .q_reporting import champion_sql

    parts = []
    for s in SCENARIOS:
        bad = {"none": "FALSE"}.get(s["error"]) or " OR ".join(
            f"coalesce({f}, FALSE)" for f in ["key_entry_error", "over_max", "mad15", "mad10"][: 3 if s["error"] == "mad15" else 4]
        )
        units = champion_sql("all_elements", s["missing_reports"], s["start"], s["end"])
        parts.append(
            f"SELECT '{s['setting']}' AS setting, Region, Month, coalesce(sum(CASE WHEN NOT ({bad}) THEN original END), 0) AS total "
            f"FROM madded WHERE orgUnit IN ({units}) GROUP BY ALL"
        )
    return " UNION ALL ".join(parts)


@query("scenario_totals", _scenario_sql(), dates="Month", nums="total")
def scenario_totals(spark, sf):
    return fc.scenario_totals(madded(spark, sf), SCENARIOS, K)


@query("scenario_errors")
def scenario_errors(spark, sf):
    """Facts are stored first: flags, the values behind them and the champions each read them."""
    facts = settle(fx.stored_fact(spark, sf))
    return fc.scenario_errors(ol.seasonal_flags(ol.mad_flags(facts)), SCENARIOS, K, CUT, transform="log1p")

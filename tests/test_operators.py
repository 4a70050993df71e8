"""Operators on small tables with known answers or brute-force checks."""

import datetime as dt
import hashlib
import pathlib
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldtally.functions import draws, flags, periods, stats, text
from fieldtally.operators import (
    burden,
    conform,
    consistency,
    derived,
    forecast,
    outliers,
    reporting,
    seasonal_models,
    totals,
)
from fieldtally import plans
from fieldtally.plans import q_conform
from fieldtally.sources import refresh, staging, tables
from harness import differences


def month(i, start=2020):
    return dt.date(start + i // 12, i % 12 + 1, 1)


def series(spark, values, unit="F1", data="Cases"):
    rows = [(unit, data, data, data, month(i), None if v is None else float(v), True) for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows,
        "orgUnit string, dataElement string, data string, data_id string, Month date, original double, effectiveLeaf boolean",
    )


def column(df, name, order="Month"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


# -- text and periods --------------------------------------------------------------


@pytest.mark.parametrize("code", [0x00, 0x0B, 0x1F, 0x7F, 0x9F, 0xAD, 0x200D, 0x2060, 0xFEFF])
def test_strip_invisible_drops_each_fixed_code_point(spark, code):
    d = spark.createDataFrame([(f"{chr(code)}north{chr(code)} west\t{chr(code)}1\n", 7)], "unit string, n int")
    assert text.strip_invisible(d).collect() == [("north west\t1\n", 7)]


def test_strip_invisible_keeps_rows_and_types(spark):
    d = spark.createDataFrame([(None, 1.5, True), ("é ü ß", None, None)], "unit string, share double, open boolean")
    got = text.strip_invisible(d)
    assert got.schema == d.schema and sorted(got.collect(), key=str) == sorted(d.collect(), key=str)


def test_truncate_counts_its_mark(spark):
    names = ["".join(chr(97 + i % 26) for i in range(n)) for n in (11, 12, 13, 400)]
    d = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, facility string")
    got = [r.facility for r in text.truncate_strings(d, 12).orderBy("i").collect()]
    assert got[:2] == names[:2]
    assert all(len(g) == 12 and g.endswith(text.CUT_MARK) and n.startswith(g[: -len(text.CUT_MARK)]) for g, n in zip(got[2:], names[2:]))


def test_base_element_without_suffix(spark):
    d = spark.createDataFrame([("Cases",), ("a_b_c",)], "x string")
    assert [r[0] for r in d.select(text.base_element(F.col("x"))).collect()] == ["Cases", "a_b"]


@pytest.mark.parametrize(
    "written, want",
    [("January2020", "2020-01-01"), ("2025 Jan", "2025-01-01"), ("201901", "2019-01-01"), ("2019-07", "2019-07-01"),
     ("Mar 2021", "2021-03-01"), ("nothing", None)],
)
def test_parse_month(spark, written, want):
    got = spark.createDataFrame([(written,)], "t string").select(periods.parse_month(F.col("t"))).first()[0]
    assert (str(got) if got else None) == want


def test_weeks_round_trip(spark):
    d = spark.createDataFrame([("2019W01",), ("2020W53",), ("2021W1",), ("2021Q1",)], "c string")
    w = d.select(periods.week_from_code(F.col("c")).alias("w"))
    assert [str(r[0]) for r in w.collect()] == ["2018-12-31", "2020-12-28", "2021-01-04", "None"]
    back = w.filter("w IS NOT NULL").select(periods.week_code(F.col("w")))
    assert [r[0] for r in back.collect()] == ["2019W01", "2020W53", "2021W01"]


# -- statistics -----------------------------------------------------------------------


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 4000), "v": np.round(rng.lognormal(2, 2, 4000), 1)})
    got = stats.exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", [0.01, 0.5, 0.9], ["a", "b", "c"]).toPandas()
    for _, r in got.iterrows():
        want = np.quantile(pdf.v[pdf.g == r.g], [0.01, 0.5, 0.9])
        assert np.allclose([r.a, r.b, r.c], want)


def test_dense_index_is_complete(spark):
    d = spark.range(1000).select((F.col("id") % 3).alias("g"), F.concat(F.lit("u"), "id").alias("k"))
    got = stats.dense_index(d, ["g"], "k", "i").groupBy("g").agg(
        F.min("i"), F.max("i"), F.countDistinct("i").alias("n"), F.max("i_n").alias("m")
    )
    for r in got.collect():
        assert r[1] == 0 and r[2] == r["n"] - 1 and r["n"] == r["m"]


def test_draws_do_not_depend_on_partitions(spark):
    d = spark.range(500).select(draws.uniform(1, F.col("id")).alias("u"), draws.normal(1, F.col("id")).alias("z"), "id")
    a = d.orderBy("id").toPandas()
    b = d.repartition(7).orderBy("id").toPandas()
    assert a.equals(b) and 0 < a.u.min() and a.u.max() < 1 and abs(a.z.mean()) < 0.2


# -- outliers ---------------------------------------------------------------------------


def flat(n=24):
    return [100 + (i % 5) for i in range(n)]


def test_single_spike_is_flagged_at_every_level(spark):
    v = flat()
    v[7] = 5000
    d = outliers.mad_flags(series(spark, v))
    for f in ("mad15", "mad10", "mad5"):
        assert column(d, f) == [i == 7 for i in range(24)]


def test_all_small_series_has_null_flags(spark):
    d = outliers.seasonal_flags(outliers.mad_flags(series(spark, [5] * 24)))
    assert set(column(d, "mad10")) == {None} and set(column(d, "seasonal3")) == {None}
    assert set(column(d, "AllSmall")) == {True}


def test_all_missing_series(spark):
    d = outliers.mad_flags(series(spark, [None] * 6))
    assert set(column(d, "mad15")) == {None}


def test_zero_mad_uses_trimmed_sd(spark):
    v = [100] * 20 + [90, 110, 95, 300]
    got = column(outliers.extreme_values(series(spark, v), "original", ["orgUnit", "data_id"], 5.0), "extreme")
    lo, hi = np.quantile(v, [0.01, 0.99])
    sd = statistics.stdev([x for x in v if lo < x < hi])
    assert got == [abs(x - 100) > 5 * 0.6745 * sd for x in v]


def test_key_entry_errors_are_the_repeated_long_values(spark):
    v = [1234] * 40 + [1000 + i for i in range(10)] + flat(6)
    d = outliers.key_entry_values(series(spark, v))
    assert [r.original for r in d.collect()] == [1234.0]


def test_stock_out_days_above_a_month(spark):
    d = outliers.mad_flags(series(spark, [10, 31, 32, None], data="Stock out days"))
    assert column(d, "over_max") == [False, False, True, None]


def test_mad_levels_are_nested(spark):
    rng = np.random.default_rng(1)
    d = outliers.mad_flags(series(spark, list(np.round(rng.lognormal(5, 1.2, 60)))))
    for r in d.collect():
        assert not (r.mad15 and not r.mad10) and not (r.mad10 and not r.mad5)


def test_rescan_keeps_earlier_flags_and_masks(spark):
    v = flat(36)
    v[3], v[9] = 9000, 400
    base = series(spark, v).withColumns({f: F.lit(False) for f in flags.SOURCE_FLAGS})
    base = base.withColumn("over_max", F.col("Month") == F.lit(month(3)))
    d = outliers.rescan(base, ["orgUnit", "data_id"], "Month")
    assert column(d, "over_max")[3] and not column(d, "mad15")[3] and column(d, "mad15")[9]


def test_error_label_names_the_mildest_flag(spark):
    d = spark.createDataFrame(
        [(False, False, True, False, False, True), (False,) * 6, (True, False, False, False, False, None)],
        ", ".join(f"{f} boolean" for f in flags.FLAG_ORDER),
    )
    assert [r.error for r in flags.with_error_label(d).collect()] == ["seasonal3", "none", "key_entry_error"]


def test_clean_series_replaces_the_spike_only(spark):
    v = [200 + 50 * np.sin(2 * np.pi * i / 12) for i in range(48)]
    v[20] = 3000
    out = column(seasonal_models.clean_series(series(spark, v), "original", ["orgUnit", "data_id"]), "cleaned")
    assert out[20] < 400 and all(abs(a - b) < 1e-9 for i, (a, b) in enumerate(zip(out, v)) if i != 20)


def test_remainder_outliers_need_enough_values(spark):
    short = seasonal_models.remainder_outliers(series(spark, flat(12)), "original", ["orgUnit", "data_id"])
    assert set(column(short, "outlier")) == {None}
    v = flat(36)
    v[5] = 900
    long = seasonal_models.remainder_outliers(series(spark, v), "original", ["orgUnit", "data_id"])
    assert column(long, "outlier")[5] is True


# -- reporting ---------------------------------------------------------------------------


def reports(spark):
    full = [("A", m, d) for m in range(24) for d in ("x_1", "x_2", "y_1")]
    late = [("B", m, "x_1") for m in range(12, 24)]
    holey = [("C", m, d) for m in range(24) if m % 12 != 3 for d in ("x_1", "y_1")]
    rows = [(u, f"n{u}", "R", month(m), d, d, 1.0) for u, m, d in full + late + holey]
    return spark.createDataFrame(
        rows, "orgUnit string, orgUnitName string, Region string, Month date, data string, data_id string, original double"
    )


def found(df):
    return sorted(r.orgUnit for r in df.collect())


def test_champions_by_rule(spark):
    d, cats = reports(spark), ["x_1", "x_2", "y_1"]
    assert found(reporting.champions(d)) == ["A"]
    assert found(reporting.champions(d, missing_reports=1)) == ["A", "C"]
    assert found(reporting.champions(d, start="2021-01-01")) == ["A", "B"]
    assert found(reporting.champions(d, None, None, 1, "all_elements", cats)) == ["A", "C"]
    assert found(reporting.champions(d, None, None, 1, "all_categories", cats)) == ["A"]


def test_champion_grid_equals_single_searches(spark):
    d, cats = reports(spark), ["x_1", "x_2", "y_1"]
    settings = [
        {"setting": f"{r}{k}{s}", "reporting_rule": r, "missing_reports": k, "start": s, "categories": cats}
        for r in reporting.RULES for k in (0, 1) for s in (None, "2021-01-01")
    ]
    grid = reporting.champion_grid(d, settings).toPandas()
    for s in settings:
        one = found(reporting.champions(d, s["start"], None, s["missing_reports"], s["reporting_rule"], cats))
        assert sorted(grid.orgUnit[grid.setting == s["setting"]]) == one


def test_yearly_completeness_of_a_full_year_is_one(spark):
    d = reports(spark).filter("orgUnit = 'A'")
    assert [r.pr for r in reporting.yearly_completeness(d).orderBy("Year").collect()] == [1.0, 1.0]


def test_preparation_scans_what_it_prepared(spark):
    sf = "/root/testdata/sf0.001"
    whole = plans.all_queries()["prepare_facts_scanned"](spark, sf)
    plain = q_conform.prepare_facts(spark, sf)
    want = outliers.seasonal_flags(outliers.mad_flags(plain)).drop("AllSmall", "scan_value", "not_mad")
    assert set(whole.columns) == set(want.columns)
    got = whole.select("orgUnit", "data_id", "mad10", "seasonal3", "key_entry_error").toPandas()
    want = want.select("orgUnit", "data_id", *[F.col(c).cast("int").alias(c) for c in ("mad10", "seasonal3", "key_entry_error")]).toPandas()
    assert differences(got, want) is None and whole.where("expected is not null").count() > 0


def test_effective_leaf_of_rows_is_that_of_their_unit(spark):
    d = spark.createDataFrame(
        [("A", "x", "1", True), ("A", "x", "3", False), ("A", "x", "1", False), ("A", "y", "1", False), ("B", "x", None, None),
         ("B", "x", "1", None), ("B", "x", "n/a", False), (None, "x", "1", True), ("A", None, "1", True)],
        "orgUnit string, dataElement_id string, COUNT string, leaf boolean",
    )
    got = {(r.orgUnit, r.dataElement_id, r.leaf): r.effectiveLeaf for r in conform.with_effective_leaf(d).collect()}
    want = {(r.orgUnit, r.dataElement_id, r.leaf): r.effectiveLeaf for r in conform.effective_leaf(d).collect()}
    assert got == want | {k: None for k in want if None in k[:2]}
    assert got["A", "x", False] is False and got["A", "y", False] is True and got["B", "x", None] is True


def test_prepared_facts_are_dealt_once_by_facility(spark):
    """Merged pieces grow with the facts; each sort of a task holds all rows of its piece."""
    raw = spark.createDataFrame([(f"F{i % 40}", "de", "cc", f"20200{i % 9 + 1}", 1, float(i)) for i in range(360)], "orgUnit string, dataElement string, categoryOptionCombo string, period string, COUNT int, SUM double")
    elements = spark.createDataFrame([("de", "Cases")], "dataElement_id string, dataElement string")
    categories = spark.createDataFrame([("mix", "Mix", "new", "cc")], "categoryCombo_id string, categoryCombo string, Categories string, categoryOptionCombo_ids string")
    sets = spark.createDataFrame([("ds", "Monthly", "de")], "dataSet_id string, dataSet string, dataElement_id string")
    tree = spark.createDataFrame([(f"F{i}", f"Unit {i}", i % 2 == 0) for i in range(40)], "orgUnit string, orgUnitName string, leaf boolean")
    out = conform.prepare(raw, elements, categories, sets, tree, scan_outliers=False)
    assert out.count() == 360 and out.filter("effectiveLeaf AND data = 'Cases_new' AND dataSet = 'Monthly'").count() == 360
    pieces = out.withColumn("piece", F.spark_partition_id()).select("orgUnit", "piece").distinct().collect()
    assert len(pieces) == 40 and len({p.piece for p in pieces}) > 1


def scenario_facts(spark):
    rows = [(u, r, "Cases", month(i), None if v is None else float(v), bad) for u, r, v, bad in
            (("A", "North", 5, False), ("A", "North", 5, True), ("B", "North", None, False), ("C", None, 7, None), (None, "South", 9, False)) for i in range(24)]
    return spark.createDataFrame(rows, "orgUnit string, Region string, data string, Month date, original double, mad15 boolean")


def test_scenario_totals_of_repeated_and_missing_rows(spark):
    settings = [{"setting": "all"}, {"setting": "clean", "error": "mad15"}]
    got = {(r.setting, r.Region): r.total for r in forecast.scenario_totals(scenario_facts(spark), settings, ["Region"]).filter(F.col("Month") == month(3)).collect()}
    assert got == {("all", "North"): 10.0, ("clean", "North"): 5.0, ("all", None): 7.0, ("clean", None): 7.0}


def test_scenario_errors_read_stored_totals(spark, tmp_path):
    """Totals serve as series and as truth: facts are not read again for each."""
    scenario_facts(spark).write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    out = forecast.scenario_errors(facts, [{"setting": "all"}], ["Region"], month(12), transform="log1p")
    assert [(r.Region, round(r.mape, 6)) for r in out.collect()] == [("North", 0.0)]
    assert not any(str(tmp_path) in f for f in out.inputFiles())


# -- ratios and rules ----------------------------------------------------------------------


def test_ratio_golden(spark):
    d = spark.createDataFrame(
        [("p", 9.0, 36.0), ("q", 2.0, 5.0), ("r", None, 17.0), ("s", 4.0, None), ("t", None, None)],
        "orgUnit string, numerator double, denominator double",
    )
    got = {r.orgUnit: r.ratio for r in derived.paired_totals(d, ["orgUnit"]).collect()}
    assert got == {"p": 0.25, "q": 0.4, "r": 0.0, "s": None, "t": None}


def test_ratio_step_same_or_two_tables(spark):
    d = series(spark, [5, None, 20, 0], data="n").unionByName(series(spark, [10, 10, 10], data="d"))
    for na_rm in (True, False):
        one = derived.Step("ratio", "r", numerator=derived.Side(d, ["n"]), denominator=derived.Side(d, ["d"]), na_rm=na_rm)
        two = derived.Step(
            "ratio", "r", numerator=derived.Side(d, ["n"]), denominator=derived.Side(d.filter("true"), ["d"]), na_rm=na_rm
        )
        a, b = (derived.ratio_step(s).orderBy("Month").select("original").collect() for s in (one, two))
        assert a == b
        assert [r.original for r in a] == [0.5, 0.0 if na_rm else None, 2.0, None]


SIDES = [
    ("#{aaaaaaaaaaa} / #{bbbbbbbbbbb.ccccccccccc} + 1", 4.0),
    ("(#{aaaaaaaaaaa} - 2) * 0.5", 2.0),
    ("8 / (#{bbbbbbbbbbb.ccccccccccc} + 2) - 1", 1.0),
    ("12 / 2 / 3 - 1 - 1", 0.0),
    ("#{aaaaaaaaaaa} / (#{bbbbbbbbbbb.ccccccccccc} / #{aaaaaaaaaaa})", 18.0),
    ("(#{aaaaaaaaaaa} + 1) / (#{bbbbbbbbbbb.ccccccccccc} * (#{aaaaaaaaaaa} / 2))", 7 / 6),
    ("#{aaaaaaaaaaa}--1", 7.0),
    ("-(2 + 3) * -#{bbbbbbbbbbb.ccccccccccc}", 10.0),
    ("#{aaaaaaaaaaa} / #{ddddddddddd}", None),
    ("#{aaaaaaaaaaa} + #{eeeeeeeeeee}", None),
]


@pytest.mark.parametrize("raw, want", SIDES)
def test_sides_by_expression_and_by_steps(spark, raw, want):
    d = spark.createDataFrame([({"aaaaaaaaaaa": 6.0, "bbbbbbbbbbb_ccccccccccc": 2.0, "ddddddddddd": 0.0},)], "vals map<string,double>")
    rule = spark.createDataFrame([("r", "n", "equal_to", raw, raw)], "id string, name string, operator string, left_raw string, right_raw string")
    both = consistency.with_steps(rule).crossJoin(d)
    by_form = consistency.side_value(F.col("left_steps"), F.col("left_form"), F.col("vals"))
    by_steps = consistency.stack_value(F.col("left_steps"), F.col("vals"))
    for got in both.select(by_form, by_steps).first():
        assert got == (want if want is None else pytest.approx(want))
    nothing = F.lit(None).cast("map<string,double>")
    empty = both.select(consistency.side_value(F.col("left_steps"), F.col("left_form"), nothing)).first()
    assert ("#" in raw) == (empty[0] is None)


@pytest.mark.parametrize("raw", [None, " ", "max(#{aaaaaaaaaaa})", "#{aaaaaaaaaaa} * / 2", "(#{aaaaaaaaaaa}", "1 2", "#{short}", "1)", "()", "# 1", "1 (2)"])
def test_unreadable_sides(spark, raw):
    assert spark.range(1).select(consistency.side_steps(F.lit(raw).cast("string"))).first()[0] is None


def test_linear_forms(spark):
    form = lambda raw: spark.range(1).select(consistency.linear_form(consistency.side_steps(F.lit(raw))).alias("f")).first().f
    f = form("3 * (#{aaaaaaaaaaa} - 2 * -#{bbbbbbbbbbb.ccccccccccc}) - (1 - #{aaaaaaaaaaa})")
    assert f.const == -1 and [(t.coef, t.ref) for t in f.terms] == [(3, "aaaaaaaaaaa"), (6, "bbbbbbbbbbb_ccccccccccc"), (1, "aaaaaaaaaaa")]
    assert form("#{aaaaaaaaaaa} * #{bbbbbbbbbbb}") is None and form("#{aaaaaaaaaaa} / 2") is None


def test_one_unreadable_rule_leaves_the_others(spark):
    facts = spark.createDataFrame(
        [("u1", "U1", 6.0, "aaaaaaaaaaa"), ("u1", "U1", 2.0, "bbbbbbbbbbb"), ("u2", "U2", 1.0, "aaaaaaaaaaa")],
        "orgUnit string, orgUnitName string, original double, data_id string",
    ).withColumns({"Month": F.lit("2021-03-01").cast("date"), "effectiveLeaf": F.lit(True)})
    rules = spark.createDataFrame(
        [
            ("nested", "n", "greater_than", "#{aaaaaaaaaaa}", "#{bbbbbbbbbbb} / (1 / #{bbbbbbbbbbb})"),
            ("broken", "n", "compulsory_pair", "#{aaaaaaaaaaa} * / 2", "#{bbbbbbbbbbb}"),
            ("pair", "n", "compulsory_pair", "#{aaaaaaaaaaa}", "#{bbbbbbbbbbb}"),
            ("absent", "n", "equal_to", "#{aaaaaaaaaaa}", "#{zzzzzzzzzzz}"),
            ("both", "n", "compulsory_pair", "#{bbbbbbbbbbb}", "#{bbbbbbbbbbb}"),
        ],
        "id string, name string, operator string, left_raw string, right_raw string",
    )
    got = {r.rule_id: (r.incomplete, r.n_evaluated, r.n_passed, r.n_failed) for r in consistency.evaluate_rules(facts, rules).collect()}
    assert got == {"nested": (False, 1, 1, 0), "broken": (True, 0, 0, 0), "pair": (False, 2, 1, 1), "absent": (True, 0, 0, 0), "both": (False, 2, 2, 0)}
    broken = consistency.rule_detail(facts, rules, "broken").collect()
    assert [r.result for r in broken] == ["Incomplete", "Incomplete"]


def test_descendants_of_a_deep_tree(spark):
    units = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(20)] + [("n3", "n19")], "name string, parentName string")
    assert conform.descendants(units, " N2 ").count() == 17


# -- totals, forecast, burden -----------------------------------------------------------------


def test_hierarchy_sets():
    assert totals.hierarchy_sets("a / b") == [(), ("a",), ("a", "b")]
    assert totals.hierarchy_sets("x * a / b") == [(), ("a",), ("a", "b"), ("x",), ("x", "a"), ("x", "a", "b")]


def test_failed_models_are_reported_not_raised(spark):
    d = series(spark, flat(8)).select("orgUnit", "Month", F.col("original").alias("total"))
    fits = forecast.fit_forecast(d, ["orgUnit"], "2020-09-01", 3)
    state = {r.model: r.status for r in fits.select("model", "status").distinct().collect()}
    assert state["e"] != "ok" and state["s"] != "ok"
    assert forecast.fitted_only(fits, ["orgUnit"]).filter("mean IS NULL").count() == 0


def test_trend_season_recovers_an_exact_series(spark):
    v = [100 + 2 * i + 10 * (i % 12) for i in range(48)]
    d = series(spark, v).select("orgUnit", "Month", F.col("original").alias("total"))
    got = forecast.fit_forecast(d, ["orgUnit"], month(36), 12, models=("t",)).orderBy("Month").toPandas()
    assert np.allclose(got["mean"], v[36:], atol=1.0)


@pytest.mark.parametrize("gap", [[], [30], [30, 47], [0, 13, 44, 45, 46]])
def test_models_keep_their_months_over_gaps(spark, gap):
    level = [100.0 + 10 * (i % 12) for i in range(48)]
    values = [None if i in gap else v for i, v in enumerate(level)]
    d = series(spark, values).select("orgUnit", "Month", F.col("original").cast("double").alias("total"))
    for rows in (d, d.filter("total IS NOT NULL")):
        got = forecast.fit_forecast(rows, ["orgUnit"], month(48), 12).toPandas()
        assert (got.status == "ok").all()
        for m in "aest":
            assert np.allclose(got[got.model == m].sort_values("Month")["mean"], level[:12], atol=3.0 if m == "e" else 1e-6)


def test_density_interval(spark):
    x = [float(i) for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 50)]
    d = spark.createDataFrame([("m", v) for v in x], "model string, v double")
    r = forecast.density_interval(d, "v", ["model"], 0.8).first()
    assert (r.hdi_lower, r.hdi_upper) == (0.0, 8.0)


def burden_rows(spark):
    rows = []
    for u in range(20):
        region, champ = ("N", "S")[u % 2], u % 4 != 3
        for m in range(24):
            value = None if (u % 5 == 0 and m % 6 == 5) else float(50 + 5 * u + m)
            for d in ("c", "t", "a"):
                scale = {"c": 1, "t": 2, "a": 4}[d]
                rows.append((f"u{u}", month(m), d, None if value is None else scale * value, "Champion" if champ else "Non-Champion", region))
    return spark.createDataFrame(rows, "orgUnit string, Month date, data string, value double, Selected string, region string")


def test_burden_regions_add_up_and_intervals_are_ordered(spark):
    d = burden_rows(spark)
    out = burden.run_methods(d, ["c"], "region", attendance=["a"], tested=["t"], n_draws=60, run_d=True).toPandas()
    assert {"A", "B", "C1", "C2", "CA", "E", "D:A"} <= set(out.method)
    assert ((out.lower <= out.estimate) & (out.estimate <= out.upper)).all()
    for m in ("A", "B", "C1", "C2", "CA"):
        part = out[out.method == m]
        sub, nat = part[part.level == "subnational"].estimate.sum(), part[part.level == "national"].estimate.sum()
        assert abs(sub - nat) <= 2
    seen = d.filter("data = 'c'").agg(F.sum("value")).first()[0]
    for m in ("C1", "C2", "CA"):
        assert out[(out.method == m) & (out.level == "national")].estimate.iloc[0] >= seen


# -- sources ----------------------------------------------------------------------------------------


def test_facts_round_trip(spark, tmp_path):
    d = series(spark, flat(30))
    tables.write_facts(d, str(tmp_path / "facts"))
    back = tables.read_facts(spark, str(tmp_path / "facts"))
    assert back.count() == 30 and column(back, "original") == column(d, "original")


def test_rainfall_and_master_sinks(spark, tmp_path):
    r = spark.createDataFrame([("a", 2020, 1, 3.0, 2), ("a", 2021, 1, 4.0, 2)], "id string, year int, month int, mean_rain double, level int")
    tables.write_rainfall(r, str(tmp_path / "rain"))
    assert tables.read_rainfall(spark, [str(tmp_path / "rain"), str(tmp_path / "rain")]).count() == 2
    m = spark.createDataFrame([("z", "p", 1.0, 2.0)], "facility_name string, parent_name string, latitude double, longitude double")
    tables.write_facility_master(m, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().facility_name == "z"


def test_refresh_replaces_only_fetched_periods(spark):
    cols = "dataElement string, categoryOptionCombo string, orgUnit string, period string, COUNT int, SUM double"
    old = spark.createDataFrame([("e", "c", "u", "202001", 1, 1.0), ("e", "c", "u", "202002", 1, 2.0)], cols)
    new = spark.createDataFrame([("e", "c", "u", "202002", 1, 9.0), ("e", "c", "v", "202002", 0, 5.0)], cols)
    got = [(r.period, r.SUM) for r in refresh.merge_refresh(old, new).collect()]
    assert got == [("202001", "1.0"), ("202002", "9.0")]


def test_dedup_and_gaps(spark):
    d = series(spark, [1, 2, 3]).filter(F.col("original") != 2)
    twice = conform.dedup_series(d.unionByName(d), order_by=["original"])
    assert twice.count() == 2
    full = conform.fill_gaps(twice, ["orgUnit", "data_id"], carry=["dataElement"])
    assert column(full, "original") == [1.0, None, 3.0] and set(column(full, "dataElement")) == {"Cases"}


def test_shared_folder_comes_from_the_session(spark):
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    assert staging.settle(spark.range(5)).count() == 5
    assert staging.shared_folder(spark) == str(folder)
    assert any(p.name.startswith("fieldtally-") for p in folder.iterdir())


def test_trees_from_their_roots(spark):
    rows = [("r", "Root", None, 9), ("a", "A", "r", None), ("b", "B", "a", 1), ("o", "Orphan", "gone", 3), ("x", "X", "y", 2), ("y", "Y", "x", 2), (None, "N", "r", 2), ("b", "B", "a", 1)]
    units = spark.createDataFrame([(*r, True) for r in rows], "id string, name string, parent_id string, level int, leaf boolean")
    got = sorted((r.orgUnitName, r.Top, r.Mid, r.Low, r.level) for r in conform.flatten_tree(units, ["Top", "Mid", "Low"]).fillna("").collect())
    own = {("N", "N", "", "", 1), ("Orphan", "Orphan", "", "", 1), ("Root", "Root", "", "", 1), ("X", "X", "", "", 1), ("Y", "Y", "", "", 1)}
    assert set(got) == {("A", "Root", "A", "", 2), ("B", "Root", "A", "B", 3), *own} and len(got) == len(rows)
    assert conform.flatten_tree(units.limit(0), ["Top"]).count() == 0


def test_phantoms_and_descendants_by_recursion(spark):
    chain = [(str(i), f"n{i}", str(i - 1) if i else None) for i in range(7)] + [("7", "other", None)]
    units = spark.createDataFrame(chain, "id string, name string, parent_id string")
    assert {r.id for r in conform.drop_phantom_units(units, "n0", 2).collect()} == {"0", "4", "5", "6", "7"}
    named = units.selectExpr("name", "CASE WHEN parent_id IS NOT NULL THEN 'N' || parent_id || ' ' END AS parentName")
    assert {r.name for r in conform.descendants(named, "n4").collect()} == {"n5", "n6"}
    assert conform.descendants(named, "absent").count() == 0


def test_stored_extract_rewrites_only_changed_periods(spark, tmp_path):
    cols = "dataElement string, categoryOptionCombo string, orgUnit string, period string, COUNT int, SUM double"
    path = str(tmp_path / "extract")
    files = lambda: {f: f.stat().st_mtime_ns for f in pathlib.Path(path).rglob("rows/*/*/*.parquet")}
    rows = lambda g=None: sorted((r.period, r.orgUnit, r.SUM) for r in refresh.read_stored(spark, path, g).collect())
    old = [("e", "c", "u", f"20200{m}", 1, float(m)) for m in range(1, 6)] + [("e", "c", "u", "202001", 1, 1.0)]
    assert refresh.refresh_stored(path, spark.createDataFrame(old, cols)) == 0
    first = files()
    new = [("e", "c", "u", "202001", 1, 1.0)] * 2 + [("e", "c", "u", "202002", 1, 9.0), ("e", "c", "v", "202002", 0, 5.0), ("e", "c", "u", "202003", 0, 3.0), ("e", "c", "w", "202009", 1, 7.0)]
    assert refresh.refresh_stored(path, spark.createDataFrame(new, cols)) == 1
    want = [("202001", "u", "1.0")] * 2 + [("202002", "u", "9.0"), ("202004", "u", "4.0"), ("202005", "u", "5.0"), ("202009", "w", "7.0")]
    assert rows() == want
    assert first.items() <= files().items()
    assert {f.parent.name for f in files().keys() - first.keys()} == {"period=202002", "period=202009"}
    assert len(rows(0)) == 6  # a reader of the former generation still has it
    # A refresh that stopped before its index is not seen, and running it again mends it.
    refresh.raw_rows(spark.createDataFrame([("e", "c", "z", "202004", 1, 0.0)], cols)).write.partitionBy("period").parquet(f"{path}/rows/generation=2")
    assert rows() == want
    assert refresh.refresh_stored(path, spark.createDataFrame([("e", "c", "u", "202005", 1, 6.0)], cols)) == 2
    assert rows() == want[:4] + [("202005", "u", "6.0"), want[5]]
    assert refresh.refresh_stored(path, spark.createDataFrame([], cols)) == 3 and len(rows()) == 6


def test_draws_are_dealt_to_many_tasks(spark):
    # A short table in one file, as pools and gaps are: its draws must not be one task.
    units = spark.range(3000).select(F.concat(F.lit("F"), "id").alias("orgUnit")).coalesce(1)
    drawn = burden.each_draw(units, 1000)
    per_task = [r.n for r in drawn.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(per_task) == 3_000_000 and max(per_task) <= 2 * burden.TASK_DRAWS
    assert drawn.groupBy("orgUnit").agg(F.countDistinct("draw").alias("n"), F.min("draw").alias("a"), F.max("draw").alias("b")).where("n <> 1000 OR a <> 1 OR b <> 1000").count() == 0


def test_pool_draws_against_a_plain_sum(spark):
    pools = [("p", "c", f"F{i}", float(i * i)) for i in range(40)] + [("q", "c", "F1", 7.0)]
    wanted = [("p", "c", "X", f"U{i}") for i in range(25)] + [("q", "c", "Y", "U1"), ("none", "c", "Y", "U2")]
    got = burden.pool_draws(
        spark.createDataFrame(wanted, "pool string, category string, region string, orgUnit string"),
        spark.createDataFrame(pools, "pool string, category string, orgUnit string, total double"), 120, "A", 1,
    )
    order = sorted((u for p, _, u, _ in pools if p == "p"), key=lambda u: (hashlib.md5(u.encode()).hexdigest()[:2], u))
    total = {u: t for p, _, u, t in pools if p == "p"}
    pick = lambda u, d: int(hashlib.md5(f"1|A|{u}|c|{d}".encode()).hexdigest()[:8], 16)
    want = {("X", d): sum(total[order[pick(f"U{i}", d) % 40]] for i in range(25)) for d in range(1, 121)} | {("Y", d): 7.0 for d in range(1, 121)}
    assert {(r.region, r.draw): r.drawn for r in got.collect()} == want


def test_lines_against_plain_weighted_regression(spark):
    # Gaps, repeated periods, missing values; a row per value near must not be folded one by one.
    rng = np.random.default_rng(4)
    t = np.sort(rng.choice(60, 45, replace=False)).tolist() + [7, 7]
    rows = [("a", i, None if rng.random() < 0.1 else float(rng.normal()), float(rng.random())) for i in t] + [("b", 3, 2.0, 0.5), ("c", 1, None, 1.0), ("a", None, 9.0, 1.0), ("a", None, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, _t int, v double, _weight double")
    got = seasonal_models._with_line(df, "line", F.col("v"), ["k"], 9)
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for k, i, *_ in rows:
        near = [(j - i, v, w * (1 - abs((j - i) / 10) ** 3) ** 3) for q, j, v, w in rows if q == k and None not in (i, j) and abs(j - i) <= 9 and v is not None]
        if len({d for d, *_ in near}) > 1:
            x, y, w = map(np.array, zip(*near))
            want[k, i] = np.polynomial.polynomial.polyfit(x, y, 1, w=np.sqrt(w))[0]
        else:
            want[k, i] = near[0][1] if near else None
    for r in got.collect():
        assert r.line == (want[r.k, r._t] if want[r.k, r._t] is None else pytest.approx(want[r.k, r._t], abs=1e-8))


def test_facts_read_their_table_once(spark, tmp_path):
    from fieldtally.plans import fixtures as fx

    lines = "l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double, l_shipdate timestamp"
    day = dt.datetime(1996, 3, 5)
    rows = [(1, "A", "F", 3.0, day), (1, "A", "F", 4.0, day), (1, "R", None, 9.0, day), (None, "A", "F", 2.0, day)]
    spark.createDataFrame(rows, lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "one", 1)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, "n", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(1, "r")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    facts = fx.fact(spark, str(tmp_path))
    got = {(r.orgUnit, r.data, r.data_id, r.orgUnitName) for r in facts.collect()}
    assert got == {
        ("F1", "Cases A_F", "deA00000001_ccF00000001", "one"),
        ("F1", None, None, "one"),
        ("F1", "Stock out days", "deS00000001", "one"),
        (None, "Cases A_F", "deA00000001_ccF00000001", None),
        (None, "Stock out days", "deS00000001", None),
    }
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate#") and plan.count("Relation [l_") == 1


def test_values_meet_rules_without_a_shuffle_by_element(spark):
    facts = spark.createDataFrame(
        [("a", "a", dt.date(2020, 1, 1), "deX00000001", 2.0, True), ("a", "a", dt.date(2020, 1, 1), "deY00000001", 1.0, True)],
        "orgUnit string, orgUnitName string, Month date, data_id string, original double, effectiveLeaf boolean",
    )
    rules = spark.createDataFrame(
        [("r", "r", "greater_than", "#{deX00000001}", "#{deY00000001}")], "id string, name string, operator string, left_raw string, right_raw string"
    )
    values = consistency.rule_values(facts, rules)
    assert {(r.ref, r.v) for r in values.collect()} == {("deX00000001", 2.0), ("deY00000001", 1.0)}
    plan = values._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins), joins
    done = consistency.evaluate_rules(facts, rules)
    assert [(r.n_evaluated, r.n_passed) for r in done.collect()] == [(1, 1)]
    assert "_salt" not in done._jdf.queryExecution().executedPlan().toString()


def test_values_are_counted_before_they_are_printed(spark):
    rows = [("e", 1234.0)] * 9 + [("e", float(2000 + i)) for i in range(8)] + [("e", 5.0)] * 30
    df = spark.createDataFrame(rows, "dataElement string, original double").withColumn("effectiveLeaf", F.lit(True))
    found = outliers.key_entry_values(df)
    assert [(r.dataElement, r.original) for r in found.collect()] == [("e", 1234.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("length(") < plan.index("count(1) AS n")

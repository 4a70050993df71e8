"""Champions by period words against counting dates, for months, weeks and days."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from fieldtally.operators import reporting

SERIES = ["a_x", "a_y", "b_x"]
SETTINGS = [
    dict(setting="any"),
    dict(setting="any2", missing_reports=2, start="2020-03-03", end="2021-10-05"),
    dict(setting="sel", reporting_rule="any_selected", categories=["a_x", "zz"], missing_reports=3),
    dict(setting="cat", reporting_rule="all_categories", categories=["a_x", "b_x"], missing_reports=4, end="2021-12-31"),
    dict(setting="gone", reporting_rule="all_categories", categories=["a_x", "zz"], missing_reports=60),
    dict(setting="el", reporting_rule="all_elements", categories=SERIES, missing_reports=2, start="2020-06-29"),
    dict(setting="none", start="2031-01-01"),
]
STEP = {"Month": 30.5, "Week": 7, "Day": 1}


def calendar(period):
    first = {"Month": dt.date(2019, 12, 1), "Week": dt.date(2019, 12, 30), "Day": dt.date(2019, 12, 30)}[period]
    if period == "Month":
        return [dt.date(2019 + (11 + i) // 12, (11 + i) % 12 + 1, 1) for i in range(28)]
    return [first + dt.timedelta(days=int(STEP[period]) * i) for i in range(118 if period == "Week" else 800)]


def plain(rows, s):
    cats, rule = s.get("categories"), s.get("reporting_rule", "any_data")
    lo, hi = s.get("start", "0001-01-01"), s.get("end", "9999-12-31")
    unit = (lambda d: "") if rule in ("any_data", "any_selected") else (lambda d: d) if rule == "all_categories" else (lambda d: d.split("_")[0])
    rows = [(u, unit(d), p) for u, d, p, v in rows if v is not None and lo <= str(p) <= hi and (rule == "any_data" or d in cats)]
    needed = len(set(cats)) if rule == "all_categories" else len({x for _, x, _ in rows}) if rule == "all_elements" else 1
    units, seen = defaultdict(set), defaultdict(set)
    for u, x, p in rows:
        units[u, p].add(x)
        seen[p.year].add(p)
    reports = defaultdict(int)
    for (u, p), have in units.items():
        reports[u, p.year] += len(have) >= needed
    facilities = {u for u, _, _ in rows}
    return {u for u in facilities if all(reports[u, y] > 0 and reports[u, y] >= len(ps) - s.get("missing_reports", 0) for y, ps in seen.items())}


@pytest.mark.parametrize("period", ["Month", "Week", "Day"])
def test_champions_against_counting(spark, period):
    rng = random.Random(len(period))
    rows = []
    for u in range(12):
        lost = rng.choice([0, 0.02, 0.05, 0.3])
        rows += [(f"F{u}", d, p, None if rng.random() < 0.05 * lost else 1.0) for p in calendar(period) for d in SERIES if rng.random() >= lost]
    rows += [("F99", "a_x", None, 1.0), rows[0]]
    df = spark.createDataFrame(rows, f"orgUnit string, data string, `{period}` date, original double")
    rows = [r for r in rows if r[2]]
    got = defaultdict(set)
    for r in reporting.champion_grid(df, SETTINGS, period).collect():
        got[r.setting].add(r.orgUnit)
    for s in SETTINGS:
        assert got[s["setting"]] == plain(rows, s), s
    assert any(got.values())
    one = reporting.champions(df, "2020-03-03", "2021-10-05", 2, period=period)
    assert {r.orgUnit for r in one.collect()} == got["any2"]

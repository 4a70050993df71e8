"""Validation rules between series, and predictability of a dataset."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.joins import by_facility
from ..functions.periods import period_column

# Comparison names of rules.
COMPARISONS = {
    "EQUAL_TO": lambda a, b: a == b,
    "NOT_EQUAL": lambda a, b: a != b,
    "LESS_THAN": lambda a, b: a < b,
    "GREATER_THAN": lambda a, b: a > b,
    "LESS_THAN_OR_EQUAL_TO": lambda a, b: a <= b,
    "GREATER_THAN_OR_EQUAL_TO": lambda a, b: a >= b,
}
PAIR = "COMPULSORY_PAIR"

# Pieces of a side: references, numbers, signs, and any other character, which cannot be read.
_PIECE = r"#\{" + text.UID + r"(?:\." + text.UID + r")?\}|[0-9]+(?:\.[0-9]*)?|\.[0-9]+|\S"
# Steps of a side in the order in which they are evaluated, and what a linear side comes to.
_STEPS = "array<struct<op:string,num:double,ref:string>>"
_TERMS = "array<struct<coef:double,ref:string>>"
_FORM = f"struct<const:double,terms:{_TERMS},ok:boolean>"


def holds(left: Column, right: Column, operator: str) -> Column:
    """Does a rule hold? NULL when a side is missing, except that a
    compulsory pair asks for both sides or neither."""
    name = operator.upper()
    if name == PAIR:
        return left.isNull() == right.isNull()
    if name not in COMPARISONS:
        return F.lit(None).cast("boolean")
    return COMPARISONS[name](left, right)


def holds_by_name(left: Column, right: Column, operator: Column) -> Column:
    """The same with the operator in a column."""
    out = F.when(F.upper(operator) == PAIR, holds(left, right, PAIR))
    for name in COMPARISONS:
        out = out.when(F.upper(operator) == name, holds(left, right, name))
    return out


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _state(out: Column, held: Column, expects: Column, ok: Column) -> Column:
    return F.struct(out.alias("out"), held.alias("held"), expects.alias("expects"), ok.alias("ok"))


def _kept(held: Column, stays: Callable[[Column], Column]) -> Column:
    """How many held signs are left when the last ones go, down to one that stays."""
    return F.coalesce(F.array_max(F.transform(held, lambda op, i: F.when(stays(op), i + 1).otherwise(0))), F.lit(0))


def _as_steps(signs: Column) -> Column:
    none = F.lit(None)
    return F.transform(F.reverse(signs), lambda op: F.struct(op.alias("op"), none.cast("double").alias("num"), none.cast("string").alias("ref")))


def side_steps(raw: Column) -> Column:
    """One side of a rule as steps of a stack machine; NULL if it cannot be read.

    References, numbers, + - * /, signs and brackets are understood. One fold over the
    side's pieces: operands go out as they come, signs are held back until one
    that binds no tighter follows, and a closing bracket lets out all since its opening.
    """
    pieces = F.regexp_extract_all(raw, F.lit(_PIECE), F.lit(0))
    start = F.struct(
        F.expr(f"cast(array() as {_STEPS})").alias("out"),
        F.expr("cast(array() as array<string>)").alias("held"),
        F.lit(True).alias("expects"),
        F.lit(True).alias("ok"),
    )

    def step(state: Column, t: Column) -> Column:
        expects, held = state["expects"], state["held"]
        ref, num = t.startswith("#{"), t.rlike(r"^\.?[0-9]")
        operand = expects & (ref | num)
        prefix = expects & t.isin("-", "+", "(")
        joins = ~expects & t.isin("*", "/", "+", "-")
        closes = ~expects & (t == ")")
        one = F.array(
            F.struct(
                F.when(ref, "ref").otherwise("num").alias("op"),
                F.when(num, t.try_cast("double")).alias("num"),
                F.when(ref, F.translate(F.regexp_replace(t, r"[#{}]", ""), ".", "_")).alias("ref"),
            )
        )
        # Signs that go out before this piece: all that bind as tightly, down to a bracket.
        rank = lambda op: F.when(op == "(", 0).when(op.isin("+", "-"), 1).when(op.isin("*", "/"), 2).otherwise(3)
        least = F.when(joins, rank(t)).when(closes, 1).otherwise(4)
        none = F.expr("cast(array() as array<string>)")
        sign = F.when(expects & (t == "-"), F.array(F.lit("neg"))).when((prefix & (t == "(")) | joins, F.array(t)).otherwise(none)

        def moved(left: Column) -> Column:
            gone = _as_steps(F.slice(held, left + 1, F.size(held) - left))
            out = F.concat(state["out"], F.when(operand, one).otherwise(gone))
            kept = F.concat(F.slice(held, F.lit(1), F.greatest(left - F.when(closes, 1).otherwise(0), F.lit(0))), sign)
            ok = state["ok"] & (operand | prefix | joins | (closes & (left > 0)))
            return _state(out, kept, prefix | joins, ok)

        def bound(s: Column) -> Column:
            """Minus signs before an operand or a closed bracket bind tightest and follow it at once."""
            left = F.when(operand | closes, _kept(s["held"], lambda op: op != "neg")).otherwise(F.size(s["held"]))
            return _once(
                left,
                lambda n: _state(
                    F.concat(s["out"], _as_steps(F.slice(s["held"], n + 1, F.size(s["held"]) - n))),
                    F.slice(s["held"], F.lit(1), n),
                    s["expects"],
                    s["ok"],
                ),
            )

        stays = _kept(held, lambda op: rank(op) < least)
        return _once(_once(stays, moved), bound)

    def finish(state: Column) -> Column:
        whole = state["ok"] & ~state["expects"] & ~F.array_contains(state["held"], "(")
        return F.when(whole, F.concat(state["out"], _as_steps(state["held"])))

    return F.aggregate(pieces, start, step, finish)


def linear_form(steps: Column) -> Column:
    """Steps as a constant and terms of coefficient and reference; NULL where values are
    multiplied by each other or divided.

    Terms stay in order and apart, so that a value that is missing makes the side
    missing, and sums are added up as they are written.
    """
    form = F.expr(f"cast(array() as array<{_FORM}>)")
    none = F.expr(f"cast(array() as {_TERMS})")

    def made(const: Column, terms: Column, ok: Column) -> Column:
        return F.struct(const.cast("double").alias("const"), terms.alias("terms"), ok.alias("ok"))

    def scaled(terms: Column, by: Column) -> Column:
        return F.transform(terms, lambda x: F.struct((x["coef"] * by).alias("coef"), x["ref"].alias("ref")))

    def step(stack: Column, t: Column) -> Column:
        b, a = F.get(stack, F.size(stack) - 1), F.get(stack, F.size(stack) - 2)
        plain_a, plain_b = F.size(a["terms"]) == 0, F.size(b["terms"]) == 0
        one = F.array(F.struct(F.lit(1.0).alias("coef"), t["ref"].alias("ref")))
        value = (
            F.when(t["op"] == "num", made(t["num"], none, F.lit(True)))
            .when(t["op"] == "ref", made(F.lit(0.0), one, F.lit(True)))
            .when(t["op"] == "neg", made(-b["const"], scaled(b["terms"], F.lit(-1.0)), b["ok"]))
            .when(t["op"] == "+", made(a["const"] + b["const"], F.concat(a["terms"], b["terms"]), a["ok"] & b["ok"]))
            .when(t["op"] == "-", made(a["const"] - b["const"], F.concat(a["terms"], scaled(b["terms"], F.lit(-1.0))), a["ok"] & b["ok"]))
            .when(
                t["op"] == "*",
                made(
                    a["const"] * b["const"],
                    F.when(plain_b, scaled(a["terms"], b["const"])).otherwise(scaled(b["terms"], a["const"])),
                    a["ok"] & b["ok"] & (plain_a | plain_b),
                ),
            )
            .otherwise(made(F.lit(0.0), none, F.lit(False)))
        )
        used = F.when(t["op"].isin("num", "ref"), 0).when(t["op"] == "neg", 1).otherwise(2)
        return F.concat(F.slice(stack, F.lit(1), F.size(stack) - used), F.array(value))

    last = F.get(F.aggregate(steps, form, step), F.lit(0))
    return F.when(last["ok"], F.struct(last["const"].alias("const"), last["terms"].alias("terms")))


_APPLY = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b),
}


def side_value(steps: Column, form: Column, values: Column) -> Column:
    """One side of a rule over a map of values by id; NULL if the side cannot be read, a
    value is missing or a divisor is zero. Linear sides are one sum of products."""
    add = lambda s, x: s + x["coef"] * F.try_element_at(values, x["ref"])
    return F.when(form.isNotNull(), F.aggregate(form["terms"], form["const"], add)).otherwise(stack_value(steps, values))


def stack_value(steps: Column, values: Column) -> Column:
    """The same by the steps."""
    empty = F.expr("cast(array() as array<double>)")

    def step(stack: Column, t: Column) -> Column:
        last, before = F.get(stack, F.size(stack) - 1), F.get(stack, F.size(stack) - 2)
        value = F.when(t["op"] == "num", t["num"]).when(t["op"] == "ref", F.try_element_at(values, t["ref"])).when(t["op"] == "neg", -last)
        for op, apply in _APPLY.items():
            value = value.when(t["op"] == op, apply(before, last))
        used = F.when(t["op"].isin("num", "ref"), 0).when(t["op"] == "neg", 1).otherwise(2)
        return F.concat(F.slice(stack, F.lit(1), F.size(stack) - used), F.array(value.cast("double")))

    return F.get(F.aggregate(steps, empty, step), F.lit(0))


def with_steps(rules: DataFrame) -> DataFrame:
    """Rules with the steps and linear forms of both sides; the rule table is metadata, one row per rule."""
    out = rules.select("id", "name", "operator", "left_raw", "right_raw")
    out = out.withColumns({f"{side}_steps": side_steps(F.col(f"{side}_raw")) for side in ("left", "right")})
    return out.withColumns({f"{side}_form": linear_form(F.col(f"{side}_steps")) for side in ("left", "right")})


def rule_ids(rules: DataFrame) -> DataFrame:
    """Ids each rule needs: ``id`` of the rule and ``ref``."""
    refs = F.array_distinct(F.concat(text.uid_pairs(F.col("left_raw")), text.uid_pairs(F.col("right_raw"))))
    return rules.select("id", F.explode(refs).alias("ref"))


def rule_values(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Value per facility, period and id for the elements that rules mention.

    Effective leaves only; known values are summed per id. An element that
    never occurs without a category also gets the sum of its categories. The ids come from
    the rules, a table of metadata, and go to every task; values stay with their facility.
    """
    period = period_column(facts)
    wanted = rule_ids(rules).select(text.element_uid(F.col("ref")).alias("uid")).distinct()
    uid, data_id = F.col("uid"), F.col("data_id")
    refs = F.array_compact(
        F.array(
            F.struct(data_id.alias("ref"), F.lit(False).alias("summed")),
            F.when(data_id != uid, F.struct(uid.alias("ref"), F.lit(True).alias("summed"))),
        )
    )
    sums = (
        facts.filter(F.col("effectiveLeaf") & F.col("original").isNotNull())
        .withColumn("uid", text.element_uid(data_id))
        .join(F.broadcast(wanted), "uid", "left_semi")
        .transform(by_facility)
        .select("orgUnit", "orgUnitName", period, "original", F.explode(refs).alias("r"))
        .groupBy("orgUnit", "orgUnitName", period, F.col("r.ref").alias("ref"), F.col("r.summed").alias("summed"))
        .agg(F.sum("original").alias("v"))
    )
    # The condition names the sum, so it stays above the aggregation and both uses read one shuffle.
    own = F.when(F.col("v").isNotNull(), ~F.col("summed") & ~F.col("ref").contains("_"))
    bare = sums.filter(own).select("ref", F.lit(True).alias("summed")).distinct()
    return sums.join(F.broadcast(bare), ["ref", "summed"], "left_anti").select("orgUnit", "orgUnitName", period, "ref", "v")


def value_maps(values: DataFrame) -> DataFrame:
    """One row per facility and period with a map from id to value; its size
    is bounded by the number of ids that rules use."""
    period = period_column(values)
    entries = F.map_from_entries(F.collect_list(F.struct("ref", "v")))
    return values.groupBy("orgUnit", "orgUnitName", period).agg(entries.alias("vals"))


def rules_for(rules: DataFrame, data_ids: list[str] | None) -> DataFrame:
    """Rules that mention an element of the given series ids."""
    if not data_ids:
        return rules
    pattern = "|".join(sorted({re.escape(d.split("_")[0]) for d in data_ids}))
    return rules.filter(F.col("left_raw").rlike(pattern) | F.col("right_raw").rlike(pattern))


def incomplete_rules(rules: DataFrame, values: DataFrame) -> DataFrame:
    """Rules that need ids absent from the data, with those ids."""
    present = values.groupBy("ref").agg(F.count("v").alias("_n")).filter("_n > 0").select("ref")
    return (
        rule_ids(rules)
        .join(present, "ref", "left_anti")
        .groupBy("id")
        .agg(F.array_join(F.array_sort(F.collect_set("ref")), ", ").alias("missing"))
    )


def _coefficients() -> Column:
    """The terms of both sides as coefficients of a reference on the left and on the right."""
    no = F.lit(None).cast("double")
    left = F.transform("left_form.terms", lambda x: F.struct(x["ref"].alias("ref"), x["coef"].alias("left"), no.alias("right")))
    right = F.transform("right_form.terms", lambda x: F.struct(x["ref"].alias("ref"), no.alias("left"), x["coef"].alias("right")))
    return F.concat(left, right)


def _linear_needs(side: str) -> list[Column]:
    """The constant of a linear side and the number of values it needs."""
    refs = F.transform(f"{side}_form.terms", lambda x: x["ref"])
    return [F.col(f"{side}_form.const").alias(f"const_{side[0]}"), F.size(F.array_distinct(refs)).alias(f"need_{side[0]}")]


def evaluate_rules(facts: DataFrame, rules: DataFrame, data_ids: list[str] | None = None) -> DataFrame:
    """Counts of evaluated, passed and failed facility-periods per rule and year.

    Values meet the rules that mention them where their facility is: the rules go to
    every task. Linear rules are sums of products
    (added up in no fixed order, which matters to the last digit of three terms or more); rules that
    multiply or divide values are evaluated on the few values they need. Facility-
    periods with none of them all have the outcome of a rule without values
    (a compulsory pair holds) and are only counted. A rule that cannot be read, or
    needs ids that the data lack, is incomplete; others are not affected.
    """
    rules = rules_for(rules, data_ids)
    values = rule_values(facts, rules)
    period = period_column(values)
    unit = ["orgUnit", "orgUnitName", period]
    read = with_steps(rules)
    linear = F.col("left_form").isNotNull() & F.col("right_form").isNotNull()

    # Linear rules: sums of products by rule, facility and period.
    terms = read.filter(linear).select("id", F.explode(_coefficients()).alias("t")).groupBy("id", "t.ref")
    terms = terms.agg(F.sum("t.left").alias("cl"), F.sum("t.right").alias("cr")).select("id", "ref", "cl", "cr")
    sums = values.join(F.broadcast(terms), "ref").groupBy("id", *unit)
    sums = sums.agg(*[f(x).alias(f"{n}{side}") for side in "lr" for n, f, x in (("s", F.sum, F.col(f"c{side}") * F.col("v")), ("n", F.count, f"c{side}"))])
    needs = read.filter(linear).select("id", "operator", *[c for side in ("left", "right") for c in _linear_needs(side)])
    side = lambda x: F.when(F.col(f"n{x}") == F.col(f"need_{x}"), F.col(f"const_{x}") + F.coalesce(f"s{x}", F.lit(0.0)))
    by_sums = sums.join(F.broadcast(needs), "id").select("id", F.year(period).alias("year"), holds_by_name(side("l"), side("r"), F.col("operator")).alias("pass"))

    # The others: the steps over the few values that a rule needs.
    others = read.filter(~linear & F.col("left_steps").isNotNull() & F.col("right_steps").isNotNull())
    met = values.join(F.broadcast(rule_ids(others)), "ref").groupBy("id", *unit)
    met = met.agg(F.map_from_entries(F.collect_list(F.struct("ref", "v"))).alias("vals"))

    def outcome(vals: Column) -> Column:
        left, right = (side_value(F.col(f"{side}_steps"), F.col(f"{side}_form"), vals) for side in ("left", "right"))
        return holds_by_name(left, right, F.col("operator"))

    by_steps = met.join(F.broadcast(others.select("id", "operator", "left_steps", "right_steps", "left_form", "right_form")), "id").select(
        "id", F.year(period).alias("year"), outcome(F.col("vals")).alias("pass")
    )
    decided = by_sums.unionByName(by_steps)
    counts = decided.groupBy("id", "year").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if("pass").alias("p"), F.count_if(~F.col("pass")).alias("f")
    )
    units = values.groupBy(*unit).agg(F.count("v").alias("_n")).filter("_n > 0").groupBy(F.year(period).alias("year")).agg(F.count(F.lit(1)).alias("all"))
    totals = units.agg(F.map_from_entries(F.collect_list(F.struct("year", "all")))).scalar()
    without = outcome(F.create_map().cast("map<string,double>"))
    frame = read.select(
        "id",
        "name",
        without.alias("_without"),
        (F.col("left_steps").isNull() | F.col("right_steps").isNull()).alias("_unread"),
        F.explode(totals).alias("year", "all"),
    )
    gaps = incomplete_rules(rules, values).select("id", F.lit(True).alias("_gap"))
    missing = F.coalesce("_gap", "_unread")
    rest = F.col("all") - F.coalesce("seen", F.lit(0))
    passed = F.coalesce("p", F.lit(0)) + F.when(F.col("_without"), rest).otherwise(0)
    failed = F.coalesce("f", F.lit(0)) + F.when(~F.col("_without"), rest).otherwise(0)
    count = lambda c: F.when(missing, 0).otherwise(c).cast("long")
    return (
        frame.join(counts, ["id", "year"], "left")
        .join(gaps, "id", "left")
        .select(
            F.col("id").alias("rule_id"),
            F.col("name").alias("rule_name"),
            "year",
            missing.alias("incomplete"),
            count(passed + failed).alias("n_evaluated"),
            count(passed).alias("n_passed"),
            count(failed).alias("n_failed"),
        )
    )


def annual_pass_rate(results: DataFrame) -> DataFrame:
    return (
        results.filter(~F.col("incomplete"))
        .groupBy("year")
        .agg(F.sum("n_evaluated").alias("n_evaluated"), F.sum("n_passed").alias("n_passed"))
        .withColumn("pct_passed", F.try_divide("n_passed", "n_evaluated"))
    )


def rule_table(results: DataFrame) -> DataFrame:
    """Status, counts and percent passed per rule, lowest first."""
    return (
        results.groupBy("rule_id", "rule_name")
        .agg(
            F.when(F.bool_or("incomplete"), "Incomplete (missing elements)").otherwise("Evaluated").alias("status"),
            F.sum("n_evaluated").alias("facility_periods"),
            F.sum("n_passed").alias("passed"),
            F.sum("n_failed").alias("failed"),
        )
        .withColumn("pct_passed", F.round(F.try_divide("passed", "facility_periods") * 100, 1))
        .orderBy(F.asc_nulls_last("pct_passed"), "rule_id")
    )


def rule_detail(facts: DataFrame, rules: DataFrame, rule_id: str, max_rows: int | None = None) -> DataFrame:
    """Facility-periods where one rule failed or could not be decided, newest
    first. ``n_total`` tells how many there are; a report may ask for the first
    ``max_rows`` only. A rule that cannot be read is undecided everywhere; one that is
    not among the rules has no rows."""
    one = rules.filter(F.col("id") == rule_id)
    values = rule_values(facts, one)
    period = period_column(values)
    read = with_steps(one).withColumn("_unread", F.col("left_steps").isNull() | F.col("right_steps").isNull())
    parts = ["operator", "left_steps", "right_steps", "left_form", "right_form", "_unread"]
    rule = read.agg(F.first(F.struct(*parts))).scalar()  # the id names one rule
    maps = value_maps(values).withColumn("_r", rule)
    for side in ("left", "right"):
        maps = maps.withColumn(f"{side}_side", side_value(F.col(f"_r.{side}_steps"), F.col(f"_r.{side}_form"), F.col("vals")))
    ok = F.when(~F.col("_r._unread"), holds_by_name(F.col("left_side"), F.col("right_side"), F.col("_r.operator")))
    bad = maps.withColumn("ok", ok).filter(~F.coalesce("ok", F.lit(False)))
    out = bad.select(
        "orgUnitName",
        period,
        F.year(period).alias("year"),
        "left_side",
        "right_side",
        F.when(F.col("ok").isNull(), "Incomplete").otherwise("Failed").alias("result"),
        bad.agg(F.count(F.lit(1))).scalar().alias("n_total"),
    ).orderBy(F.desc("year"), F.asc(period), "orgUnitName")
    return out if max_rows is None else out.limit(max_rows)


def yearly_predictability(df: DataFrame, blank_years: int = 2) -> DataFrame:
    """Weighted error of ``expected`` over all data up to each year.

    2 * sum|o - e| / (sum o + sum e); the first years are blank since their
    expectations rest on little data. Facilities count from the first year
    in which they have both values.
    """
    period = period_column(df)
    years = df.select(F.year(period).alias("Year")).distinct()
    both = df.filter(F.col("original").isNotNull() & F.col("expected").isNotNull()).withColumn("Year", F.year(period))
    sums = both.groupBy("Year").agg(
        F.sum(F.abs(F.col("original") - F.col("expected"))).alias("gap"),
        F.sum(F.col("original") + F.col("expected")).alias("size"),
    )
    fresh = both.groupBy("orgUnit").agg(F.min("Year").alias("Year")).groupBy("Year").agg(F.count(F.lit(1)).alias("new"))
    calendar = W.partitionBy(F.lit(1)).orderBy("Year")  # one row per year
    run = calendar.rowsBetween(W.unboundedPreceding, 0)
    n = F.sum(F.coalesce("new", F.lit(0))).over(run)
    size = F.coalesce(F.sum("size").over(run), F.lit(0.0))
    value = F.when(size > 0, 2 * F.sum("gap").over(run) / size)
    keep = F.row_number().over(calendar) > blank_years
    return (
        years.join(sums, "Year", "left")
        .join(fresh, "Year", "left")
        .select("Year", n.alias("Facilities"), F.when(keep, value).alias("swape"))
    )

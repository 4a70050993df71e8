"""Reporting completeness and facilities that report consistently.

A *champion* is a facility that, in every year of a window, reported in at
least as many periods as anyone did that year, less an allowance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats, text
from ..functions.flags import FLAG_ORDER, any_set, present
from ..functions.joins import lookup
from ..functions.periods import period_column

RULES = ("any_data", "any_selected", "all_elements", "all_categories")
UNKNOWN_REGION = "(Unknown)"


def within(df: DataFrame, period: str, start=None, end=None) -> DataFrame:
    """Rows inside a closed date window; either end may be open."""
    if start is not None:
        df = df.filter(F.col(period) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(period) <= F.lit(end).cast("date"))
    return df


SLOTS = 62  # periods in one word
# Periods of these lie so far apart that a slot of seven days holds one.
FIRST_DAYS = {"Month": lambda day: F.trunc(F.date_add(day, 6), "month"), "Week": lambda day: F.next_day(F.date_sub(day, 1), "Mon")}


def period_words(df: DataFrame, period: str) -> DataFrame:
    """orgUnit, data, year, part, word: one bit for each period of the year in which a facility reported a
    series. A year of months or weeks is one word, of days six."""
    slot = F.floor((F.dayofyear(period) - 1) / (7 if period in FIRST_DAYS else 1)).cast("int")
    rows = df.filter(F.col("original").isNotNull() & F.col(period).isNotNull())
    rows = rows.select("orgUnit", "data", F.year(period).alias("year"), slot.alias("_slot"))
    part = F.floor(F.col("_slot") / SLOTS).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_slot", F.lit(SLOTS)))
    return rows.groupBy("orgUnit", "data", "year", part.alias("part")).agg(F.bit_or(bit).alias("word"))


def _window_mask(period: str, start: Column, end: Column) -> Column:
    """The bits of a word (columns year, part) whose periods lie in a closed window."""

    def inside(slot: Column) -> Column:
        days = (F.col("part") * SLOTS + slot) * (7 if period in FIRST_DAYS else 1)
        day = F.date_add(F.make_date("year", F.lit(1), F.lit(1)), days)
        day = FIRST_DAYS[period](day) if period in FIRST_DAYS else day
        return F.when(day.between(start, end), F.call_function("shiftleft", F.lit(1).cast("long"), slot)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(SLOTS - 1)), F.lit(0).cast("long"), lambda mask, slot: mask.bitwiseOR(inside(slot)))


def _setting(s: dict) -> Column:
    cats = sorted(set(s.get("categories") or []))
    rule = s.get("reporting_rule", "any_data")
    if rule not in RULES:
        raise ValueError(f"reporting_rule must be one of {RULES}")
    rule = rule if cats else "any_data"
    return F.struct(
        F.lit(s["setting"]).alias("setting"),
        F.lit(str(s.get("start") or "0001-01-01")).cast("date").alias("s"),
        F.lit(str(s.get("end") or "9999-12-31")).cast("date").alias("e"),
        F.lit(int(s.get("missing_reports", 0))).alias("missing_reports"),
        F.lit(rule).alias("rule"),
        F.array(*[F.lit(c) for c in ([] if rule == "any_data" else cats)]).cast("array<string>").alias("cats"),
    )


def _unit(rule: Column) -> Column:
    """What has to have reported under a rule: each series, each element, or anything."""
    return F.when(rule == "all_categories", F.col("data")).when(rule == "all_elements", text.base_element(F.col("data"))).otherwise(F.lit(""))


def champion_grid(df: DataFrame, settings: list[dict], period: str | None = None) -> DataFrame:
    """Champions for many settings in one pass: ``setting``, ``orgUnit``.

    Each setting is a dict with ``setting`` (a label) and optional ``start``,
    ``end``, ``missing_reports``, ``reporting_rule`` and ``categories``. Facts become one bit
    set per facility, series and year; windows are masks on these, rules are AND and OR over
    series, reports are counted bits. The settings' calendars come from the words of all facilities,
    a table of series and years. Each setting is evaluated on words, and all facilities' words are
    shuffled once.
    """
    period = period or period_column(df)
    words = period_words(df, period)
    of = F.explode(F.array(*[_setting(s) for s in settings])).alias("p")
    chosen = (F.size("p.cats") == 0) | F.array_contains("p.cats", F.col("data"))
    seen = words.groupBy("data", "year", "part").agg(F.bit_or("word").alias("word")).select("*", of).filter(chosen)
    seen = seen.withColumn("word", F.col("word").bitwiseAND(_window_mask(period, F.col("p.s"), F.col("p.e")))).filter("word <> 0")
    seen = seen.select("p.setting", "p.missing_reports", "p.rule", "p.cats", "year", "part", "word", _unit(F.col("p.rule")).alias("unit"))
    setting = ["setting", "missing_reports", "rule", "cats"]
    masks = seen.groupBy(*setting, "year", "part").agg(F.bit_or("word").alias("mask"), F.collect_set("unit").alias("units"))
    calendar = masks.groupBy(*setting).agg(F.collect_list(F.struct("year", "part", "mask")).alias("masks"), F.size(F.array_distinct(F.flatten(F.collect_list("units")))).alias("units"))

    def of_year(y: Column) -> Column:
        mine = F.filter("masks", lambda m: m["year"] == y)
        periods = F.aggregate(mine, F.lit(0), lambda n, m: n + F.bit_count(m["mask"]))
        return F.struct(y, F.struct(periods.alias("periods"), F.map_from_entries(F.transform(mine, lambda m: F.struct(m["part"], m["mask"]))).alias("masks")))

    years = F.map_from_entries(F.transform(F.array_distinct(F.transform("masks", lambda m: m["year"])), of_year))
    needed = F.when(F.col("rule") == "all_categories", F.size("cats")).when(F.col("rule") == "all_elements", F.col("units")).otherwise(F.lit(1))
    plan = calendar.agg(F.collect_list(F.struct(*setting, needed.alias("needed"), years.alias("years")))).scalar()
    # Words of a facility meet once; all that follows is by facility.
    sent = words.repartition("orgUnit").select("*", F.explode(plan).alias("p")).filter(chosen)
    year = F.try_element_at("p.years", F.col("year"))
    mask = F.coalesce(F.try_element_at(year["masks"], F.col("part")), F.lit(0).cast("long"))
    sent = sent.withColumn("word", F.col("word").bitwiseAND(mask)).filter("word <> 0")
    key = ["orgUnit", "setting", "missing_reports", "needed", "n_years"]
    sent = sent.select("orgUnit", "p.setting", "p.missing_reports", "p.needed", F.size("p.years").alias("n_years"), "year", year["periods"].alias("periods"), "part", "word", _unit(F.col("p.rule")).alias("unit"))
    by_unit = sent.groupBy(*key, "year", "periods", "part", "unit").agg(F.bit_or("word").alias("word"))
    by_part = by_unit.groupBy(*key, "year", "periods", "part").agg(F.bit_and("word").alias("word"), F.count(F.lit(1)).alias("units")).filter("units >= needed")
    by_year = by_part.groupBy(*key, "year", "periods").agg(F.sum(F.bit_count("word")).alias("reports")).filter("reports > 0")
    whole = by_year.groupBy(*key).agg(F.count(F.lit(1)).alias("years"), F.bool_and(F.expr("reports >= periods - missing_reports")).alias("ok"))
    return whole.filter("ok AND years = n_years").select("setting", "orgUnit")


def champions(
    df: DataFrame,
    start=None,
    end=None,
    missing_reports: int = 0,
    reporting_rule: str = "any_data",
    categories: list[str] | None = None,
    period: str | None = None,
) -> DataFrame:
    """One column ``orgUnit``: facilities consistent in every year of the window."""
    one = dict(setting="", start=start, end=end, missing_reports=missing_reports, reporting_rule=reporting_rule, categories=categories)
    return champion_grid(df, [one], period).select("orgUnit")


def region_filter(df: DataFrame, level_cols: list[str], chosen: dict[str, list[str]]) -> DataFrame:
    """Keep rows inside the chosen units of each named level."""
    for level in level_cols:
        if chosen.get(level):
            df = df.filter(F.col(level).isin(list(chosen[level])))
    return df


def label_champions(df: DataFrame, champion_units: DataFrame) -> DataFrame:
    """Add ``Selected``: Champion or Non-Champion."""
    marks = champion_units.select("orgUnit", F.lit("Champion").alias("_mark"))
    return (
        df.join(marks, "orgUnit", "left")
        .withColumn("Selected", F.coalesce("_mark", F.lit("Non-Champion")))
        .drop("_mark")
    )


def select_data(
    df: DataFrame,
    level_cols: list[str],
    regions: dict[str, list[str]] | None = None,
    categories: list[str] | None = None,
    level: int | None = None,
    always_reporting: bool = True,
    champion_units: DataFrame | None = None,
    start=None,
    end=None,
    missing_reports: int = 0,
    reporting_rule: str = "any_data",
) -> DataFrame:
    """Filter by region, series and level, then label champions.

    Without ``champion_units`` the search runs on the filtered rows. A
    given ``start`` also drops earlier rows.
    """
    period = period_column(df)
    rows = region_filter(df, level_cols, regions or {})
    rows = rows.filter("effectiveLeaf") if level is None else rows.filter(F.col("level") == level)
    if categories:
        rows = rows.filter(F.col("data").isin(categories))
    if not always_reporting:
        return rows.withColumn("Selected", F.lit("All"))
    if champion_units is None:
        champion_units = champions(rows, start, end, missing_reports, reporting_rule, categories, period)
    out = label_champions(rows, champion_units)
    return within(out, period, start)


# -- counts of reports ---------------------------------------------------------


def periods_per_facility(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Distinct periods reported per facility and year."""
    period = period_column(df)
    rows = df.filter(F.col("data").isin(categories)) if categories else df
    return (
        rows.select("orgUnit", period)
        .distinct()
        .groupBy(F.year(period).alias("year"), "orgUnit")
        .agg(F.count(F.lit(1)).alias("n_periods"))
    )


def facilities_by_periods(reports: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Facilities per year and number of periods reported."""
    if units is not None:
        reports = reports.join(units, "orgUnit", "left_semi")
    return reports.groupBy("year", "n_periods").agg(F.count(F.lit(1)).alias("n"))


def facilities_per_period(df: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Facilities reporting in each period."""
    period = period_column(df)
    rows = df.select("orgUnit", period).distinct()
    if units is not None:
        rows = rows.join(units, "orgUnit", "left_semi")
    return rows.groupBy(F.year(period).alias("year"), period).agg(F.count(F.lit(1)).alias("n"))


def facilities_ever(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("orgUnit").alias("Total"))


def facilities_per_class(selected: DataFrame) -> DataFrame:
    return selected.groupBy("Selected").agg(F.countDistinct("orgUnit").alias("n"))


def typical_volume(selected: DataFrame, extra_cols: list[str] | None = None) -> DataFrame:
    """Median over periods of each facility's summed value."""
    period = period_column(selected)
    keys = ["orgUnit", *(extra_cols or [])]
    return (
        selected.groupBy(*keys, period)
        .agg(stats.sum0(F.col("dataCol")).alias("v"))
        .groupBy(*keys)
        .agg(F.median("v").alias("medianValue"))
    )


def volume_quartiles(volume: DataFrame, champion_units: DataFrame) -> DataFrame:
    """Champion label and quartile (1-4) of each facility's typical volume.

    Quartiles are right-closed like a cut at the quartile values; the
    smallest value falls outside and has no quartile.
    """
    qs = stats.exact_quantiles(
        volume, [], "medianValue", [0.0, 0.25, 0.5, 0.75, 1.0], ["q0", "q1", "q2", "q3", "q4"]
    ).select(F.array_sort(F.array_distinct(F.array("q0", "q1", "q2", "q3", "q4"))).alias("breaks"))
    breaks = qs.scalar()
    marks = champion_units.select("orgUnit", F.lit(True).alias("_m"))
    below = F.size(F.filter(F.col("breaks"), lambda b: b < F.col("medianValue")))
    return (
        volume.join(marks, "orgUnit", "left")
        .withColumn("breaks", breaks)
        .select(
            "orgUnit",
            "medianValue",
            F.when(F.col("_m"), "Consistent Reporting (Champion)")
            .otherwise("Inconsistent Reporting")
            .alias("champion"),
            F.when(F.size("breaks") < 2, F.lit(1)).when(below > 0, below).alias("volume_class"),
        )
    )


def volume_summary(classed: DataFrame) -> DataFrame:
    return classed.groupBy("champion").agg(
        F.count(F.lit(1)).alias("n"), F.avg("medianValue").alias("mean")
    )


def champion_share(selected: DataFrame, region_col: str) -> DataFrame:
    """Champions and their share of facilities per region."""
    return (
        selected.groupBy(region_col)
        .agg(
            F.countDistinct("orgUnit").alias("total"),
            F.countDistinct(F.when(F.col("Selected") == "Champion", F.col("orgUnit"))).alias("champions"),
        )
        .withColumn("share", F.col("champions") / F.col("total"))
    )


# -- yearly completeness --------------------------------------------------------


def _facility_months(df: DataFrame, *cols: str) -> DataFrame:
    """One row per facility and month: was any value present?"""
    return df.groupBy("orgUnit", *cols, "Month").agg((F.count("original") > 0).alias("has"))


def _yearly_consistent(months: DataFrame, missing_reports: int, drop_last: bool) -> DataFrame:
    """Facilities consistent within a single year, from facility-months."""
    rows = months.filter("has")
    if drop_last:
        rows = rows.filter(F.col("Month") < months.agg(F.max("Month")).scalar())
    keys = [c for c in months.columns if c not in ("Month", "has")]
    per_facility = rows.groupBy(*keys, F.year("Month").alias("Year")).agg(F.count(F.lit(1)).alias("reports"))
    per_year = rows.groupBy(F.year("Month").alias("Year")).agg(F.countDistinct("Month").alias("periods"))
    periods = lookup(per_year, "Year", "periods")
    return (
        per_facility.withColumn("_periods", periods)
        .filter(F.col("reports") >= F.try_element_at("_periods", F.col("Year")) - missing_reports)
        .drop("_periods")
    )


def yearly_completeness(df: DataFrame, missing_reports: int = 0, drop_last_month: bool = True) -> DataFrame:
    """Share of all facilities that report consistently, per year.

    ``drop_last_month`` leaves out the newest month of the data, which is
    often incomplete.
    """
    months = _facility_months(df)
    years = months.select(F.year("Month").alias("Year")).distinct()
    n_all = months.agg(F.countDistinct("orgUnit")).scalar()
    good = _yearly_consistent(months, missing_reports, drop_last_month).groupBy("Year").agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        years.join(good, "Year", "left")
        .select(
            "Year",
            F.coalesce("n", F.lit(0)).alias("n_frequently_reporting"),
            n_all.alias("n_facilities"),
        )
        .withColumn("pr", F.col("n_frequently_reporting") / F.col("n_facilities"))
        .withColumn("label", text.percent_text(F.col("pr"), 1))
    )


def yearly_completeness_by_region(
    df: DataFrame, level_col: str, missing_reports: int = 0, drop_last_month: bool = True
) -> DataFrame:
    """The same per region, for every region and year."""
    months = _facility_months(df, level_col)
    placed = months.filter(F.col(level_col).isNotNull())
    totals = placed.groupBy(F.col(level_col).alias("region_name")).agg(F.countDistinct("orgUnit").alias("n_total"))
    all_years = months.agg(F.array_sort(F.collect_set(F.year("Month")))).scalar()
    frame = totals.withColumn("Year", F.explode(all_years))
    good = (
        _yearly_consistent(months, missing_reports, drop_last_month)
        .groupBy(F.col(level_col).alias("region_name"), "Year")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return frame.join(good, ["region_name", "Year"], "left").select(
        "region_name",
        "Year",
        F.coalesce("n", F.lit(0)).alias("n_reporting"),
        "n_total",
        (F.coalesce("n", F.lit(0)) / F.col("n_total")).alias("pr"),
    )


def completeness_on_map(by_region: DataFrame, polygons: DataFrame, year: int) -> DataFrame:
    """Polygons with the completeness of one year; unmatched ones stay."""
    one = by_region.filter(F.col("Year") == year).withColumnRenamed("region_name", "name")
    return polygons.join(one, "name", "left")


# -- active and inactive facilities ----------------------------------------------


def facility_status(df: DataFrame, level_col: str) -> DataFrame:
    """Active when any value ever was present and not zero."""
    live = F.col("original").isNotNull() & (F.col("original") != 0)
    return (
        df.groupBy(
            "orgUnit", "orgUnitName", F.coalesce(F.col(level_col), F.lit(UNKNOWN_REGION)).alias("region")
        )
        .agg(F.bool_or(live).alias("_here"))
        .withColumn("_any", F.bool_or("_here").over(W.partitionBy("orgUnit")))
        .select(
            "orgUnit",
            "orgUnitName",
            "region",
            F.when(F.col("_any"), "Active").otherwise("Inactive").alias("status"),
        )
    )


def facility_status_table(status: DataFrame) -> DataFrame:
    """Active and inactive counts per region, and National, in one pass."""
    active = F.count_if(F.col("status") == "Active")
    return (
        status.rollup("region")
        .agg(
            F.grouping("region").alias("_nat"),
            F.count(F.lit(1)).alias("Total"),
            active.alias("Active"),
        )
        .select(
            F.when(F.col("_nat") == 1, "National").otherwise(F.col("region")).alias("Region"),
            F.when(F.col("_nat") == 1, 0).otherwise(1).alias("position"),
            "Total",
            "Active",
            (F.col("Total") - F.col("Active")).alias("Inactive"),
            F.round(100 * F.col("Active") / F.col("Total"), 1).alias("pct_active"),
        )
        .orderBy("position", "Region")
    )


def facility_status_shares(status: DataFrame) -> DataFrame:
    """Count and share of each status per region, with the region's rank by
    active share."""
    wide = status.groupBy("region").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "Active").alias("Active"),
        F.count_if(F.col("status") == "Inactive").alias("Inactive"),
    )
    return wide.withColumn("active_share", F.col("Active") / F.col("total")).unpivot(
        ["region", "total", "active_share"], ["Active", "Inactive"], "status", "n"
    ).withColumn("pct", F.col("n") / F.col("total")).orderBy(F.desc("active_share"), "region", "status")


def reporting_grid(df: DataFrame, level_col: str) -> DataFrame:
    """Every facility in every month of the data: reported 1, else 0."""
    live = F.col("original").isNotNull() & (F.col("original") != 0)
    cells = df.groupBy("orgUnit", "Month").agg(
        F.bool_or(live).cast("int").alias("reported"),
        F.min("orgUnitName").alias("orgUnitName"),
        F.min(F.coalesce(F.col(level_col), F.lit(UNKNOWN_REGION))).alias("region"),
    )
    months = cells.agg(F.array_sort(F.collect_set("Month"))).scalar()
    units = cells.groupBy("orgUnit").agg(
        F.min("orgUnitName").alias("orgUnitName"),
        F.min("region").alias("region"),
        F.sum("reported").alias("total_reported"),
    )
    return (
        units.withColumn("Month", F.explode(months))
        .join(cells.select("orgUnit", "Month", "reported"), ["orgUnit", "Month"], "left")
        .select(
            "orgUnit",
            "orgUnitName",
            "region",
            "Month",
            F.coalesce("reported", F.lit(0)).alias("reported"),
            "total_reported",
        )
    )


# -- counting rules and summaries --------------------------------------------------


def counting_rules(df: DataFrame, categories: list[str]) -> DataFrame:
    """Facilities per month under three rules: anything reported, any of the
    chosen series, all of the chosen series."""
    period = period_column(df)
    chosen = F.when(F.col("data").isin(categories), F.col("data"))
    per_unit = (
        df.filter(F.col("original").isNotNull())
        .groupBy("orgUnit", period)
        .agg(F.countDistinct(chosen).alias("k"))
    )
    return per_unit.groupBy(period).agg(
        F.count(F.lit(1)).alias("any_data"),
        F.count_if(F.col("k") > 0).alias("any_selected"),
        F.count_if(F.col("k") >= len(set(categories))).alias("all_categories"),
    )


def raw_vs_champion(selected: DataFrame) -> DataFrame:
    """Totals per period over all facilities and over champions."""
    period = period_column(selected)
    champ = F.when(F.col("Selected") == "Champion", F.col("original"))
    return selected.groupBy(period).agg(
        stats.sum0(F.col("original")).alias("raw"),
        stats.sum0(champ).alias("champion"),
        F.countDistinct("orgUnit").alias("facilities"),
    )


def element_span(df: DataFrame) -> DataFrame:
    """First and last period and number of facilities per series."""
    period = period_column(df)
    return df.groupBy("data").agg(
        F.min(period).alias("first"),
        F.max(period).alias("last"),
        F.countDistinct("orgUnit").alias("facilities"),
    )


def rows_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def facilities_list(df: DataFrame) -> DataFrame:
    return df.select("orgUnit", "orgUnitName", "level").distinct()


def _newest(df: DataFrame, n: int) -> DataFrame:
    """Rows of the n newest periods, those since the n-th newest."""
    period = period_column(df)
    calendar = F.sort_array(F.collect_set(period), asc=False)
    since = df.agg(F.coalesce(F.get(calendar, F.lit(n - 1)), F.min(period))).scalar()
    return df.filter(F.col(period) >= since)


def completeness_by_element(df: DataFrame, max_periods: int = 24) -> DataFrame:
    """Percent of rows with a value per period and series, newest periods."""
    period = period_column(df)
    return (
        _newest(df, max_periods)
        .groupBy(period, "data")
        .agg(F.count(F.lit(1)).alias("n"), F.count("original").alias("present"))
        .withColumn("pct", F.round(100 * F.col("present") / F.col("n"), 0))
    )


def totals_by_element(totals: DataFrame, max_periods: int = 24) -> DataFrame:
    """Sum of ``total`` per period and series, newest periods."""
    period = period_column(totals)
    return _newest(totals, max_periods).groupBy(period, "data").agg(
        stats.sum0(F.col("total")).alias("total")
    )


def flag_counts(df: DataFrame) -> DataFrame:
    """Rows, flagged rows and percent per series."""
    flags = present(df, FLAG_ORDER)
    return (
        df.groupBy("data")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(any_set(flags)).alias("flagged"),
            *[F.count_if(F.col(f)).alias(f) for f in flags],
        )
        .withColumn("pct", F.round(100 * F.col("flagged") / F.col("n"), 1))
    )


def top_flagged_periods(df: DataFrame, k: int = 5) -> DataFrame:
    """The k periods with most flagged rows per series."""
    period = period_column(df)
    per = (
        df.filter(any_set(present(df, FLAG_ORDER)))
        .groupBy("data", period)
        .agg(F.count(F.lit(1)).alias("flagged"))
    )
    w = W.partitionBy("data").orderBy(F.desc("flagged"), F.asc(period))
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def region_totals(df: DataFrame, region_col: str) -> DataFrame:
    """Reported total, facilities and average per facility; region and National."""
    return (
        df.rollup(region_col)
        .agg(
            F.grouping(region_col).alias("_nat"),
            stats.sum0(F.col("original")).alias("total"),
            F.countDistinct("orgUnit").alias("facilities"),
        )
        .select(
            F.when(F.col("_nat") == 1, "National").otherwise(F.col(region_col)).alias("region"),
            "total",
            "facilities",
            F.try_divide("total", "facilities").alias("average"),
        )
    )

"""Reporting completeness queries."""

from pyspark.sql import functions as F

from ..operators import reporting as rp
from . import fixtures as fx
from .fixtures import SQL
from .registry import query

# Choices that give non-empty results on the given tables: four years, with an
# allowance of missing months.
START, END, MISSING = "1996-01-01", "1999-12-01", 5
SERIES = ["Cases A_F", "Cases A_O", "Cases N_O", "Cases N_F"]
_IN = ", ".join(f"'{s}'" for s in SERIES)


def champion_sql(rule: str, missing: int = MISSING, start=START, end=END, cats: str = _IN, n=len(SERIES), src="fact"):
    """SQL body selecting the champions of a window."""
    window = f"original IS NOT NULL AND Month BETWEEN DATE '{start}' AND DATE '{end}'"
    chosen = "TRUE" if rule == "any_data" else f"data IN ({cats})"
    base = "regexp_replace(data, '_[^_]*$', '')"
    if rule == "all_categories":
        having = f"HAVING count(DISTINCT data) >= {n}"
    elif rule == "all_elements":
        having = f"HAVING count(DISTINCT {base}) >= (SELECT count(DISTINCT {base}) FROM {src} WHERE {window} AND {chosen})"
    else:
        having = ""
    return f"""
    SELECT p.orgUnit FROM (
      SELECT orgUnit, year(Month) AS y, count(*) AS reports FROM (
        SELECT orgUnit, Month FROM {src} WHERE {window} AND {chosen} GROUP BY orgUnit, Month {having})
      GROUP BY 1, 2) p
    JOIN (SELECT year(Month) AS y, count(DISTINCT Month) AS periods FROM {src}
          WHERE {window} AND {chosen} GROUP BY 1) c ON p.y = c.y
    GROUP BY p.orgUnit
    HAVING bool_and(reports >= periods - {missing})
       AND count(*) = (SELECT count(DISTINCT year(Month)) FROM {src} WHERE {window} AND {chosen})
    """


def champ(spark, sf, rule="any_selected", missing=MISSING):
    return rp.champions(fx.fact(spark, sf), START, END, missing, rule, SERIES)


for _rule in rp.RULES:
    _missing = {"any_data": 0, "any_selected": 2, "all_elements": 5, "all_categories": 11}[_rule]

    def _run(spark, sf, rule=_rule, missing=_missing):
        return champ(spark, sf, rule, missing)

    query(f"champions_{_rule}", champion_sql(_rule, _missing))(_run)

SQL["champs"] = champion_sql("all_categories", 11)
SQL["selected"] = f"""
SELECT f.*, CASE WHEN c.orgUnit IS NULL THEN 'Non-Champion' ELSE 'Champion' END AS Selected,
       original AS dataCol
FROM fact f LEFT JOIN champs c ON f.orgUnit = c.orgUnit
WHERE effectiveLeaf AND data IN ({_IN}) AND Month >= DATE '{START}'
"""


def champs(spark, sf, facts=None):
    facts = fx.fact(spark, sf) if facts is None else facts
    return rp.champions(facts, START, END, 11, "all_categories", SERIES)


def selected(spark, sf):
    facts = fx.stored_fact(spark, sf)
    return rp.select_data(
        facts,
        fx.LEVELS,
        categories=SERIES,
        champion_units=champs(spark, sf, facts),
        start=START,
    ).withColumn("dataCol", F.col("original"))


@query(
    "champions_weekly",
    """
    SELECT p.orgUnit FROM (SELECT orgUnit, year(Week) AS y, count(DISTINCT Week) AS r FROM weekly
                           WHERE original IS NOT NULL GROUP BY 1, 2) p
    JOIN (SELECT year(Week) AS y, count(DISTINCT Week) AS m FROM weekly GROUP BY 1) c ON p.y = c.y
    GROUP BY 1 HAVING bool_and(r >= m - 1)
      AND count(*) = (SELECT count(DISTINCT year(Week)) FROM weekly)
    """,
)
def champions_weekly(spark, sf):
    return rp.champions(fx.weekly(spark, sf), missing_reports=1)


@query(
    "select_data_labels",
    """
    SELECT Region, Selected, data, CAST(count(*) AS BIGINT) AS n, sum(original) AS total
    FROM selected WHERE Region IN ('ASIA', 'EUROPE', 'AFRICA') AND District IS NOT NULL GROUP BY ALL
    """,
    nums="total",
)
def select_data_labels(spark, sf):
    facts = fx.stored_fact(spark, sf)
    out = rp.select_data(
        facts,
        fx.LEVELS,
        regions={"Region": ["ASIA", "EUROPE", "AFRICA"]},
        categories=SERIES,
        champion_units=champs(spark, sf, facts),
        start=START,
    )
    return out.groupBy("Region", "Selected", "data").agg(
        F.count(F.lit(1)).alias("n"), F.sum("original").alias("total")
    )


@query(
    "select_data_own_search",
    f"""
    SELECT data, CASE WHEN c.orgUnit IS NULL THEN 'Non-Champion' ELSE 'Champion' END AS Selected,
           CAST(count(*) AS BIGINT) AS n
    FROM fact f LEFT JOIN ({champion_sql('all_elements', 5)}) c ON f.orgUnit = c.orgUnit
    WHERE data IN ({_IN}) AND Month >= DATE '{START}' GROUP BY ALL
    """,
)
def select_data_own_search(spark, sf):
    out = rp.select_data(
        fx.fact(spark, sf),
        fx.LEVELS,
        categories=SERIES,
        start=START,
        end=END,
        missing_reports=5,
        reporting_rule="all_elements",
    )
    return out.groupBy("data", "Selected").agg(F.count(F.lit(1)).alias("n"))


@query(
    "region_cascade",
    """
    SELECT Region, District, data, CAST(count(*) AS BIGINT) AS n FROM fact
    WHERE Region IN ('ASIA', 'EUROPE') AND District IN ('CHINA', 'FRANCE', 'INDIA', 'GERMANY', 'JAPAN',
      'NATION_1', 'NATION_2', 'NATION_3', 'NATION_7', 'NATION_8', 'NATION_12') GROUP BY ALL
    """,
)
def region_cascade(spark, sf):
    chosen = {
        "Region": ["ASIA", "EUROPE"],
        "District": [
            "CHINA", "FRANCE", "INDIA", "GERMANY", "JAPAN", "NATION_1", "NATION_2", "NATION_3",
            "NATION_7", "NATION_8", "NATION_12",
        ],
    }
    out = rp.region_filter(fx.fact(spark, sf), fx.LEVELS, chosen)
    return out.groupBy("Region", "District", "data").agg(F.count(F.lit(1)).alias("n"))


_PERIODS = """(SELECT year(Month) AS "year", orgUnit, count(DISTINCT Month) AS n_periods FROM fact GROUP BY 1, 2)"""


@query("reports_per_facility", f"SELECT * FROM {_PERIODS}")
def reports_per_facility(spark, sf):
    return rp.periods_per_facility(fx.fact(spark, sf))


@query(
    "facilities_by_reports",
    f"""SELECT 'all' AS scope, "year", n_periods, count(*) AS n FROM {_PERIODS} GROUP BY ALL
    UNION ALL
    SELECT 'champion', "year", n_periods, count(*) FROM {_PERIODS} WHERE orgUnit IN (SELECT orgUnit FROM champs)
    GROUP BY ALL""",
)
def facilities_by_reports(spark, sf):
    r = rp.periods_per_facility(fx.fact(spark, sf))
    a = rp.facilities_by_periods(r).withColumn("scope", F.lit("all"))
    return a.unionByName(rp.facilities_by_periods(r, champs(spark, sf)).withColumn("scope", F.lit("champion")))


@query(
    "facilities_by_month",
    """SELECT 'all' AS scope, year(Month) AS "year", Month, count(DISTINCT orgUnit) AS n FROM fact GROUP BY ALL
    UNION ALL
    SELECT 'champion', year(Month), Month, count(DISTINCT orgUnit) FROM fact
    WHERE orgUnit IN (SELECT orgUnit FROM champs) GROUP BY ALL""",
    dates="Month",
)
def facilities_by_month(spark, sf):
    f = fx.fact(spark, sf)
    a = rp.facilities_per_period(f).withColumn("scope", F.lit("all"))
    return a.unionByName(rp.facilities_per_period(f, champs(spark, sf)).withColumn("scope", F.lit("champion")))


@query("facilities_ever", "SELECT count(DISTINCT orgUnit) AS Total FROM fact")
def facilities_ever(spark, sf):
    return rp.facilities_ever(fx.fact(spark, sf))


@query("facilities_per_class", "SELECT Selected, count(DISTINCT orgUnit) AS n FROM selected GROUP BY 1")
def facilities_per_class(spark, sf):
    return rp.facilities_per_class(selected(spark, sf))


SQL["volume"] = """
SELECT orgUnit, Region, median(v) AS medianValue FROM (
  SELECT orgUnit, Region, Month, coalesce(sum(dataCol), 0) AS v FROM selected GROUP BY ALL) GROUP BY ALL
"""


@query("typical_volume", "SELECT * FROM volume", nums="medianValue")
def typical_volume(spark, sf):
    return rp.typical_volume(selected(spark, sf), ["Region"])


SQL["volume_classed"] = """
WITH b AS (SELECT list_sort(list_distinct(quantile_cont(medianValue, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS breaks FROM volume)
SELECT v.orgUnit, v.medianValue,
       CASE WHEN c.orgUnit IS NULL THEN 'Inconsistent Reporting' ELSE 'Consistent Reporting (Champion)' END AS champion,
       CASE WHEN len([x FOR x IN breaks IF x < v.medianValue]) > 0
            THEN len([x FOR x IN breaks IF x < v.medianValue]) END AS volume_class
FROM volume v CROSS JOIN b LEFT JOIN champs c ON v.orgUnit = c.orgUnit
"""


def classed(spark, sf):
    return rp.volume_quartiles(rp.typical_volume(selected(spark, sf)), champs(spark, sf))


@query("volume_quartiles", "SELECT * FROM volume_classed", nums="medianValue")
def volume_quartiles(spark, sf):
    return classed(spark, sf)


@query(
    "volume_summary",
    "SELECT champion, count(*) AS n, avg(medianValue) AS mean FROM volume_classed GROUP BY 1",
    nums="mean",
)
def volume_summary(spark, sf):
    return rp.volume_summary(classed(spark, sf))


@query(
    "champion_share",
    """SELECT Region, count(DISTINCT orgUnit) AS total,
       count(DISTINCT CASE WHEN Selected = 'Champion' THEN orgUnit END) AS champions,
       count(DISTINCT CASE WHEN Selected = 'Champion' THEN orgUnit END) / count(DISTINCT orgUnit) AS share
    FROM selected GROUP BY 1""",
    nums="share",
)
def champion_share(spark, sf):
    return rp.champion_share(selected(spark, sf), "Region")


SQL["consistent_years"] = """
WITH seen AS (SELECT DISTINCT orgUnit, Month FROM fact
              WHERE original IS NOT NULL AND Month < (SELECT max(Month) FROM fact)),
p AS (SELECT orgUnit, year(Month) AS "Year", count(*) AS r FROM seen GROUP BY ALL),
c AS (SELECT year(Month) AS "Year", count(DISTINCT Month) AS m FROM seen GROUP BY 1)
SELECT p."Year", orgUnit FROM p JOIN c ON p."Year" = c."Year" WHERE r >= m - {0}
"""
_YEARS = SQL.pop("consistent_years")


@query(
    "yearly_completeness",
    f"""
    WITH good AS (SELECT "Year", count(*) AS n FROM ({_YEARS.format(0)}) GROUP BY 1),
    y AS (SELECT DISTINCT year(Month) AS "Year" FROM fact), t AS (SELECT count(DISTINCT orgUnit) AS n FROM fact)
    SELECT y."Year", coalesce(good.n, 0) AS n_frequently_reporting, t.n AS n_facilities,
           coalesce(good.n, 0) / t.n AS pr,
           printf('%.1f', round(100 * coalesce(good.n, 0) / t.n, 1)) || '%' AS label
    FROM y CROSS JOIN t LEFT JOIN good ON y."Year" = good."Year"
    """,
    nums="pr",
)
def yearly_completeness(spark, sf):
    return rp.yearly_completeness(fx.fact(spark, sf))


_BY_REGION = f"""
    WITH good AS (SELECT Region, "Year", count(*) AS n FROM ({_YEARS.format(1)}) g
                  JOIN (SELECT DISTINCT orgUnit, Region FROM fact WHERE Region IS NOT NULL) r ON g.orgUnit = r.orgUnit
                  GROUP BY ALL),
    t AS (SELECT Region, count(DISTINCT orgUnit) AS n FROM fact WHERE Region IS NOT NULL GROUP BY 1),
    y AS (SELECT DISTINCT year(Month) AS "Year" FROM fact)
    SELECT t.Region AS region_name, y."Year", coalesce(good.n, 0) AS n_reporting, t.n AS n_total,
           coalesce(good.n, 0) / t.n AS pr
    FROM t CROSS JOIN y LEFT JOIN good ON good.Region = t.Region AND good."Year" = y."Year"
"""


@query("yearly_completeness_by_region", _BY_REGION, nums="pr")
def yearly_completeness_by_region(spark, sf):
    return rp.yearly_completeness_by_region(fx.fact(spark, sf), "Region", 1)


@query(
    "completeness_on_map",
    f"""SELECT p.r_name AS name, p.r_regionkey AS id, "Year", n_reporting, n_total, pr
    FROM region p LEFT JOIN ({_BY_REGION}) c ON c.region_name = p.r_name AND c."Year" = 1999""",
    nums="pr",
)
def completeness_on_map(spark, sf):
    polygons = fx.table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("id"))
    by_region = rp.yearly_completeness_by_region(fx.fact(spark, sf), "Region", 1)
    return rp.completeness_on_map(by_region, polygons, 1999)


SQL["status"] = """
SELECT orgUnit, orgUnitName, coalesce(Region, '(Unknown)') AS region,
       CASE WHEN bool_or(original IS NOT NULL AND original <> 0 AND Month >= DATE '2001-06-01')
            THEN 'Active' ELSE 'Inactive' END AS status
FROM fact GROUP BY ALL
"""


def status(spark, sf):
    recent = F.when(F.col("Month") >= "2001-06-01", F.col("original"))
    return rp.facility_status(fx.fact(spark, sf).withColumn("original", recent), "Region")


@query("facility_status", "SELECT * FROM status")
def facility_status(spark, sf):
    return status(spark, sf)


@query(
    "facility_status_table",
    """
    SELECT CASE WHEN grouping(region) = 1 THEN 'National' ELSE region END AS "Region",
           CASE WHEN grouping(region) = 1 THEN 0 ELSE 1 END AS position, count(*) AS Total,
           count(*) FILTER (status = 'Active') AS Active, count(*) FILTER (status = 'Inactive') AS Inactive,
           round(100 * count(*) FILTER (status = 'Active') / count(*), 1) AS pct_active
    FROM status GROUP BY ROLLUP (region)
    """,
    nums="pct_active",
)
def facility_status_table(spark, sf):
    return rp.facility_status_table(status(spark, sf))


@query(
    "facility_status_shares",
    """
    WITH w AS (SELECT region, count(*) AS total, count(*) FILTER (status = 'Active') AS a,
                      count(*) FILTER (status = 'Inactive') AS i FROM status GROUP BY 1)
    SELECT region, total, a / total AS active_share, s.status, CASE s.status WHEN 'Active' THEN a ELSE i END AS n,
           CASE s.status WHEN 'Active' THEN a ELSE i END / total AS pct
    FROM w CROSS JOIN (VALUES ('Active'), ('Inactive')) s(status)
    """,
    nums="active_share pct",
)
def facility_status_shares(spark, sf):
    return rp.facility_status_shares(status(spark, sf))


@query(
    "reporting_grid",
    """
    WITH cell AS (SELECT orgUnit, Month, CAST(bool_or(original IS NOT NULL AND original <> 0) AS INTEGER) AS r
                  FROM fact GROUP BY ALL),
    u AS (SELECT DISTINCT orgUnit, orgUnitName, Region AS region FROM fact),
    m AS (SELECT DISTINCT Month FROM fact)
    SELECT u.orgUnit, orgUnitName, region, m.Month, coalesce(r, 0) AS reported,
           CAST((SELECT sum(r) FROM cell c2 WHERE c2.orgUnit = u.orgUnit) AS BIGINT) AS total_reported
    FROM u CROSS JOIN m LEFT JOIN cell ON cell.orgUnit = u.orgUnit AND cell.Month = m.Month
    """,
    dates="Month",
)
def reporting_grid(spark, sf):
    return rp.reporting_grid(fx.fact(spark, sf), "Region")


@query(
    "counting_rules",
    f"""
    SELECT Month, count(*) AS any_data, count(*) FILTER (k > 0) AS any_selected,
           count(*) FILTER (k >= {len(SERIES)}) AS all_categories
    FROM (SELECT orgUnit, Month, count(DISTINCT CASE WHEN data IN ({_IN}) THEN data END) AS k
          FROM fact WHERE original IS NOT NULL GROUP BY ALL) GROUP BY 1
    """,
    dates="Month",
)
def counting_rules(spark, sf):
    return rp.counting_rules(fx.fact(spark, sf), SERIES)


GRID = [
    {"setting": f"{name}-{k}-{rule}", "start": s, "end": e, "missing_reports": k, "reporting_rule": rule, "categories": SERIES}
    for name, s, e in [("four", "1996-01-01", "1999-12-01"), ("two", "1998-01-01", "1999-12-01"), ("one", "1999-01-01", "1999-12-01")]
    for k in (1, 3, 6)
    for rule in ("any_selected", "all_elements", "all_categories")
]


@query(
    "champion_grid",
    " UNION ALL ".join(
        f"SELECT '{g['setting']}' AS setting, count(*) AS champions FROM "
        f"({champion_sql(g['reporting_rule'], g['missing_reports'], g['start'], g['end'])}) HAVING count(*) > 0"
        for g in GRID
    ),
)
def champion_grid(spark, sf):
    return rp.champion_grid(fx.fact(spark, sf), GRID).groupBy("setting").agg(F.count(F.lit(1)).alias("champions"))


@query(
    "champion_vs_raw_totals",
    """
    SELECT Month, coalesce(sum(original), 0) AS raw,
           coalesce(sum(CASE WHEN Selected = 'Champion' THEN original END), 0) AS champion,
           count(DISTINCT orgUnit) AS facilities
    FROM selected GROUP BY 1
    """,
    dates="Month",
    nums="raw champion",
)
def champion_vs_raw_totals(spark, sf):
    return rp.raw_vs_champion(selected(spark, sf))


@query(
    "element_span",
    'SELECT data, min(Month) AS "first", max(Month) AS "last", count(DISTINCT orgUnit) AS facilities FROM fact GROUP BY 1',
    dates='"first" "last"',
)
def element_span(spark, sf):
    return rp.element_span(fx.fact(spark, sf))


@query("rows_per_key", "SELECT Region, data, count(*) AS n FROM fact GROUP BY ALL")
def rows_per_key(spark, sf):
    return rp.rows_per_key(fx.fact(spark, sf), ["Region", "data"])


_NEWEST = "Month IN (SELECT DISTINCT Month FROM fact ORDER BY 1 DESC LIMIT 24)"


@query(
    "completeness_by_element",
    f"""SELECT Month, data, count(*) AS n, count(original) AS present,
        round(100 * count(original) / count(*), 0) AS pct FROM fact WHERE {_NEWEST} GROUP BY ALL""",
    dates="Month",
    nums="pct",
)
def completeness_by_element(spark, sf):
    return rp.completeness_by_element(fx.fact(spark, sf))


@query(
    "totals_by_element",
    f"SELECT Month, data, coalesce(sum(original), 0) AS total FROM fact WHERE {_NEWEST} GROUP BY ALL",
    dates="Month",
    nums="total",
)
def totals_by_element(spark, sf):
    return rp.totals_by_element(fx.fact(spark, sf).withColumnRenamed("original", "total"))


@query(
    "region_totals",
    """SELECT CASE WHEN grouping(Region) = 1 THEN 'National' ELSE Region END AS region,
       coalesce(sum(original), 0) AS total, count(DISTINCT orgUnit) AS facilities,
       coalesce(sum(original), 0) / count(DISTINCT orgUnit) AS average FROM fact GROUP BY ROLLUP (Region)""",
    nums="total average",
)
def region_totals(spark, sf):
    return rp.region_totals(fx.fact(spark, sf), "Region")


@query("facilities_list", 'SELECT DISTINCT orgUnit, orgUnitName, "level" FROM fact')
def facilities_list(spark, sf):
    return rp.facilities_list(fx.fact(spark, sf))

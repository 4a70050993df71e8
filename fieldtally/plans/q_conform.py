"""Sources, conforming and scalar-function queries."""

import uuid

from pyspark.sql import functions as F

from ..functions import draws, periods, text
from ..operators import conform as cf
from ..sources import refresh, tables
from ..sources.staging import shared_folder
from . import fixtures as fx
from .fixtures import SQL, sql_hash
from .registry import query

# -- sources -------------------------------------------------------------------


@query(
    "restore_month_index",
    """SELECT orgUnit, data_id, Month, original FROM fact""",
    dates="Month",
    nums="original",
)
def restore_month_index(spark, sf):
    """Facts whose month was stored as months since 1970."""
    f = fx.fact(spark, sf).select("orgUnit", "data_id", "Month", "original")
    legacy = f.withColumn("Month", (F.year("Month") - 1970) * 12 + F.month("Month") - 1)
    return tables.restore_index(legacy)


@query(
    "restore_day_index",
    "SELECT orgUnit, data_id, Month, original FROM fact",
    dates="Month",
    nums="original",
)
def restore_day_index(spark, sf):
    f = fx.fact(spark, sf).select("orgUnit", "data_id", "Month", "original")
    return tables.restore_index(f.withColumn("Month", F.unix_date("Month")))


# Two extracts of the sales: values, and counts of which some are filed under another category.
SQL["sum_extract"] = """
SELECT dataElement, categoryOptionCombo, period, orgUnit, "SUM" AS value FROM raw
"""
SQL["count_extract"] = f"""
SELECT dataElement, CASE WHEN {sql_hash("'pair'", "orgUnit", "period")} % 7 = 0 THEN 'ccX00000001' ELSE categoryOptionCombo END AS categoryOptionCombo, period, orgUnit, max("COUNT") AS value
FROM raw GROUP BY ALL
"""


@query(
    "pair_extracts",
    """
    SELECT coalesce(s.dataElement, c.dataElement) AS dataElement, coalesce(s.categoryOptionCombo, c.categoryOptionCombo) AS categoryOptionCombo,
           coalesce(s.period, c.period) AS period, coalesce(s.orgUnit, c.orgUnit) AS orgUnit, c.value AS "COUNT", s.value AS "SUM"
    FROM sum_extract s FULL OUTER JOIN count_extract c ON s.dataElement = c.dataElement AND s.period = c.period
      AND s.orgUnit = c.orgUnit AND s.categoryOptionCombo = c.categoryOptionCombo
    """,
    nums='"SUM"',
)
def pair_extracts(spark, sf):
    raw = fx.raw(spark, sf)
    # Every seventh count by hash is filed under another category, so that neither side has its other.
    other = draws.hash32("pair", F.col("orgUnit"), F.col("period")) % 7 == 0
    sums = raw.withColumnRenamed("SUM", "value").drop("COUNT")
    counts = raw.withColumnRenamed("COUNT", "value").drop("SUM")
    counts = counts.withColumn("categoryOptionCombo", F.when(other, F.lit("ccX00000001")).otherwise(F.col("categoryOptionCombo")))
    counts = counts.groupBy("dataElement", "categoryOptionCombo", "period", "orgUnit").agg(F.max("value").alias("value"))
    return refresh.pair_extracts(sums, counts)


@query(
    "default_category",
    """SELECT coalesce(CASE WHEN categoryOptionCombo LIKE 'ccF%' THEN categoryOptionCombo END, 'default') AS categoryOptionCombo,
       dataElement, CAST(count(*) AS BIGINT) AS n, sum("SUM") AS total FROM raw GROUP BY ALL""",
    nums="total",
)
def default_category(spark, sf):
    raw = fx.raw(spark, sf).withColumn(
        "categoryOptionCombo",
        F.when(F.col("categoryOptionCombo").startswith("ccF"), F.col("categoryOptionCombo")),
    )
    return (
        refresh.default_category(raw)
        .groupBy("categoryOptionCombo", "dataElement")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("SUM").alias("total"))
    )


# The stored table has other values of a facility in newer months, so those differ.
SQL["stored_raw"] = """
SELECT * REPLACE (CASE WHEN period >= '199806' AND orgUnit = 'F7' THEN "SUM" + 1 ELSE "SUM" END AS "SUM") FROM raw
"""


def stored_raw(spark, sf):
    old = (F.col("period") >= "199806") & (F.col("orgUnit") == "F7")
    return fx.raw(spark, sf).withColumn("SUM", F.when(old, F.col("SUM") + 1).otherwise(F.col("SUM")))


def current_totals(spark, sf):
    return (
        fx.raw(spark, sf)
        .groupBy("dataElement", "period", "categoryOptionCombo")
        .agg(F.count(F.lit(1)).alias("current_count"), F.sum("SUM").alias("current_value"))
    )


_STALE = """
    SELECT period FROM (SELECT DISTINCT period FROM raw) WHERE period NOT IN (
      SELECT c.period FROM (SELECT dataElement, period, categoryOptionCombo, count(*) n, sum("SUM") v FROM raw GROUP BY ALL) c
      LEFT JOIN (SELECT dataElement, period, categoryOptionCombo, count(*) n, sum("SUM") v FROM stored_raw GROUP BY ALL) p
        ON c.dataElement = p.dataElement AND c.period = p.period AND c.categoryOptionCombo = p.categoryOptionCombo
      GROUP BY c.period HAVING bool_and(coalesce(c.n = p.n AND c.v = p.v, FALSE)))
"""


def stale(spark, sf):
    wanted = fx.raw(spark, sf).select("period")
    return refresh.stale_periods(stored_raw(spark, sf), current_totals(spark, sf), wanted)


@query("stale_periods", _STALE)
def stale_periods(spark, sf):
    return stale(spark, sf)


@query(
    "merge_refresh",
    f"""
    SELECT period, CAST(count(*) AS BIGINT) AS n, count(DISTINCT orgUnit) AS units, sum("SUM") AS total FROM (
      SELECT period, orgUnit, "SUM" FROM stored_raw WHERE period NOT IN ({_STALE})
      UNION ALL SELECT period, orgUnit, "SUM" FROM raw WHERE period IN ({_STALE}))
    GROUP BY 1
    """,
    nums="total",
)
def merge_refresh(spark, sf):
    """Stale periods taken into a stored extract, which is then read back."""
    path = f"{shared_folder(spark)}/extract-{uuid.uuid4().hex}"
    refresh.refresh_stored(path, stored_raw(spark, sf))
    stored = refresh.read_stored(spark, path)
    fresh = fx.raw(spark, sf).join(refresh.stale_periods(stored, current_totals(spark, sf), fx.raw(spark, sf).select("period")), "period", "left_semi")
    refresh.refresh_stored(path, fresh)
    return refresh.read_stored(spark, path).groupBy("period").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("orgUnit").alias("units"),
        F.sum(F.col("SUM").cast("double")).alias("total"),
    )


@query(
    "raw_from_processed",
    """SELECT split_part(data_id, '_', 1) AS dataElement,
       CASE WHEN contains(data_id, '_') THEN split_part(data_id, '_', 2) END AS categoryOptionCombo,
       orgUnit, strftime(Month, '%Y%m') AS period, CAST(1 AS INTEGER) AS "COUNT", original AS "SUM" FROM fact""",
    nums='"SUM"',
)
def raw_from_processed(spark, sf):
    return refresh.raw_from_processed(fx.fact(spark, sf))


@query(
    "dataset_profile",
    "SELECT data, count(*) AS n_rows, '' AS cleaning_levels, 'Month' AS period_type FROM fact GROUP BY 1",
)
def dataset_profile(spark, sf):
    return tables.profile(fx.fact(spark, sf))


# Two rainfall files that overlap in 1997: by district and month, the mean
# price stands for millimetres.
SQL["rain_a"] = """
SELECT District AS id, CAST(year(Month) AS INTEGER) AS "year", CAST(month(Month) AS INTEGER) AS "month", avg(original) AS mean_rain
FROM fact WHERE year(Month) <= 1997 GROUP BY ALL
"""
SQL["rain_b"] = """
SELECT District AS id, CAST(year(Month) AS INTEGER) AS "year", CAST(month(Month) AS INTEGER) AS "month", max(original) AS mean_rain
FROM fact WHERE year(Month) >= 1997 GROUP BY ALL
"""


@query("write_facts", "SELECT orgUnit, data_id, Month, original FROM fact", dates="Month", nums="original")
def write_facts(spark, sf):
    """The processed table written to the shared folder and read back."""
    path = f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
    tables.write_facts(fx.fact(spark, sf), path)
    return tables.read_facts(spark, path).select("orgUnit", "data_id", "Month", "original")


@query(
    "union_rainfall",
    """SELECT * FROM rain_a UNION ALL SELECT b.* FROM rain_b b ANTI JOIN rain_a a
       ON a.id = b.id AND a."year" = b."year" AND a."month" = b."month" """,
    nums="mean_rain",
)
def union_rainfall(spark, sf):
    f = fx.fact(spark, sf).select(
        F.col("District").alias("id"), F.year("Month").alias("year"), F.month("Month").alias("month"), "original"
    )
    a = f.filter("year <= 1997").groupBy("id", "year", "month").agg(F.avg("original").alias("mean_rain"))
    b = f.filter("year >= 1997").groupBy("id", "year", "month").agg(F.max("original").alias("mean_rain"))
    return tables.union_rainfall([a, b])


SQL["unit_levels"] = """
SELECT DISTINCT "level", CASE "level" WHEN 1 THEN 'National' WHEN 2 THEN 'Region' WHEN 3 THEN 'District' ELSE 'Health facility' END AS levelName
FROM ous
"""


def unit_levels(spark, sf):
    lv = F.col("level")
    name = F.when(lv == 1, "National").when(lv == 2, "Region").when(lv == 3, "District").otherwise("Health facility")
    return fx.ous(spark, sf).select("level").distinct().withColumn("levelName", name)


def parented(spark, sf):
    o = fx.ous(spark, sf)
    p = o.select(F.col("id").alias("parent_id"), F.col("name").alias("parentName"))
    return o.join(p, "parent_id", "left")


@query(
    "facility_master",
    """SELECT o.name AS facility_name, p.name AS parent_name, length(o.name) + 0.5 AS latitude, length(p.name) + 0.25 AS longitude
    FROM ous o JOIN ous p ON o.parent_id = p.id WHERE o."level" = 4""",
    nums="latitude longitude",
)
def facility_master(spark, sf):
    u = parented(spark, sf).withColumn("latitude", F.length("name") + F.lit(0.5)).withColumn(
        "longitude", F.length("parentName") + F.lit(0.25)
    )
    return tables.facility_master(u, unit_levels(spark, sf))


@query(
    "ingest_wide",
    """
    SELECT r.orgUnit, CAST(strptime(r.period, '%Y%m') AS DATE) AS period, TRUE AS leaf,
           sum(CASE WHEN dataElement = 'deA00000001' AND categoryOptionCombo = 'ccF00000001' THEN "SUM" END) AS "A_F",
           sum(CASE WHEN dataElement = 'deN00000001' AND categoryOptionCombo = 'ccO00000001' THEN "SUM" END) AS "N_O",
           t.total AS attendance, t.n AS Count_Any, t.c AS Count_Complete
    FROM raw r LEFT JOIN (SELECT orgUnit, period, sum("SUM") total, count(*) n, count(*) FILTER ("SUM" > 50) c
                          FROM raw GROUP BY ALL) t ON r.orgUnit = t.orgUnit AND r.period = t.period
    GROUP BY ALL
    """,
    dates="period",
    bools="leaf",
    nums='"A_F" "N_O" attendance',
)
def ingest_wide(spark, sf):
    raw = fx.raw(spark, sf)
    data = raw.select(
        F.substring("dataElement", 3, 1).alias("dataElement"),
        F.substring("categoryOptionCombo", 3, 1).alias("Category"),
        "period",
        "orgUnit",
        "COUNT",
        "SUM",
        F.lit(True).alias("leaf"),
    )
    summary = (
        raw.groupBy("orgUnit", "period")
        .agg(
            F.sum("SUM").alias("Total"),
            F.count(F.lit(1)).alias("Count_Any"),
            F.count_if(F.col("SUM") > 50).alias("Count_Complete"),
        )
    )
    return tables.ingest_wide(data, summary, ["A_F", "N_O"], total_name="attendance")


# -- conform ----------------------------------------------------------------------

# A formula with repeated rows: first match must win, and elements without
# categories must match rows without one.
SQL["formula_raw"] = """
SELECT dataElement_id, categoryOptionCombo_ids, n_categoryOptions, "role" FROM (
  SELECT DISTINCT e.dataElement_id, c.categoryOptionCombo_id AS categoryOptionCombo_ids,
         CAST(2 AS BIGINT) AS n_categoryOptions, r AS "role"
  FROM elements e CROSS JOIN option_combos c CROSS JOIN (VALUES ('primary'), ('secondary')) v(r)
  WHERE e.dataElement_id <> 'deR00000001'
  UNION ALL
  SELECT dataElement_id, 'ignored', NULL, 'tertiary' FROM elements WHERE dataElement_id = 'deR00000001')
"""


def formula_raw(spark, sf):
    e, c = fx.elements(spark, sf), fx.option_combos(spark, sf)
    a = (
        e.filter("dataElement_id <> 'deR00000001'")
        .join(c, "categoryCombo_id")
        .select(
            "dataElement_id",
            F.col("categoryOptionCombo_id").alias("categoryOptionCombo_ids"),
            F.lit(2).cast("long").alias("n_categoryOptions"),
            F.explode(F.array(F.lit("primary"), F.lit("secondary"))).alias("role"),
        )
    )
    b = e.filter("dataElement_id = 'deR00000001'").select(
        "dataElement_id",
        F.lit("ignored").alias("categoryOptionCombo_ids"),
        F.lit(None).cast("long").alias("n_categoryOptions"),
        F.lit("tertiary").alias("role"),
    )
    return a.unionByName(b)


@query(
    "attach_formula",
    """
    WITH d AS (SELECT dataElement, CASE WHEN dataElement <> 'deR00000001' OR categoryOptionCombo = 'ccO00000001'
               THEN categoryOptionCombo END AS categoryOptionCombo, "SUM" FROM raw)
    SELECT d.dataElement AS dataElement_id, categoryOptionCombo AS categoryOptionCombo_ids, "role", n_categoryOptions,
           CAST(count(*) AS BIGINT) AS n, sum("SUM") AS total
    FROM d LEFT JOIN (SELECT dataElement_id, CASE WHEN n_categoryOptions IS NOT NULL THEN categoryOptionCombo_ids END AS cat,
                             min("role") AS "role", min(n_categoryOptions) AS n_categoryOptions FROM formula_raw GROUP BY ALL) m
      ON d.dataElement = m.dataElement_id AND d.categoryOptionCombo IS NOT DISTINCT FROM m.cat
    GROUP BY ALL
    """,
    nums="total",
)
def attach_formula(spark, sf):
    drop = (F.col("dataElement") == "deR00000001") & (F.col("categoryOptionCombo") != "ccO00000001")
    d = fx.raw(spark, sf).withColumn(
        "categoryOptionCombo", F.when(~drop, F.col("categoryOptionCombo"))
    )
    out = cf.attach_formula(d, formula_raw(spark, sf), ["role"])
    return out.groupBy("dataElement_id", "categoryOptionCombo_ids", "role", "n_categoryOptions").agg(
        F.count(F.lit(1)).alias("n"), F.sum("SUM").alias("total")
    )


SQL["named"] = """
SELECT r.dataElement AS dataElement_id, r.categoryOptionCombo AS categoryOptionCombo_ids, period, orgUnit, "COUNT", "SUM",
       e.dataElement, c.categoryOptionCombo AS Category
FROM raw r LEFT JOIN elements e ON r.dataElement = e.dataElement_id
LEFT JOIN option_combos c ON r.categoryOptionCombo = c.categoryOptionCombo_id
"""


def named(spark, sf):
    return cf.attach_names(fx.raw(spark, sf), fx.elements(spark, sf), fx.categories(spark, sf))


@query("attach_names", "SELECT * FROM named", nums='"SUM"')
def attach_names(spark, sf):
    return named(spark, sf)


SQL["sets_per_element"] = """
SELECT dataElement_id, count(*) AS n_datasets, string_agg(dataSet_id, E' ;\\n' ORDER BY dataSet_id) AS dataSet_ids,
       string_agg(dataSet, E' ;\\n' ORDER BY dataSet_id) AS dataSet
FROM dataset_elements GROUP BY 1
"""


@query("datasets_per_element", "SELECT * FROM sets_per_element")
def datasets_per_element(spark, sf):
    return cf.datasets_per_element(fx.dataset_elements(spark, sf))


@query(
    "effective_leaf",
    """
    SELECT r.orgUnit, r.dataElement_id, leaf, max(n) = 1 OR leaf AS effectiveLeaf FROM (
      SELECT 'F' || l_suppkey AS orgUnit, 'de' || l_returnflag AS dataElement_id, l_suppkey % 3 = 0 AS leaf,
             CAST(l_linenumber AS INTEGER) AS n FROM lineitem) r GROUP BY r.orgUnit, r.dataElement_id, leaf
    """,
    bools="leaf effectiveLeaf",
)
def effective_leaf(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return cf.effective_leaf(
        li.select(
            F.concat(F.lit("F"), "l_suppkey").alias("orgUnit"),
            F.concat(F.lit("de"), "l_returnflag").alias("dataElement_id"),
            (F.col("l_suppkey") % 3 == 0).alias("leaf"),
            F.col("l_linenumber").cast("string").alias("COUNT"),
        )
    )


# Codes of several kinds, some of which must be rejected.
SQL["coded"] = """
SELECT orgUnit, dataElement_id, categoryOptionCombo_ids, dataElement,
       CASE WHEN orgUnit IN ('F3', 'F4') THEN NULL ELSE Category END AS Category,
       CASE WHEN orgUnit = 'F1' THEN substr(period, 1, 4) || 'Q1' WHEN orgUnit = 'F2' THEN NULL ELSE period END AS period,
       CASE WHEN orgUnit = 'F5' THEN NULL ELSE CAST("COUNT" AS VARCHAR) END AS "COUNT",
       CASE WHEN orgUnit = 'F6' THEN 'n/a' ELSE CAST("SUM" AS VARCHAR) END AS "SUM"
FROM named
"""


@query(
    "parse_periods",
    """
    SELECT data, data_id, Month, CAST(count(*) AS BIGINT) AS n, sum(v) AS total, count(DISTINCT orgUnit) AS units FROM (
      SELECT orgUnit, dataElement || CASE WHEN Category IS NULL THEN '' ELSE '_' || Category END AS data,
             dataElement_id || '_' || categoryOptionCombo_ids AS data_id, CAST(strptime(period, '%Y%m') AS DATE) AS Month,
             TRY_CAST("SUM" AS DOUBLE) AS v FROM coded WHERE "COUNT" IS NOT NULL AND regexp_matches(period, '^[0-9]{6}$'))
    GROUP BY ALL
    """,
    dates="Month",
    nums="total",
)
def parse_periods(spark, sf):
    ou = F.col("orgUnit")
    coded = (
        named(spark, sf)
        .withColumn("Category", F.when(~ou.isin("F3", "F4"), F.col("Category")))
        .withColumn(
            "period",
            F.when(ou == "F1", F.concat(F.substring("period", 1, 4), F.lit("Q1"))).when(ou != "F2", F.col("period")),
        )
        .withColumn("COUNT", F.when(ou != "F5", F.col("COUNT").cast("string")))
        .withColumn("SUM", F.when(ou == "F6", "n/a").otherwise(F.col("SUM").cast("string")))
    )
    return cf.parse_periods(coded).groupBy("data", "data_id", "Month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("SUM").alias("total"), F.countDistinct("orgUnit").alias("units")
    )


@query(
    "parse_weeks",
    """SELECT event_type AS data, CAST(date_trunc('week', ts) AS DATE) AS Week, CAST(count(*) AS BIGINT) AS n
       FROM events GROUP BY ALL""",
    dates="Week",
)
def parse_weeks(spark, sf):
    ev = fx.table(spark, sf, "events").select(
        F.lit("el").alias("dataElement_id"),
        F.lit(None).cast("string").alias("categoryOptionCombo_ids"),
        F.col("event_type").alias("dataElement"),
        F.lit(None).cast("string").alias("Category"),
        periods.week_code(F.col("ts").cast("date")).alias("period"),
        F.lit("1").alias("COUNT"),
        F.col("value").alias("SUM"),
    )
    return cf.parse_periods(ev, "Week").groupBy("data", "Week").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dedup_series",
    """SELECT 'F' || l_suppkey AS orgUnit, l_returnflag AS data_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS Month,
       min(l_quantity) AS "SUM" FROM lineitem GROUP BY ALL""",
    dates="Month",
    nums='"SUM"',
)
def dedup_series(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(
        F.concat(F.lit("F"), "l_suppkey").alias("orgUnit"),
        F.col("l_returnflag").alias("data_id"),
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("Month"),
        F.col("l_quantity").alias("SUM"),
    )
    return cf.dedup_series(li)


SQL["filled"] = """
WITH k AS (SELECT orgUnit, data_id, min(Region) AS Region FROM fact GROUP BY 1, 2),
m AS (SELECT CAST(unnest(generate_series((SELECT min(Month) FROM fact)::TIMESTAMP, (SELECT max(Month) FROM fact)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS Month)
SELECT k.orgUnit, k.data_id, k.Region, m.Month, f.original
FROM k CROSS JOIN m LEFT JOIN fact f ON f.orgUnit = k.orgUnit AND f.data_id = k.data_id AND f.Month = m.Month
"""


def filled(spark, sf):
    f = fx.fact(spark, sf).select("orgUnit", "data_id", "Region", "Month", "original")
    return cf.fill_gaps(f, ["orgUnit", "data_id"], carry=["Region"])


@query("fill_gaps", "SELECT * FROM filled", dates="Month", nums="original")
def fill_gaps(spark, sf):
    return filled(spark, sf)


@query(
    "prepare_facts",
    """
    SELECT n.orgUnit, t.orgUnitName, t."National", t.Region, t.District, t.Facility, t."level", s.dataSet, n.dataElement,
           n.dataElement || '_' || n.Category AS data, n.dataElement_id || '_' || n.categoryOptionCombo_ids AS data_id,
           CAST(strptime(n.period, '%Y%m') AS DATE) AS Month, TRUE AS effectiveLeaf, n."SUM" AS original, TRUE AS "value"
    FROM named n LEFT JOIN tree t ON n.orgUnit = t.orgUnit LEFT JOIN sets_per_element s ON n.dataElement_id = s.dataElement_id
    """,
    dates="Month",
    bools='effectiveLeaf "value"',
    nums="original",
)
def prepare_facts(spark, sf):
    return cf.prepare(
        fx.raw(spark, sf),
        fx.elements(spark, sf),
        fx.categories(spark, sf),
        fx.dataset_elements(spark, sf),
        fx.tree(spark, sf),
        scan_outliers=False,
    )


@query("prepare_facts_scanned")
def prepare_facts_scanned(spark, sf):
    """The whole preparation, with both outlier scans."""
    return cf.prepare(fx.raw(spark, sf), fx.elements(spark, sf), fx.categories(spark, sf), fx.dataset_elements(spark, sf), fx.tree(spark, sf))


@query(
    "flatten_tree",
    """
    WITH RECURSIVE w AS (
      SELECT id, name, leaf, [name] AS path FROM ous WHERE parent_id IS NULL
      UNION ALL SELECT o.id, o.name, o.leaf, list_append(w.path, o.name) FROM ous o JOIN w ON o.parent_id = w.id)
    SELECT id AS orgUnit, name AS orgUnitName, path[1] AS "National", path[2] AS Region, path[3] AS District,
           path[4] AS Facility, CAST(len(path) AS INTEGER) AS "level", leaf FROM w
    """,
    bools="leaf",
)
def flatten_tree(spark, sf):
    return cf.flatten_tree(fx.ous(spark, sf), fx.LEVELS)


@query(
    "drop_phantom_units",
    """SELECT o.* FROM ous o LEFT JOIN ous p ON o.parent_id = p.id LEFT JOIN ous g ON p.parent_id = g.id
       WHERE coalesce(p.name, '') <> 'ASIA' AND coalesce(g.name, '') <> 'ASIA'""",
    bools="leaf",
)
def drop_phantom_units(spark, sf):
    return cf.drop_phantom_units(fx.ous(spark, sf), "ASIA")


@query(
    "descendants",
    """SELECT DISTINCT o.name FROM ous o LEFT JOIN ous p ON o.parent_id = p.id LEFT JOIN ous g ON p.parent_id = g.id
       WHERE p.name = 'EUROPE' OR g.name = 'EUROPE'""",
)
def descendants(spark, sf):
    return cf.descendants(parented(spark, sf), " Europe")


@query("level_names", 'SELECT levelName, "level" FROM unit_levels')
def level_names(spark, sf):
    return cf.level_names(fx.ous(spark, sf).join(unit_levels(spark, sf), "level"))


@query(
    "parent_names",
    """SELECT o."level", l.levelName, o.id, o.name, o.leaf, o.parent_id, p.name AS parent
       FROM ous o LEFT JOIN unit_levels l ON o."level" = l."level" LEFT JOIN ous p ON o.parent_id = p.id""",
    bools="leaf",
)
def parent_names(spark, sf):
    return cf.with_parent_names(fx.ous(spark, sf), unit_levels(spark, sf))


# -- scalar functions ---------------------------------------------------------------


@query(
    "parse_month_layouts",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS Month, k, CAST(count(*) AS BIGINT) AS n
       FROM orders CROSS JOIN generate_series(0, 5) g(k) GROUP BY ALL""",
    dates="Month",
)
def parse_month_layouts(spark, sf):
    day = F.col("o_orderdate")
    written = F.array(*[F.date_format(day, p) for p in periods.MONTH_LAYOUTS])
    o = fx.table(spark, sf, "orders").select(F.posexplode(written).alias("k", "t"))
    return (
        o.select(periods.parse_month(F.col("t")).alias("Month"), F.col("k").cast("long").alias("k"))
        .groupBy("Month", "k")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "period_codes",
    """SELECT strftime(o_orderdate, '%Y%m') AS m_code, strftime(o_orderdate, '%GW%V') AS w_code,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS Month, CAST(date_trunc('week', o_orderdate) AS DATE) AS Week,
       CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL""",
    dates="Month Week",
)
def period_codes(spark, sf):
    day = F.col("o_orderdate").cast("date")
    coded = fx.table(spark, sf, "orders").select(
        periods.month_code(day).alias("m_code"), periods.week_code(day).alias("w_code")
    )
    return (
        coded.withColumn("Month", periods.month_from_code(F.col("m_code")))
        .withColumn("Week", periods.week_from_code(F.col("w_code")))
        .groupBy("m_code", "w_code", "Month", "Week")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "period_code_lists",
    """
    WITH d AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) + 14 AS as_of FROM orders)
    SELECT as_of,
      list_aggregate(list_transform(generate_series(make_date(year(as_of) - 1, 1, 1)::TIMESTAMP, date_trunc('month', as_of)::TIMESTAMP, INTERVAL 1 MONTH), lambda t: strftime(t, '%Y%m')), 'string_agg', ';') AS months,
      list_aggregate(list_transform(generate_series((date_trunc('month', as_of) - INTERVAL 2 MONTH)::TIMESTAMP, (date_trunc('month', as_of) - INTERVAL 1 MONTH)::TIMESTAMP, INTERVAL 1 MONTH), lambda t: strftime(t, '%Y%m')), 'string_agg', ';') AS recent,
      list_aggregate(list_transform(generate_series((date_trunc('month', as_of) - INTERVAL 3 MONTH)::TIMESTAMP, last_day(as_of)::TIMESTAMP, INTERVAL 7 DAY), lambda t: strftime(t, '%GW%V')), 'string_agg', ';') AS weeks
    FROM d
    """,
    dates="as_of",
)
def period_code_lists(spark, sf):
    d = fx.table(spark, sf, "orders").select(
        F.date_add(F.trunc(F.col("o_orderdate").cast("date"), "month"), 14).alias("as_of")
    ).distinct()
    a = F.col("as_of")
    return d.select(
        a,
        periods.month_codes(a).alias("months"),
        periods.month_codes(a, months_previous=2, include_current=False).alias("recent"),
        periods.week_codes(a, months_previous=3).alias("weeks"),
    )


@query(
    "estimate_text",
    r"""SELECT o_custkey, format('{:,d} [{:,d}-{:,d}]', CAST(trunc(sum(o_totalprice)) AS BIGINT), CAST(trunc(min(o_totalprice)) AS BIGINT), CAST(trunc(max(o_totalprice)) AS BIGINT)) AS label
       FROM orders GROUP BY 1""",
)
def estimate_text(spark, sf):
    o = fx.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("s"), F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b")
    )
    return o.select("o_custkey", text.estimate_text(F.col("s"), F.col("a"), F.col("b")).alias("label"))


@query(
    "rule_references",
    r"""
    SELECT id, regexp_replace(regexp_replace(left_raw || ' + ' || right_raw, '#\{([A-Za-z][A-Za-z0-9]{10})\.([A-Za-z][A-Za-z0-9]{10})\}', 'val_\1_\2', 'g'), '#\{([A-Za-z][A-Za-z0-9]{10})\}', 'val_\1', 'g') AS columns,
           replace(replace(replace(array_to_string(list_distinct(regexp_extract_all(left_raw || ' + ' || right_raw, '#\{[^}]*\}')).list_sort(), ','), '#{', ''), '}', ''), '.', '_') AS ids
    FROM rules
    """,
)
def rule_references(spark, sf):
    both = F.concat("left_raw", F.lit(" + "), "right_raw")
    return fx.rules(spark, sf).select(
        "id",
        text.expression_to_columns(both).alias("columns"),
        F.array_join(F.array_sort(text.uid_pairs(both)), ",").alias("ids"),
    )


@query(
    "base_elements",
    """SELECT DISTINCT data, regexp_replace(data, '_[^_]*$', '') AS base, split_part(data_id, '_', 1) AS uid FROM fact""",
)
def base_elements(spark, sf):
    return fx.fact(spark, sf).select(
        "data", text.base_element(F.col("data")).alias("base"), text.element_uid(F.col("data_id")).alias("uid")
    ).distinct()


@query(
    "merge_sex_categories",
    """SELECT o_orderpriority AS data, sum(o_totalprice) AS total FROM orders GROUP BY 1""",
    nums="total",
)
def merge_sex_categories(spark, sf):
    name = F.concat("o_orderpriority", F.when(F.col("o_custkey") % 2 == 0, ", Male").otherwise(", Female"))
    o = fx.table(spark, sf, "orders").select(name.alias("data"), "o_totalprice")
    return o.groupBy(text.strip_sex_suffix(F.col("data")).alias("data")).agg(F.sum("o_totalprice").alias("total"))


@query(
    "strip_invisible",
    r"""SELECT doc_id, regexp_replace("text", '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{AD}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]', '', 'g') AS "text", lang
        FROM documents""",
)
def strip_invisible(spark, sf):
    return text.strip_invisible(fx.table(spark, sf, "documents").select("doc_id", "text", "lang"))


@query(
    "truncate_strings",
    """SELECT doc_id, CASE WHEN length("text") > 500 THEN substr("text", 1, 500 - 9) || ' …[TRUNC]' ELSE "text" END AS "text"
       FROM documents""",
)
def truncate_strings(spark, sf):
    return text.truncate_strings(fx.table(spark, sf, "documents").select("doc_id", "text"))

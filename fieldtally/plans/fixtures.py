"""Facility-report tables derived from the driver's sales tables.

Each fixture exists twice: as a DataFrame and as a SQL common table
expression, so that both engines start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.joins import by_facility

LEVELS = ["National", "Region", "District", "Facility"]

SQL: dict[str, str] = {}


def cte_prefix(body: str) -> str:
    """``WITH`` clause holding every fixture a query body names, in order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, definition in SQL.items():
            if name not in needed and definition is not text and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return ""
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({SQL[n].strip()})" for n in needed) + "\n"


def sql_hash(*parts: str) -> str:
    """SQL text of :func:`fieldtally.functions.draws.hash32`."""
    return f"CAST(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS UBIGINT) AS BIGINT)"


def sql_uniform(*parts: str) -> str:
    return f"(({sql_hash(*parts)} + 0.5) / 4294967296.0)"


def sql_normal(*parts: str) -> str:
    u1, u2 = sql_uniform(*parts, "'u1'"), sql_uniform(*parts, "'u2'")
    return f"(sqrt(-2.0 * ln({u1})) * cos(2.0 * pi() * {u2}))"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- organisation tree ------------------------------------------------------

SQL["tree"] = """
SELECT 'F' || s_suppkey AS orgUnit, s_name AS orgUnitName, 'World' AS "National",
       r_name AS Region, n_name AS District, s_name AS Facility,
       4 AS "level", TRUE AS leaf
FROM supplier JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
"""


def tree(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.concat(F.lit("F"), "s_suppkey").alias("orgUnit"),
            F.col("s_name").alias("orgUnitName"),
            F.lit("World").alias("National"),
            F.col("r_name").alias("Region"),
            F.col("n_name").alias("District"),
            F.col("s_name").alias("Facility"),
            F.lit(4).alias("level"),
            F.lit(True).alias("leaf"),
        )
    )


# Organisation units as an edge list: one world node, regions, nations,
# suppliers.
SQL["ous"] = """
SELECT 'W' AS id, 'World' AS name, CAST(NULL AS VARCHAR) AS parent_id, 1 AS "level", FALSE AS leaf
UNION ALL SELECT 'R' || r_regionkey, r_name, 'W', 2, FALSE FROM region
UNION ALL SELECT 'D' || n_nationkey, n_name, 'R' || n_regionkey, 3, FALSE FROM nation
UNION ALL SELECT 'F' || s_suppkey, s_name, 'D' || s_nationkey, 4, TRUE FROM supplier
"""


def ous(spark: SparkSession, sf: str) -> DataFrame:
    def unit(df, ident, name, parent, level, leaf):
        return df.select(
            ident.alias("id"),
            name.alias("name"),
            parent.alias("parent_id"),
            F.lit(level).alias("level"),
            F.lit(leaf).alias("leaf"),
        )

    c = F.concat
    world = table(spark, sf, "region").select(F.lit("W").alias("w")).distinct()
    return (
        unit(world, F.col("w"), F.lit("World"), F.lit(None).cast("string"), 1, False)
        .unionByName(
            unit(table(spark, sf, "region"), c(F.lit("R"), "r_regionkey"), F.col("r_name"), F.lit("W"), 2, False)
        )
        .unionByName(
            unit(
                table(spark, sf, "nation"),
                c(F.lit("D"), "n_nationkey"),
                F.col("n_name"),
                c(F.lit("R"), "n_regionkey"),
                3,
                False,
            )
        )
        .unionByName(
            unit(
                table(spark, sf, "supplier"),
                c(F.lit("F"), "s_suppkey"),
                F.col("s_name"),
                c(F.lit("D"), "s_nationkey"),
                4,
                True,
            )
        )
    )


# -- raw extract ------------------------------------------------------------

SQL["raw"] = """
SELECT 'de' || l_returnflag || '00000001' AS dataElement,
       'cc' || l_linestatus || '00000001' AS categoryOptionCombo,
       strftime(l_shipdate, '%Y%m') AS period,
       'F' || l_suppkey AS orgUnit,
       CAST(1 AS INTEGER) AS "COUNT", sum(l_quantity) AS "SUM"
FROM lineitem GROUP BY ALL
"""


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.concat(F.lit("de"), "l_returnflag", F.lit("00000001")).alias("dataElement"),
            F.concat(F.lit("cc"), "l_linestatus", F.lit("00000001")).alias("categoryOptionCombo"),
            F.date_format("l_shipdate", "yyyyMM").alias("period"),
            F.concat(F.lit("F"), "l_suppkey").alias("orgUnit"),
        )
        .agg(F.lit(1).alias("COUNT"), F.sum("l_quantity").alias("SUM"))
    )


# -- dimensions of elements, categories and data sets ------------------------

SQL["elements"] = """
SELECT DISTINCT 'de' || l_returnflag || '00000001' AS dataElement_id,
       'Cases ' || l_returnflag AS dataElement, 'mix00000001' AS categoryCombo_id
FROM lineitem
"""


def elements(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .select("l_returnflag")
        .distinct()
        .select(
            F.concat(F.lit("de"), "l_returnflag", F.lit("00000001")).alias("dataElement_id"),
            F.concat(F.lit("Cases "), "l_returnflag").alias("dataElement"),
            F.lit("mix00000001").alias("categoryCombo_id"),
        )
    )


SQL["option_combos"] = """
SELECT DISTINCT 'cc' || l_linestatus || '00000001' AS categoryOptionCombo_id,
       l_linestatus AS categoryOptionCombo, 'mix00000001' AS categoryCombo_id,
       'Status' AS categoryCombo
FROM lineitem
"""


def option_combos(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .select("l_linestatus")
        .distinct()
        .select(
            F.concat(F.lit("cc"), "l_linestatus", F.lit("00000001")).alias("categoryOptionCombo_id"),
            F.col("l_linestatus").alias("categoryOptionCombo"),
            F.lit("mix00000001").alias("categoryCombo_id"),
            F.lit("Status").alias("categoryCombo"),
        )
    )


SQL["categories"] = """
SELECT categoryCombo_id, categoryCombo, CAST(count(*) AS BIGINT) AS n_categoryOptions,
       string_agg(categoryOptionCombo, ' ;\n ' ORDER BY categoryOptionCombo_id) AS Categories,
       string_agg(categoryOptionCombo_id, ' ;\n ' ORDER BY categoryOptionCombo_id) AS categoryOptionCombo_ids
FROM option_combos GROUP BY ALL
"""


def categories(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.metadata import category_rollup

    return category_rollup(option_combos(spark, sf))


# One data set per order priority, each holding the elements sold under it.
SQL["dataset_elements"] = """
SELECT DISTINCT 'ds' || substr(o_orderpriority, 1, 1) || '00000001' AS dataSet_id,
       o_orderpriority AS dataSet, 'Monthly' AS periodType,
       'de' || l_returnflag || '00000001' AS dataElement_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""


def dataset_elements(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    od = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return (
        li.join(od, li.l_orderkey == od.o_orderkey)
        .select(
            F.concat(F.lit("ds"), F.substring("o_orderpriority", 1, 1), F.lit("00000001")).alias("dataSet_id"),
            F.col("o_orderpriority").alias("dataSet"),
            F.lit("Monthly").alias("periodType"),
            F.concat(F.lit("de"), "l_returnflag", F.lit("00000001")).alias("dataElement_id"),
        )
        .distinct()
    )


# Validation rules between the elements present in the data, one per ordered
# pair of neighbours, plus rules on category pairs, arithmetic and an element
# that is absent.
SQL["rules"] = """
WITH e AS (SELECT dataElement_id AS a, lead(dataElement_id) OVER (ORDER BY dataElement_id) AS b FROM elements)
SELECT 'rule_gt_' || substr(a, 3, 1) AS id, a || ' above ' || b AS name, 'greater_than' AS operator,
       '#{' || a || '}' AS left_raw, '#{' || b || '}' AS right_raw FROM e WHERE b IS NOT NULL
UNION ALL
SELECT 'rule_le_' || substr(a, 3, 1), a || ' twice at most ' || b, 'less_than_or_equal_to',
       '#{' || a || '.ccF00000001}', '#{' || b || '.ccF00000001} * 2 + 10' FROM e WHERE b IS NOT NULL
UNION ALL
SELECT 'rule_pair_' || substr(a, 3, 1), a || ' with ' || b, 'compulsory_pair',
       '#{' || a || '.ccO00000001}', '#{' || b || '.ccO00000001}' FROM e WHERE b IS NOT NULL
UNION ALL
SELECT 'rule_gone_' || substr(a, 3, 1), a || ' equals absent', 'equal_to',
       '#{' || a || '}', '#{deZ00000009}' FROM e
UNION ALL
SELECT 'rule_nest_' || substr(a, 3, 1), a || ' nested', 'greater_than',
       '#{' || a || '}', '#{' || b || '} / (#{' || a || '} / #{' || b || '})' FROM e WHERE b IS NOT NULL
UNION ALL
SELECT 'rule_neg_' || substr(a, 3, 1), a || ' two signs', 'greater_than', '#{' || a || '}--1', '#{' || b || '}' FROM e WHERE b IS NOT NULL
UNION ALL
SELECT 'rule_zero_' || substr(a, 3, 1), a || ' by zero', 'compulsory_pair',
       '#{' || a || '} / (#{' || b || '} - #{' || b || '})', '#{' || b || '}' FROM e WHERE b IS NOT NULL
UNION ALL
SELECT 'rule_odd_' || substr(a, 3, 1), a || ' unreadable', 'compulsory_pair', '#{' || a || '} * / 2', '#{' || b || '}' FROM e WHERE b IS NOT NULL
"""


def rules(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = elements(spark, sf).select(
        F.col("dataElement_id").alias("a"),
        F.lead("dataElement_id").over(W.partitionBy("categoryCombo_id").orderBy("dataElement_id")).alias("b"),
    )
    ref = lambda c, cat="": F.concat(F.lit("#{"), c, F.lit(cat + "}"))

    def rule(kind, text, operator, left, right, when=None):
        made = F.struct(
            F.concat(F.lit(f"rule_{kind}_"), F.substring("a", 3, 1)).alias("id"),
            text.alias("name"),
            F.lit(operator).alias("operator"),
            left.alias("left_raw"),
            right.alias("right_raw"),
        )
        return F.when(b.isNotNull() if when is None else when, made)

    a, b = F.col("a"), F.col("b")
    f, o = ".ccF00000001", ".ccO00000001"
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    made = F.array(
        rule("gt", t(a, " above ", b), "greater_than", ref(a), ref(b)),
        rule("le", t(a, " twice at most ", b), "less_than_or_equal_to", ref(a, f), t(ref(b, f), " * 2 + 10")),
        rule("pair", t(a, " with ", b), "compulsory_pair", ref(a, o), ref(b, o)),
        rule("nest", t(a, " nested"), "greater_than", ref(a), t(ref(b), " / (", ref(a), " / ", ref(b), ")")),
        rule("neg", t(a, " two signs"), "greater_than", t(ref(a), "--1"), ref(b)),
        rule("zero", t(a, " by zero"), "compulsory_pair", t(ref(a), " / (", ref(b), " - ", ref(b), ")"), ref(b)),
        rule("odd", t(a, " unreadable"), "compulsory_pair", t(ref(a), " * / 2"), ref(b)),
        rule("gone", t(a, " equals absent"), "equal_to", ref(a), F.lit("#{deZ00000009}"), F.lit(True)),
    )
    return e.select(F.explode(F.array_compact(made)).alias("r")).select("r.*")


# -- processed facts ----------------------------------------------------------

# Six series of case counts and one of stock-out days per facility, with faults
# planted by hash: 1% of values times 20, 1% set to 1234, 1% missing.
SQL["fact"] = f"""
WITH cases AS (
  SELECT 'F' || l_suppkey AS orgUnit, 'Cases ' || l_returnflag AS dataElement,
         'Cases ' || l_returnflag || '_' || l_linestatus AS data,
         'de' || l_returnflag || '00000001_cc' || l_linestatus || '00000001' AS data_id,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS Month, sum(l_quantity) AS v
  FROM lineitem GROUP BY ALL
), stock AS (
  SELECT 'F' || l_suppkey AS orgUnit, 'Stock out days' AS dataElement, 'Stock out days' AS data,
         'deS00000001' AS data_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS Month,
         max(l_quantity) AS v
  FROM lineitem GROUP BY ALL
), hashed AS (
  SELECT *, {sql_hash("'plant'", "orgUnit", "data_id", "Month")} % 100 AS h
  FROM (SELECT * FROM cases UNION ALL SELECT * FROM stock)
)
SELECT hashed.orgUnit, orgUnitName, "level", "National", Region, District, Facility, dataElement, data,
       data_id, Month, TRUE AS effectiveLeaf,
       CASE h WHEN 0 THEN v * 20 WHEN 1 THEN 1234.0 WHEN 2 THEN NULL ELSE v END AS original
FROM hashed LEFT JOIN tree ON hashed.orgUnit = tree.orgUnit
"""


def fact(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        "l_suppkey",
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("Month"),
        "l_returnflag",
        "l_linestatus",
        "l_quantity",
    )
    # Cases and stock-out days are two grouping sets of one reading.
    month, series = ["l_suppkey", "Month"], ["l_returnflag", "l_linestatus"]
    rf, ls, stock = F.col("l_returnflag"), F.col("l_linestatus"), F.col("stock")
    sums = li.groupingSets([[*month, *series], month], *month, *series).agg(
        (F.grouping_id() > 0).alias("stock"), F.sum("l_quantity").alias("sum"), F.max("l_quantity").alias("top")
    )
    of = lambda days, *parts: F.when(stock, days).otherwise(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    values = sums.select(
        F.concat(F.lit("F"), "l_suppkey").alias("orgUnit"),
        of("Stock out days", "Cases ", rf).alias("dataElement"),
        of("Stock out days", "Cases ", rf, "_", ls).alias("data"),
        of("deS00000001", "de", rf, "00000001_cc", ls, "00000001").alias("data_id"),
        "Month",
        F.when(stock, F.col("top")).otherwise(F.col("sum")).alias("v"),
    )
    h = draws.hash32("plant", F.col("orgUnit"), F.col("data_id"), F.col("Month")) % 100
    return (
        by_facility(values.withColumn("h", h))
        .join(tree(spark, sf).drop("leaf"), "orgUnit", "left")
        .select(
            "orgUnit",
            "orgUnitName",
            "level",
            *LEVELS,
            "dataElement",
            "data",
            "data_id",
            "Month",
            F.lit(True).alias("effectiveLeaf"),
            F.when(F.col("h") == 0, F.col("v") * 20)
            .when(F.col("h") == 1, F.lit(1234.0))
            .when(F.col("h") == 2, F.lit(None))
            .otherwise(F.col("v"))
            .alias("original"),
        )
    )


def stored_fact(spark: SparkSession, sf: str) -> DataFrame:
    """The processed table as users have it."""
    return fact(spark, sf)


# Weekly facts from the event stream's table.
SQL["weekly"] = """
SELECT 'U' || user_id AS orgUnit, event_type AS data, CAST(date_trunc('week', ts) AS DATE) AS Week,
       sum(value) AS original
FROM events GROUP BY ALL
"""


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(
            F.concat(F.lit("U"), "user_id").alias("orgUnit"),
            F.col("event_type").alias("data"),
            F.date_trunc("week", "ts").cast("date").alias("Week"),
        )
        .agg(F.sum("value").alias("original"))
    )

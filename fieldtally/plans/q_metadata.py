"""Dimension table queries."""

from pyspark.sql import functions as F

from ..operators import metadata as md
from . import fixtures as fx
from .fixtures import SQL
from .q_conform import unit_levels
from .registry import query


@query(
    "duplicate_names",
    """WITH u AS (SELECT c_custkey AS id, c_mktsegment || c_nationkey AS name FROM customer),
       n AS (SELECT name, count(*) AS n FROM u GROUP BY 1 HAVING count(*) > 1)
       SELECT u.name, id, n FROM u JOIN n ON u.name = n.name""",
)
def duplicate_names(spark, sf):
    u = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.concat("c_mktsegment", "c_nationkey").alias("name")
    )
    return md.duplicate_names(u)


@query(
    "units_per_level",
    'SELECT l."level", levelName, count(*) AS "Number_Units" FROM ous o JOIN unit_levels l ON o."level" = l."level" GROUP BY ALL',
)
def units_per_level(spark, sf):
    return md.units_per_level(fx.ous(spark, sf), unit_levels(spark, sf))


@query("category_rollup", "SELECT * FROM categories")
def category_rollup(spark, sf):
    return fx.categories(spark, sf)


SQL["groups"] = """
SELECT DISTINCT 'de' || l_returnflag || '00000001' AS dataElement_id, 'Group ' || l_linenumber AS dataElementGroup FROM lineitem
"""


def groups(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        F.concat(F.lit("de"), "l_returnflag", F.lit("00000001")).alias("dataElement_id"),
        F.concat(F.lit("Group "), "l_linenumber").alias("dataElementGroup"),
    ).distinct()


def _u(c):
    return f"string_agg(DISTINCT {c}, E';\\n' ORDER BY {c}) AS {c}"


SQL["dictionary"] = f"""
SELECT e.dataElement_id, trim(e.dataElement) AS dataElement, trim(c.Categories) AS Categories, g.dataElementGroup, s.dataSet, s.periodType,
       e.categoryCombo_id, c.categoryOptionCombo_ids, s.dataSet_id, c.n_categoryOptions, c.categoryCombo
FROM elements e
LEFT JOIN (SELECT dataElement_id, {_u('dataSet')}, {_u('dataSet_id')}, {_u('periodType')} FROM dataset_elements GROUP BY 1) s ON e.dataElement_id = s.dataElement_id
LEFT JOIN (SELECT dataElement_id, {_u('dataElementGroup')} FROM groups GROUP BY 1) g ON e.dataElement_id = g.dataElement_id
LEFT JOIN categories c ON e.categoryCombo_id = c.categoryCombo_id
"""


def dictionary(spark, sf):
    return md.element_dictionary(
        fx.elements(spark, sf), fx.dataset_elements(spark, sf), groups(spark, sf), fx.categories(spark, sf)
    )


@query("element_dictionary", "SELECT * FROM dictionary")
def element_dictionary(spark, sf):
    return dictionary(spark, sf)


@query(
    "expressions_with_names",
    """SELECT id, replace(replace(replace(left_raw, 'deA00000001', '[Cases A]'), 'deN00000001', '[Cases N]'), 'deR00000001', '[Cases R]') AS translated,
       replace(replace(replace(replace(replace(right_raw, 'deA00000001', '[Cases A]'), 'deN00000001', '[Cases N]'), 'deR00000001', '[Cases R]'), '#{', ''), '}', '') AS tidy
       FROM rules""",
)
def expressions_with_names(spark, sf):
    names = fx.elements(spark, sf).select(F.col("dataElement_id").alias("id"), F.col("dataElement").alias("name"))
    rules = fx.rules(spark, sf)
    left = md.expressions_with_names(rules, names, "id", "left_raw").select("id", "translated")
    right = md.expressions_with_names(rules, names, "id", "right_raw").select(
        "id", md.tidy_formula(F.col("translated")).alias("tidy")
    )
    return left.join(right, "id")


SQL["bridge"] = r"""
SELECT DISTINCT id AS rule_id, unnest(regexp_extract_all(left_raw || ' ' || right_raw, '[A-Za-z][A-Za-z0-9]{10}')) AS element_id FROM rules
"""


@query("rule_elements", "SELECT * FROM bridge")
def rule_elements(spark, sf):
    return md.rule_elements(fx.rules(spark, sf))


@query(
    "related_elements",
    """
    WITH mine AS (SELECT 'deA00000001' AS e),
    hit AS (SELECT DISTINCT rule_id FROM bridge WHERE element_id IN (SELECT e FROM mine))
    SELECT b.element_id, d.dataElement, string_agg(DISTINCT r.name, '; ' ORDER BY r.name) AS rules
    FROM bridge b JOIN rules r ON b.rule_id = r.id JOIN elements d ON d.dataElement_id = b.element_id
    WHERE b.rule_id IN (SELECT rule_id FROM hit) AND b.element_id NOT IN (SELECT e FROM mine) GROUP BY ALL
    """,
)
def related_elements(spark, sf):
    formula = fx.elements(spark, sf).filter("dataElement_id = 'deA00000001'")
    return md.related_elements(fx.rules(spark, sf), formula, fx.elements(spark, sf))


SQL["formula_wide"] = """
SELECT 'Malaria' AS Formula_Name, 'primary' AS "role", e.dataElement, e.dataElement_id, c.Categories, c.categoryOptionCombo_ids
FROM elements e JOIN categories c ON e.categoryCombo_id = c.categoryCombo_id
"""


def formula_wide(spark, sf):
    return fx.elements(spark, sf).join(fx.categories(spark, sf), "categoryCombo_id").select(
        F.lit("Malaria").alias("Formula_Name"),
        F.lit("primary").alias("role"),
        "dataElement",
        "dataElement_id",
        "Categories",
        "categoryOptionCombo_ids",
    )


SQL["formula_rows"] = """
SELECT 'Malaria' AS Formula_Name, 'primary' AS "role", e.dataElement, e.dataElement_id, c.categoryOptionCombo AS Categories,
       c.categoryOptionCombo_id AS categoryOptionCombo_ids
FROM elements e JOIN option_combos c ON e.categoryCombo_id = c.categoryCombo_id
"""


def formula_rows(spark, sf):
    return md.explode_categories(formula_wide(spark, sf))


@query("explode_categories", "SELECT * FROM formula_rows")
def explode_categories(spark, sf):
    return formula_rows(spark, sf)


@query(
    "collapse_to_element",
    """SELECT Formula_Name, "role", dataElement, dataElement_id, string_agg(Categories, ' ; ' ORDER BY categoryOptionCombo_ids) AS Categories,
       string_agg(categoryOptionCombo_ids, ' ; ' ORDER BY categoryOptionCombo_ids) AS categoryOptionCombo_ids, count(*) AS n_categoryOptions
       FROM formula_rows GROUP BY ALL""",
)
def collapse_to_element(spark, sf):
    return md.collapse_to_element(formula_rows(spark, sf))


@query(
    "upsert_formula",
    """SELECT * FROM formula_rows WHERE dataElement_id <> 'deA00000001'
       UNION SELECT Formula_Name, 'secondary', dataElement, dataElement_id, Categories, categoryOptionCombo_ids FROM formula_rows
       WHERE dataElement_id = 'deA00000001'""",
)
def upsert_formula(spark, sf):
    rows = formula_rows(spark, sf)
    new = rows.filter("dataElement_id = 'deA00000001'").withColumn("role", F.lit("secondary"))
    return md.upsert_formula(rows, new.unionByName(new))


@query(
    "rows_per_formula_element",
    """SELECT r.*, dataElement || '_' || Categories AS series, n_rows FROM formula_rows r
       LEFT JOIN (SELECT data, count(*) AS n_rows FROM fact GROUP BY 1) f ON f.data = dataElement || '_' || Categories""",
)
def rows_per_formula_element(spark, sf):
    return md.rows_per_formula_element(formula_rows(spark, sf), fx.fact(spark, sf))


@query("element_series", "SELECT DISTINCT dataElement, data FROM fact")
def element_series(spark, sf):
    return md.element_series(fx.fact(spark, sf), formula_rows(spark, sf))


# Nations as unit squares on a five-by-five grid, regions as pairs of squares,
# suppliers as points; coordinates as JSON text.
SQL["geo_raw"] = """
SELECT 'D' || n_nationkey AS id, n_name AS na, '3' AS le, r_name AS pn, 2 AS ty,
       printf('[[[%d,%d],[%d,%d],[%d,%d],[%d,%d]]]', n_nationkey % 5, n_nationkey // 5, n_nationkey % 5 + 1, n_nationkey // 5,
              n_nationkey % 5 + 1, n_nationkey // 5 + 1, n_nationkey % 5, n_nationkey // 5 + 1) AS co
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 'R' || r_regionkey, r_name, '2', 'World', 3, printf('[[[[%d,0],[%d,1],[0,9]]],[[[5,5],[6,6],[7,%d]]]]', r_regionkey, r_regionkey, r_regionkey)
FROM region
UNION ALL
SELECT 'F' || s_suppkey, s_name, '4', n_name, 1, CASE WHEN s_suppkey % 10 <> 3 THEN printf('[%.2f,%.2f]', s_suppkey / 4.0, s_suppkey / 2.0) END
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""


def geo_raw(spark, sf):
    n, r, s = (fx.table(spark, sf, t) for t in ("nation", "region", "supplier"))
    x, y = F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5)
    areas = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("D"), "n_nationkey").alias("id"),
        F.col("n_name").alias("na"),
        F.lit("3").alias("le"),
        F.col("r_name").alias("pn"),
        F.lit(2).alias("ty"),
        F.format_string("[[[%d,%d],[%d,%d],[%d,%d],[%d,%d]]]", x, y, x + 1, y, x + 1, y + 1, x, y + 1).alias("co"),
    )
    k = F.col("r_regionkey")
    multi = r.select(
        F.concat(F.lit("R"), k).alias("id"),
        F.col("r_name").alias("na"),
        F.lit("2").alias("le"),
        F.lit("World").alias("pn"),
        F.lit(3).alias("ty"),
        F.format_string("[[[[%d,0],[%d,1],[0,9]]],[[[5,5],[6,6],[7,%d]]]]", k, k, k).alias("co"),
    )
    sk = F.col("s_suppkey")
    points = s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.concat(F.lit("F"), sk).alias("id"),
        F.col("s_name").alias("na"),
        F.lit("4").alias("le"),
        F.col("n_name").alias("pn"),
        F.lit(1).alias("ty"),
        F.when(sk % 10 != 3, F.format_string("[%.2f,%.2f]", sk / 4.0, sk / 2.0)).alias("co"),
    )
    return areas.unionByName(multi).unionByName(points)


SQL["geo"] = """
SELECT CAST(le AS INTEGER) AS "level", id, na AS name, pn AS parentName,
       CASE WHEN ty = 1 THEN CAST(json_extract(co, '$[0]') AS DOUBLE) END AS longitude,
       CASE WHEN ty = 1 THEN CAST(json_extract(co, '$[1]') AS DOUBLE) END AS latitude,
       CASE WHEN ty = 1 AND co IS NOT NULL THEN 'POINT' WHEN ty = 1 THEN 'EMPTY' WHEN ty = 3 THEN 'MULTIPOLYGON' ELSE 'POLYGON' END AS kind,
       CASE WHEN ty = 2 THEN 1 WHEN ty = 3 THEN 2 END AS n_rings, levelName
FROM geo_raw LEFT JOIN unit_levels ON CAST(le AS INTEGER) = unit_levels."level"
"""


def geo(spark, sf):
    return md.geo_features(geo_raw(spark, sf), unit_levels(spark, sf))


@query("geo_features", "SELECT * FROM geo", nums="longitude latitude")
def geo_features(spark, sf):
    return geo(spark, sf).withColumn("n_rings", F.when(F.col("rings").isNotNull(), F.size("rings"))).drop("rings")


@query(
    "polygons_at_level",
    """SELECT id, name, "level", kind FROM geo WHERE kind IN ('POLYGON', 'MULTIPOLYGON') AND "level" = 3""",
)
def polygons_at_level(spark, sf):
    return md.polygons_at(geo(spark, sf), 3).select("id", "name", "level", "kind")


@query(
    "polygons_per_level",
    """SELECT "level", levelName, count(*) AS n_polygons FROM geo WHERE kind IN ('POLYGON', 'MULTIPOLYGON') GROUP BY ALL""",
)
def polygons_per_level(spark, sf):
    return md.polygons_per_level(geo(spark, sf))


@query(
    "metadata_counts",
    """SELECT 'Organizational units' AS Attribute, count(*) AS Number FROM ous UNION ALL SELECT 'Data sets', count(*) FROM dataset_elements
       UNION ALL SELECT 'Data elements', count(*) FROM elements UNION ALL SELECT 'Categories', count(*) FROM categories""",
)
def metadata_counts(spark, sf):
    return md.metadata_counts(
        {
            "Organizational units": fx.ous(spark, sf),
            "Data sets": fx.dataset_elements(spark, sf),
            "Data elements": fx.elements(spark, sf),
            "Categories": fx.categories(spark, sf),
        }
    )


@query(
    "most_recent_period",
    """SELECT max(Month) AS newest, max(Month) - INTERVAL 1 MONTH AS before FROM fact""",
    dates="newest before",
)
def most_recent_period(spark, sf):
    f = fx.fact(spark, sf)
    return f.agg(F.max("Month").alias("newest")).withColumn(
        "before", md.most_recent(f, skip_latest=True).scalar()
    )

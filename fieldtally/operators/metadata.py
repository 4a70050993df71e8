"""Dimension tables: categories, elements, rules, formulas, geography."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def duplicate_names(units: DataFrame) -> DataFrame:
    """Units that share their name with another, with the number of units."""
    n = units.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return units.join(n, "name")


def units_per_level(units: DataFrame, levels: DataFrame) -> DataFrame:
    return levels.join(units.groupBy("level").agg(F.count(F.lit(1)).alias("Number_Units")), "level")


def category_rollup(option_combos: DataFrame) -> DataFrame:
    """Category combinations with their options joined into lists."""
    options = F.array_sort(F.collect_list(F.struct("categoryOptionCombo_id", "categoryOptionCombo")))
    return (
        option_combos.groupBy("categoryCombo_id", "categoryCombo")
        .agg(F.count(F.lit(1)).alias("n_categoryOptions"), options.alias("o"))
        .select(
            "categoryCombo_id",
            "categoryCombo",
            "n_categoryOptions",
            F.array_join("o.categoryOptionCombo", " ;\n ").alias("Categories"),
            F.array_join("o.categoryOptionCombo_id", " ;\n ").alias("categoryOptionCombo_ids"),
        )
    )


def _unique_text(column: str):
    """Distinct values of a column joined with ``;`` and a line break."""
    values = F.array_sort(F.collect_set(F.col(column).cast("string")))
    return F.array_join(values, ";\n").alias(column)


def element_dictionary(
    elements: DataFrame, dataset_elements: DataFrame, element_groups: DataFrame, categories: DataFrame
) -> DataFrame:
    """One row per element with data sets, groups and categories collapsed.

    Every side is collapsed to one row per element before joining, so the
    many-to-many product of data sets and groups is never built.
    """
    sets = dataset_elements.groupBy("dataElement_id").agg(
        _unique_text("dataSet_id"), _unique_text("dataSet"), _unique_text("periodType")
    )
    groups = element_groups.groupBy("dataElement_id").agg(_unique_text("dataElementGroup"))
    return (
        elements.withColumn("dataElement", F.trim("dataElement"))
        .join(sets, "dataElement_id", "left")
        .join(groups, "dataElement_id", "left")
        .join(categories, "categoryCombo_id", "left")
        .withColumn("Categories", F.trim("Categories"))
        .select(
            "dataElement_id", "dataElement", "Categories", "dataElementGroup", "dataSet", "periodType",
            "categoryCombo_id", "categoryOptionCombo_ids", "dataSet_id", "n_categoryOptions", "categoryCombo",
        )
    )


def _uids(expression: str):
    return F.regexp_extract_all(F.col(expression), F.lit(text.UID), F.lit(0))


def expressions_with_names(rules: DataFrame, names: DataFrame, key: str, expression: str) -> DataFrame:
    """Replace ids by ``[name]`` in an expression; unknown ids stay.

    ``names`` has ``id`` and ``name``. An expression holds a bounded handful
    of ids; their replacements are gathered per row and applied in turn.
    """
    found = rules.select(key, F.explode(F.array_distinct(_uids(expression))).alias("_uid"))
    known = names.select(F.col("id").alias("_uid"), F.col("name").alias("_name"))
    pairs = (
        found.join(known, "_uid")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_uid").alias("id"), F.col("_name").alias("name")))).alias("_p"))
    )
    swapped = F.aggregate(
        F.coalesce("_p", F.array().cast("array<struct<id:string,name:string>>")),
        F.col(expression),
        lambda acc, p: F.replace(acc, p["id"], F.concat(F.lit("["), p["name"], F.lit("]"))),
    )
    return rules.join(pairs, key, "left").withColumn("translated", swapped).drop("_p")


def tidy_formula(column):
    """Drop braces and hash signs and put spaces around plus signs."""
    return F.regexp_replace(F.regexp_replace(column, r"[{}#]", ""), r"\s*\+\s*", " + ")


def rule_elements(rules: DataFrame) -> DataFrame:
    """Bridge of element ids and the rules that mention them."""
    both = F.array_distinct(F.concat(_uids("left_raw"), _uids("right_raw")))
    return rules.select(F.explode(both).alias("element_id"), F.col("id").alias("rule_id"))


def related_elements(rules: DataFrame, formula: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Elements that share a rule with the formula but are not part of it,
    with the names of those rules."""
    bridge = rule_elements(rules)
    mine = formula.select(F.col("dataElement_id").alias("element_id")).distinct()
    hit_rules = bridge.join(mine, "element_id", "left_semi").select("rule_id").distinct()
    others = bridge.join(hit_rules, "rule_id", "left_semi").join(mine, "element_id", "left_anti")
    named = others.join(rules.select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name")), "rule_id")
    return (
        named.join(
            dictionary.select(F.col("dataElement_id").alias("element_id"), "dataElement"), "element_id"
        )
        .groupBy("element_id", "dataElement")
        .agg(F.array_join(F.array_sort(F.collect_set("rule_name")), "; ").alias("rules"))
    )


def explode_categories(formula: DataFrame, separator: str = ";") -> DataFrame:
    """One row per category of a formula with joined lists."""
    split = lambda c: F.split(F.col(c), separator)
    zipped = F.arrays_zip(split("Categories").alias("c"), split("categoryOptionCombo_ids").alias("i"))
    rest = [c for c in formula.columns if c not in ("Categories", "categoryOptionCombo_ids")]
    return formula.select(*rest, F.explode(zipped).alias("p")).select(
        *rest,
        F.trim(F.regexp_replace("p.c", r"\n", "")).alias("Categories"),
        F.trim(F.regexp_replace("p.i", r"\n", "")).alias("categoryOptionCombo_ids"),
    )


def collapse_to_element(formula: DataFrame) -> DataFrame:
    """One row per element with its categories joined and counted."""
    dropped = {"Categories", "categoryOptionCombo_ids", "n_categoryOptions", "categoryCombo", "categoryCombo_id"}
    keys = [c for c in formula.columns if c not in dropped]
    pairs = F.array_sort(
        F.collect_list(F.struct(F.trim("categoryOptionCombo_ids").alias("i"), F.trim("Categories").alias("c")))
    )
    return (
        formula.groupBy(*keys)
        .agg(pairs.alias("_p"), F.count(F.lit(1)).alias("n_categoryOptions"))
        .select(
            *keys,
            F.array_join("_p.c", " ; ").alias("Categories"),
            F.array_join("_p.i", " ; ").alias("categoryOptionCombo_ids"),
            "n_categoryOptions",
        )
    )


def upsert_formula(existing: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Replace the elements that come again and add the rest, without duplicates."""
    kept = existing.join(new_rows.select("dataElement_id").distinct(), "dataElement_id", "left_anti")
    return kept.select(*existing.columns).unionByName(new_rows.select(*existing.columns)).distinct()


def rows_per_formula_element(formula: DataFrame, facts: DataFrame) -> DataFrame:
    """Formula rows with the number of fact rows of their series."""
    first_cat = F.trim(F.regexp_replace("Categories", " ;(?s).*", ""))
    name = F.when(
        F.col("Categories").isNull() | (F.length(first_cat) == 0), F.trim("dataElement")
    ).otherwise(F.concat(F.trim("dataElement"), F.lit("_"), first_cat))
    counts = facts.groupBy(F.col("data").alias("series")).agg(F.count(F.lit(1)).alias("n_rows"))
    return formula.withColumn("series", name).join(counts, "series", "left")


def element_series(facts: DataFrame, formula: DataFrame) -> DataFrame:
    """Element name of every series: the formula's name for its element id,
    else the element name in the facts."""
    series = facts.select("data", "data_id", "dataElement").distinct().withColumnRenamed("dataElement", "_own")
    names = (
        formula.select("dataElement_id", "dataElement").distinct().withColumnRenamed("dataElement_id", "_id")
    )
    return (
        series.withColumn("_id", text.element_uid(F.col("data_id")))
        .join(names, "_id", "left")
        .select(F.coalesce("dataElement", "_own").alias("dataElement"), "data")
        .distinct()
    )


def geo_features(raw: DataFrame, levels: DataFrame) -> DataFrame:
    """Features from JSON coordinates: rings for areas, position for points.

    ``raw`` has ``id, na, le, pn, ty, co``. Type 1 is a point; anything else
    is read as rings (a polygon) or as lists of rings (several polygons).
    Rings are arrays of ``{x, y}``; unreadable coordinates give an empty kind.
    """
    xy = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    rings = F.from_json("co", "array<array<array<double>>>")
    multi = F.from_json("co", "array<array<array<array<double>>>>")
    deep = F.col("co").rlike(r"^\s*\[\s*\[\s*\[\s*\[")
    flat = F.when(deep, F.flatten(multi)).otherwise(rings)
    point = F.when(F.col("ty") == 1, F.from_json("co", "array<double>"))
    parsed = raw.select(
        "id",
        F.col("na").alias("name"),
        F.col("le").try_cast("int").alias("level"),
        F.col("pn").alias("parentName"),
        F.get(point, F.lit(0)).alias("longitude"),
        F.get(point, F.lit(1)).alias("latitude"),
        F.when(F.col("ty") != 1, F.transform(flat, lambda r: F.transform(r, xy))).alias("rings"),
        F.when((F.col("ty") != 1) & deep, F.size(multi)).when(F.col("ty") != 1, F.lit(1)).alias("_parts"),
    )
    kind = (
        F.when(F.col("longitude").isNotNull(), "POINT")
        .when(F.size("rings") > 0, F.when(F.col("_parts") > 1, "MULTIPOLYGON").otherwise("POLYGON"))
        .otherwise("EMPTY")
    )
    return parsed.withColumn("kind", kind).drop("_parts").join(
        levels.select("level", "levelName"), "level", "left"
    )


def polygons_at(features: DataFrame, level: int | None = None) -> DataFrame:
    """Non-empty areas, all or those of one level."""
    areas = features.filter(F.col("kind").isin("POLYGON", "MULTIPOLYGON"))
    return areas if level is None else areas.filter(F.col("level") == level)


def polygons_per_level(features: DataFrame) -> DataFrame:
    return (
        polygons_at(features)
        .groupBy("level", "levelName")
        .agg(F.count(F.lit(1)).alias("n_polygons"))
        .orderBy("level")
    )


def metadata_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Number of rows of each named table as Attribute and Number."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("Number")).select(F.lit(name).alias("Attribute"), "Number")
        out = one if out is None else out.unionByName(one)
    return out


def most_recent(facts: DataFrame, period: str = "Month", skip_latest: bool = False) -> DataFrame:
    """Newest period of a table, or the one before it."""
    newest = F.max(period)
    if skip_latest:
        newest = F.add_months(newest, -1) if period == "Month" else F.date_add(newest, -7)
    return facts.agg(newest.alias("most_recent"))

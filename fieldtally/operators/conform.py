"""Turn raw extracts into the processed long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import periods
from ..functions.joins import by_facility, with_dictionary

LIST_SEPARATOR = r" ;\n "


def first_match(dim: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """One row per key: the first by ``order_by``.

    Done as a minimum over structs, which combines on the map side, so a key
    with very many copies is not gathered in one task.
    """
    rest = [c for c in dim.columns if c not in keys]
    ordered = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)]
    best = F.min(F.struct(*ordered, *[F.col(c) for c in rest])).alias("_b")
    return dim.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def attach_formula(data: DataFrame, formula: DataFrame, order_by: list[str]) -> DataFrame:
    """Attach formula attributes by first match of element and category.

    Elements without categories in the formula match rows without one.
    Every input row is kept once.
    """
    dim = formula.withColumn(
        "_cat", F.when(F.col("n_categoryOptions").isNotNull(), F.col("categoryOptionCombo_ids"))
    ).drop("categoryOptionCombo_ids")
    dim = first_match(dim, ["dataElement_id", "_cat"], order_by)
    d = data.withColumnRenamed("dataElement", "dataElement_id").withColumnRenamed(
        "categoryOptionCombo", "categoryOptionCombo_ids"
    )
    dim = dim.filter(F.col("dataElement_id").isNotNull()).withColumnRenamed("_cat", "categoryOptionCombo_ids")
    return with_dictionary(d, dim, ["dataElement_id", "categoryOptionCombo_ids"], "orgUnit", null_safe=True)


def expand_categories(categories: DataFrame, separator: str = LIST_SEPARATOR) -> DataFrame:
    """Pair the delimited names and ids of each category combination."""
    split = lambda c: F.split(F.col(c), separator)
    pairs = F.explode(F.arrays_zip(split("Categories").alias("c"), split("categoryOptionCombo_ids").alias("i")))
    return categories.select("categoryCombo_id", "categoryCombo", pairs.alias("p")).select(
        "categoryCombo_id",
        "categoryCombo",
        F.trim("p.c").alias("Category"),
        F.trim("p.i").alias("categoryOptionCombo_id"),
    )


def attach_names(data: DataFrame, elements: DataFrame, categories: DataFrame) -> DataFrame:
    """Attach element and category names by first match of their ids."""
    el = first_match(elements.select("dataElement_id", "dataElement"), ["dataElement_id"], ["dataElement"])
    cat = first_match(
        expand_categories(categories).select("categoryOptionCombo_id", "Category"),
        ["categoryOptionCombo_id"],
        ["Category"],
    ).withColumnRenamed("categoryOptionCombo_id", "categoryOptionCombo_ids")
    data = data.withColumnRenamed("dataElement", "dataElement_id").withColumnRenamed(
        "categoryOptionCombo", "categoryOptionCombo_ids"
    )
    return with_dictionary(
        with_dictionary(data, el, ["dataElement_id"], "orgUnit"), cat, ["categoryOptionCombo_ids"], "orgUnit"
    )


def datasets_per_element(dataset_elements: DataFrame) -> DataFrame:
    """Number and joined names of the data sets an element belongs to."""
    sets = F.array_sort(F.collect_list(F.struct("dataSet_id", "dataSet")))
    return (
        dataset_elements.groupBy("dataElement_id")
        .agg(F.count(F.lit(1)).alias("n_datasets"), sets.alias("_s"))
        .select(
            "dataElement_id",
            "n_datasets",
            F.array_join("_s.dataSet_id", " ;\n").alias("dataSet_ids"),
            F.array_join("_s.dataSet", " ;\n").alias("dataSet"),
        )
    )


LEAF_KEYS = ["orgUnit", "dataElement_id", "leaf"]


def _largest_count() -> Column:
    return F.max(F.col("COUNT").try_cast("int"))


def _reports_itself(largest: Column) -> Column:
    return (largest == 1) | F.coalesce(F.col("leaf"), F.lit(False))


def effective_leaf(data: DataFrame) -> DataFrame:
    """Per facility, element and leaf mark: does the unit itself report?

    True for tree leaves and for units whose largest count is 1.
    """
    return (
        data.groupBy(*LEAF_KEYS)
        .agg(_largest_count().alias("n"))
        .select(*LEAF_KEYS, _reports_itself(F.col("n")).alias("effectiveLeaf"))
    )


def with_effective_leaf(data: DataFrame) -> DataFrame:
    """Each row with the mark of :func:`effective_leaf`, NULL without a facility or element.

    A window, so rows dealt by facility stay where they are and are read once.
    """
    known = F.col("orgUnit").isNotNull() & F.col("dataElement_id").isNotNull()
    mark = _reports_itself(_largest_count().over(W.partitionBy(*LEAF_KEYS)))
    return data.withColumn("effectiveLeaf", F.when(known, mark))


def _glue(first: Column, second: Column) -> Column:
    """``first_second`` where a missing part is left out."""
    tail = F.when(second.isNull(), F.lit("")).otherwise(F.concat(F.lit("_"), second))
    return F.concat(F.coalesce(first, F.lit("")), tail)


def parse_periods(df: DataFrame, period: str = "Month") -> DataFrame:
    """Keep rows with a count and a valid period code; add the time index and
    the series names ``data`` and ``data_id``."""
    code = F.col("period")
    if period == "Month":
        keep, index = code.rlike(periods.MONTH_CODE), periods.month_from_code(code)
    else:
        keep, index = code.rlike(periods.WEEK_CODE), periods.week_from_code(code)
    names_gone = F.col("dataElement").isNull() & F.col("Category").isNull()
    null = F.lit(None).cast("string")
    return (
        df.filter(F.col("COUNT").isNotNull() & keep)
        .withColumn(period, index)
        .withColumn("COUNT", F.col("COUNT").try_cast("int"))
        .withColumn("SUM", F.col("SUM").try_cast("double"))
        .withColumn("data", F.when(names_gone, null).otherwise(_glue(F.col("dataElement"), F.col("Category"))))
        .withColumn(
            "data_id",
            F.when(names_gone, null).otherwise(
                _glue(F.col("dataElement_id"), F.col("categoryOptionCombo_ids"))
            ),
        )
    )


def dedup_series(df: DataFrame, period: str = "Month", order_by: list[str] | None = None) -> DataFrame:
    """One row per facility, series and period; the first by ``order_by``."""
    keys = ["orgUnit", "data_id", period]
    order = order_by or [c for c in ("SUM", "COUNT") if c in df.columns]
    return first_match(df, keys, order).select(*df.columns)


def fill_gaps(
    df: DataFrame,
    keys: list[str],
    period: str = "Month",
    full: bool = True,
    carry: list[str] | None = None,
) -> DataFrame:
    """Add the missing periods of every series.

    With ``full`` every series spans the whole table, else its own first to
    last period. ``carry`` names columns constant within a series that are
    filled in; all other columns are NULL in added rows.
    """
    step = F.expr("interval 1 month") if period == "Month" else F.expr("interval 7 days")
    constants = [F.first(c, ignorenulls=True).alias(c) for c in (carry or [])]
    series = df.groupBy(*keys).agg(F.min(period).alias("_a"), F.max(period).alias("_b"), *constants)
    if full:
        a, b = df.agg(F.min(period)).scalar(), df.agg(F.max(period)).scalar()
    else:
        a, b = F.col("_a"), F.col("_b")
    frame = series.withColumn(period, F.explode(F.sequence(a, b, step))).drop("_a", "_b")
    cond = [F.col(f"f.{c}").eqNullSafe(F.col(f"d.{c}")) for c in keys]
    joined = frame.alias("f").join(
        df.drop(*(carry or [])).alias("d"), [*cond, F.col(f"f.{period}") == F.col(f"d.{period}")], "left"
    )
    fixed = {*keys, period, *(carry or [])}
    return joined.select(*[F.col(f"f.{c}") if c in fixed else F.col(f"d.{c}") for c in df.columns])


def prepare(
    raw: DataFrame,
    elements: DataFrame,
    categories: DataFrame,
    dataset_elements: DataFrame,
    tree: DataFrame,
    period: str = "Month",
    scan_outliers: bool = True,
) -> DataFrame:
    """Raw extract to processed facts: names, data sets, hierarchy, effective
    leaf, time index, one row per series and period, and outlier flags."""
    from .outliers import mad_flags, seasonal_flags

    if "COUNT" not in raw.columns:
        raise ValueError("the extract has no COUNT column")
    if "categoryOptionCombo" not in raw.columns:
        raw = raw.withColumn("categoryOptionCombo", F.lit(None).cast("string"))
    named = attach_names(raw.filter(F.col("SUM").isNotNull()), elements, categories)
    named = with_dictionary(named, datasets_per_element(dataset_elements), ["dataElement_id"], "orgUnit")
    # All that follows is by facility: rows are dealt once, and a task meets few units of the tree, which it looks up without a sort.
    placed = with_effective_leaf(by_facility(named).join(tree.hint("shuffle_hash"), "orgUnit", "left"))
    series = dedup_series(parse_periods(placed, period), period)
    out = series.withColumn("original", F.col("SUM")).withColumn("value", F.col("SUM").isNotNull())
    if scan_outliers:
        out = seasonal_flags(mad_flags(out, period=period), period=period)
    return out.drop(
        "SUM", "COUNT", "dataElement_id", "categoryOptionCombo_ids", "Category", "n_datasets", "dataSet_ids",
        "leaf", "period", "AllSmall", "scan_value", "not_mad",
    )


# -- organisation tree -------------------------------------------------------


# Deepest level that a tree is followed to; a cycle of parents is never entered
# from a root, so the limit only stops a tree that is deeper than this.
MAX_LEVELS = 10_000


def drop_phantom_units(units: DataFrame, phantom_parent: str, depth: int = 3) -> DataFrame:
    """Remove the children of a named placeholder and ``depth`` levels below.

    The units below are one recursive query, which runs one join a level when the
    result is used.
    """
    found = units.sparkSession.sql(
        """
        WITH RECURSIVE below(id, step) AS (
          SELECT u.id, 0 FROM {units} u JOIN {units} p ON u.parent_id = p.id WHERE p.name = :placeholder
          UNION ALL
          SELECT u.id, step + 1 FROM below b JOIN {units} u ON u.parent_id = b.id WHERE step < :depth)
        SELECT DISTINCT id FROM below LIMIT ALL
        """,
        {"placeholder": phantom_parent, "depth": depth},
        units=units.select("id", "name", "parent_id"),
    )
    return units.join(found, "id", "left_anti")


def flatten_tree(units: DataFrame, level_names: list[str]) -> DataFrame:
    """Edge list to one row per unit with one name column per level.

    One recursive query goes down from the roots, those without a parent in the
    table, whatever the ``level`` column says; ``level`` in the result is the
    length of the path. Units that no root reaches, because their parents form a
    cycle, have a path of their own name. A unit with an id that several rows share
    has one row for each row and path.
    """
    paths = units.sparkSession.sql(
        f"""
        WITH RECURSIVE tree(id, path) MAX RECURSION LEVEL {MAX_LEVELS} AS (
          SELECT u.id, array(u.name) FROM {{units}} u LEFT ANTI JOIN {{units}} p ON u.parent_id = p.id
          UNION ALL
          SELECT u.id, t.path || array(u.name) FROM tree t JOIN {{units}} u ON u.parent_id = t.id)
        SELECT DISTINCT id AS _id, path AS _path FROM tree LIMIT ALL
        """,
        units=units.select("id", "name", "parent_id"),
    )
    path = F.coalesce(F.col("_path"), F.array("name"))
    return units.join(paths, F.col("id") == F.col("_id"), "left").select(
        F.col("id").alias("orgUnit"),
        F.col("name").alias("orgUnitName"),
        *[F.get(path, F.lit(i)).alias(n) for i, n in enumerate(level_names)],
        F.size(path).alias("level"),
        "leaf",
    )


def descendants(units: DataFrame, node_name: str) -> DataFrame:
    """All units below a node, by name regardless of case and outer spaces.

    ``units`` has ``name`` and ``parentName``. Only names that are some unit's
    parent take part in the recursive query; each carries the names above it, so
    that a cycle ends where it closes. All other units are found by one semi-join
    with the names reached.
    """
    norm = lambda c: F.trim(F.lower(c))
    edges = units.select("name", norm(F.col("name")).alias("n"), norm(F.col("parentName")).alias("p"))
    inner = edges.select("n", "p").join(edges.select(F.col("p").alias("n")).distinct(), "n", "left_semi").distinct()
    reached = units.sparkSession.sql(
        f"""
        WITH RECURSIVE down(n, trail) MAX RECURSION LEVEL {MAX_LEVELS} AS (
          SELECT trim(lower(:node)), array(trim(lower(:node)))
          UNION ALL
          SELECT e.n, d.trail || array(e.n) FROM down d JOIN {{inner}} e ON e.p = d.n WHERE NOT array_contains(d.trail, e.n))
        SELECT DISTINCT n AS p FROM down LIMIT ALL
        """,
        {"node": node_name},
        inner=inner,
    )
    return edges.join(reached, "p", "left_semi").select("name").distinct()


def level_names(units: DataFrame) -> DataFrame:
    """Distinct level names in level order."""
    return (
        units.filter(F.col("level").isNotNull() & F.col("levelName").isNotNull())
        .groupBy("levelName")
        .agg(F.min("level").alias("level"))
        .orderBy("level")
    )


def with_parent_names(units: DataFrame, levels: DataFrame) -> DataFrame:
    """Add the level name and the parent's name; sorted by level, parent, name."""
    parents = units.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    return (
        units.join(levels.select("level", "levelName"), "level", "left")
        .join(parents, "parent_id", "left")
        .select("level", "levelName", "id", "name", "leaf", "parent_id", "parent")
        .orderBy("level", "parent", "name")
    )

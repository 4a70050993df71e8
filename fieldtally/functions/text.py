"""String helpers: identifiers in expressions, cleaning, display text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identifier and reference patterns of rule expressions.
UID = "[A-Za-z][A-Za-z0-9]{10}"
UID_PAIR_REF = r"#\{(" + UID + r")\.(" + UID + r")\}"
UID_BARE_REF = r"#\{(" + UID + r")\}"

# Code points removed by strip_invisible. Control characters
# other than tab, line feed and carriage return; soft hyphen; zero-width
# space, non-joiner and joiner; word joiner; byte order mark.
INVISIBLE = (
    "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}"
    "\\x{AD}\\x{200B}\\x{200C}\\x{200D}\\x{2060}\\x{FEFF}]"
)
# Fixed value: text that marks a shortened string.
CUT_MARK = " \u2026[TRUNC]"


def uid_pairs(expression: Column) -> Column:
    """Distinct ids an expression refers to: ``element_category`` for paired
    references, ``element`` for bare ones."""
    pairs = F.transform(
        F.regexp_extract_all(expression, F.lit(UID_PAIR_REF), F.lit(0)),
        lambda m: F.regexp_replace(m, UID_PAIR_REF, "$1_$2"),
    )
    bare = F.regexp_extract_all(expression, F.lit(UID_BARE_REF), F.lit(1))
    return F.array_distinct(F.concat(pairs, bare))


def expression_to_columns(expression: Column) -> Column:
    """Rewrite references as value column names (``val_<id>``)."""
    paired = F.regexp_replace(expression, UID_PAIR_REF, "val_$1_$2")
    return F.regexp_replace(paired, UID_BARE_REF, "val_$1")


def base_element(data: Column) -> Column:
    """Series name without its last ``_part``."""
    return F.regexp_replace(data, "_[^_]*$", "")


def element_uid(data_id: Column) -> Column:
    """Element id: everything before the first ``_``."""
    return F.regexp_replace(data_id, "_.*$", "")


def category_uid(data_id: Column) -> Column:
    """Category id: everything after the first ``_``, NULL without one."""
    return F.when(data_id.contains("_"), F.regexp_replace(data_id, "^[^_]*_", ""))


def strip_sex_suffix(name: Column) -> Column:
    """Drop a trailing ``, Male`` or ``, Female``."""
    return F.regexp_replace(name, r",\s*(Male|Female)\s*$", "")


def estimate_text(estimate: Column, lower: Column, upper: Column) -> Column:
    """``1,234 [1,000-1,500]``."""
    fmt = lambda c: F.format_number(c.cast("long"), 0)
    return F.concat(fmt(estimate), F.lit(" ["), fmt(lower), F.lit("-"), fmt(upper), F.lit("]"))


def percent_text(share: Column, digits: int) -> Column:
    return F.concat(F.format_number(share * 100, digits), F.lit("%"))


def strip_invisible(df: DataFrame) -> DataFrame:
    """Remove control and invisible characters from every string column."""
    return df.select(
        *[
            F.regexp_replace(F.col(f"`{f.name}`"), INVISIBLE, "").alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def truncate_strings(df: DataFrame, limit: int = 500, suffix: str | None = CUT_MARK) -> DataFrame:
    """Shorten strings above ``limit`` so that text plus suffix is ``limit`` long."""
    suffix = suffix or ""
    kept = max(limit - len(suffix), 0)

    def shorten(name: str) -> Column:
        c = F.col(f"`{name}`")
        return (
            F.when(F.length(c) > limit, F.concat(F.substring(c, 1, kept), F.lit(suffix)))
            .otherwise(c)
            .alias(name)
        )

    return df.select(
        *[
            shorten(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )

"""Months and weeks: parsing, codes and calendars.

A month is the DATE of its first day, an ISO week the DATE of its Monday.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month layouts tried in this order.
MONTH_LAYOUTS = ["MMMMyyyy", "MMMyyyy", "yyyy MMM", "MMM yyyy", "yyyyMM", "yyyy-MM"]
MONTH_CODE = r"^[0-9]{6}$"
WEEK_CODE = r"^[0-9]{4}W[0-9]+$"


def parse_month(text: Column, layouts: list[str] | None = None) -> Column:
    """First day of the month named in any of the known layouts, else NULL."""
    attempts = [F.try_to_timestamp(text, F.lit(p)) for p in (layouts or MONTH_LAYOUTS)]
    return F.trunc(F.coalesce(*attempts).cast("date"), "month")


def month_from_code(code: Column) -> Column:
    """``yyyymm`` to the first day of that month, NULL for anything else."""
    valid = F.when(code.rlike(MONTH_CODE), code)
    return F.try_to_timestamp(valid, F.lit("yyyyMM")).cast("date")


def monday(day: Column) -> Column:
    """Monday of the ISO week a date falls in."""
    return F.date_trunc("week", day).cast("date")


def week_from_code(code: Column) -> Column:
    """``yyyyWww`` (one or two week digits) to the Monday of that ISO week."""
    valid = F.when(code.rlike(WEEK_CODE), code)
    year = F.substring(valid, 1, 4).cast("int")
    week = F.regexp_extract(valid, r"W([0-9]+)$", 1).cast("int")
    first = monday(F.make_date(year, F.lit(1), F.lit(4)))
    return F.date_add(first, (week - 1) * 7)


def month_code(month: Column) -> Column:
    return F.date_format(month, "yyyyMM")


def week_code(day: Column) -> Column:
    """ISO ``yyyyWww`` of the week a date falls in."""
    thursday = F.date_add(monday(day), 3)
    return F.concat(
        F.year(thursday).cast("string"),
        F.lit("W"),
        F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
    )


def months_since_epoch_to_date(months: Column) -> Column:
    return F.add_months(F.lit("1970-01-01").cast("date"), months.cast("int"))


def month_codes(
    as_of: Column,
    start: Column | None = None,
    years_previous: int = 1,
    months_previous: int | None = None,
    include_current: bool = True,
) -> Column:
    """``;``-joined month codes from a start up to the month of ``as_of``.

    The start is ``start`` when given, else ``months_previous`` months
    before ``as_of``, else January ``years_previous`` years earlier.
    """
    end = F.trunc(as_of, "month")
    begin = _first_month(as_of, start, years_previous, months_previous)
    codes = F.transform(F.sequence(begin, end, F.expr("interval 1 month")), month_code)
    return F.array_join(_drop_last(codes, include_current), ";")


def week_codes(
    as_of: Column,
    start: Column | None = None,
    years_previous: int = 1,
    months_previous: int | None = None,
    include_current: bool = True,
) -> Column:
    """``;``-joined ISO week codes, stepping seven days from the first of
    the start month to the last day of the month of ``as_of``."""
    end = F.last_day(as_of)
    begin = _first_month(as_of, start, years_previous, months_previous)
    codes = F.transform(F.sequence(begin, end, F.expr("interval 7 days")), week_code)
    return F.array_join(_drop_last(codes, include_current), ";")


def _first_month(as_of, start, years_previous, months_previous):
    if start is not None:
        return F.trunc(start, "month")
    if months_previous is not None:
        return F.add_months(F.trunc(as_of, "month"), -months_previous)
    return F.add_months(F.trunc(as_of, "year"), -12 * years_previous)


def _drop_last(codes: Column, keep: bool) -> Column:
    return codes if keep else F.slice(codes, F.lit(1), F.size(codes) - 1)


def period_column(df: DataFrame) -> str:
    """Name of the time index a table carries."""
    return "Week" if "Week" in df.columns else "Month"

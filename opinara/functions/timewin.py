"""Calendar helpers. Every function takes the clock as an argument."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import AT_MONTH


def instant(as_of: Column | datetime | None) -> Column:
    """The reference moment: a Column, a datetime, or now."""
    if as_of is None:
        return F.current_timestamp()
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def last_n_days(at: Column, days: int, as_of: Column | datetime | None = None) -> Column:
    """``at`` within the ``days`` x 24 hours before ``as_of`` (no upper bound)."""
    return at >= instant(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


def monday_of(ts: Column) -> Column:
    """The Monday that starts the week of ``ts``, as a date."""
    return F.trunc(F.to_date(ts), "week")


def date_bound(value: str | date | None) -> Column:
    """A date, or NULL (no bound) when the value is empty or does not parse."""
    if value is None:
        return F.lit(None).cast("date")
    if isinstance(value, str):
        return F.try_to_date(F.nullif(F.lit(value), F.lit("")))
    return F.lit(value)


def between_dates(at: Column, start: str | date | None, end: str | date | None) -> Column:
    """Inclusive, tolerant date range on the day of ``at``.

    Written as bounds on ``at`` itself, which reach the file scan for both timestamp types.
    """
    lo, hi = date_bound(start), date_bound(end)
    return (lo.isNull() | (at >= lo)) & (hi.isNull() | (at < F.date_add(hi, 1)))


def month_of(at: Column) -> Column:
    """The partition value of a review time; NULL stays NULL."""
    return F.trunc(F.to_date(at), "month")


def in_months(rows: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """A bound on ``at`` carried over to the month partitions; tables without them stay as they are.

    ``first`` and ``last`` bound the times that are wanted; NULL is no bound. A day of slack on either
    side keeps it right if rows were written under another time zone. The exact filter on ``at`` is
    still the caller's.
    """
    if AT_MONTH not in rows.columns:
        return rows
    month = F.col(AT_MONTH)
    if first is not None:
        rows = rows.filter(first.isNull() | (month >= F.trunc(F.date_sub(F.to_date(first), 1), "month")))
    if last is not None:
        rows = rows.filter(last.isNull() | (month <= F.date_add(F.to_date(last), 1)))
    return rows

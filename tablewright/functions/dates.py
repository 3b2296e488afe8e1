"""Date expressions and date-window arithmetic."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def completed_months(start: Column, end: Column) -> Column:
    """Whole months between two dates; a month not yet completed does not count."""
    return F.timestamp_diff("MONTH", start.cast("timestamp"), end.cast("timestamp"))


def days_back(moment: Column, days: Column | int) -> Column:
    """``moment`` moved back by whole days, keeping the time of day."""
    count = F.lit(days) if isinstance(days, int) else days
    return moment - F.make_dt_interval(count)


def decade_of(moment: Column) -> Column:
    """First year of the decade that holds ``moment``."""
    return (F.floor(F.year(moment) / 10) * 10).cast("int")


def decade_start(decade: Column) -> Column:
    return F.make_date(decade, F.lit(1), F.lit(1))


def decade_end(decade: Column) -> Column:
    """First day of the next decade; decade windows include it."""
    return F.make_date(decade + 10, F.lit(1), F.lit(1))


def month_start(moment: Column) -> Column:
    return F.trunc(moment, "month")


def iso_date(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def long_date(moment: Column) -> Column:
    """``March 07, 1999``."""
    return F.date_format(moment, "MMMM dd, yyyy")


def parse_moment(text: Column, pattern: str | None = None) -> Column:
    """Text to timestamp; unreadable text becomes NULL instead of failing the job."""
    return F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.try_to_timestamp(text)


def previous_range(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """The window of the same length, in whole days, that ends where this one starts.

    When the shifted window cannot be formed the window itself is returned.
    """
    try:
        length = timedelta(days=(end - start).days)
        return start - length, end - length
    except (OverflowError, TypeError):
        return start, end

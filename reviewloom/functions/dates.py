"""Date columns: yyyymmdd ids, reporting windows and preset ranges."""

from __future__ import annotations

import calendar
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two-digit years from 69 on belong to the last century.
FIRST_OLD_YEAR = 2069


def date_id(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd").cast("int")


def from_date_id(dateid: Column) -> Column:
    return F.to_date(dateid.cast("string"), "yyyyMMdd")


def month_of(label: Column) -> Column:
    """First day of a month written ``MMM-YY``."""
    first = F.to_date(label, "MMM-yy")
    return F.when(F.year(first) >= FIRST_OLD_YEAR, F.add_months(first, -1200)).otherwise(first)


def reporting_window(label: Column, months: int) -> Column:
    """``struct(StartDateID, EndDateID)``: the month's end, and the end of the
    month ``months`` earlier.  Both days belong to the window."""
    end = F.last_day(month_of(label))
    start = F.last_day(F.add_months(month_of(label), -months))
    return F.struct(date_id(start).alias("StartDateID"), date_id(end).alias("EndDateID"))


def window_ids(label: str, months: int) -> tuple[int, int]:
    """The same window for one label given as a parameter."""
    end = datetime.strptime(label, "%b-%y")
    count = end.year * 12 + end.month - 1 - months

    def last_day(year: int, month: int) -> int:
        return year * 10000 + month * 100 + calendar.monthrange(year, month)[1]

    return last_day(count // 12, count % 12 + 1), last_day(end.year, end.month)


def preset_start(first: Column, last: Column, months: int) -> Column:
    """Start of "the last ``months`` months", never before the first day there is."""
    return F.greatest(first, F.add_months(last, -months))

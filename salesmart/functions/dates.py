"""Date and time expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text form of an invoice time, month/day/year hour:minute,
# padded or not, with any white space around or between the two halves.
# The second alternative swallows everything else.
_INVOICE_TIME = r"(?s)^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{1,2})\s*$|^.*$"


def parse_invoice_time(text: Column) -> Column:
    """TIMESTAMP_NTZ of a month/day/year hour:minute text, NULL if malformed.

    The text is rearranged to ISO order and cast without a time zone.  A
    format-driven parse would go through the session zone, where times inside a
    daylight-saving gap do not exist and would come out an hour late.
    """
    iso = F.regexp_replace(text, _INVOICE_TIME, "$3-$1-$2 $4:$5")
    return iso.try_cast("timestamp_ntz")


def date_key(day: Column) -> Column:
    """The BIGINT yyyymmdd key shared by the calendar and the fact."""
    return F.year(day).cast("bigint") * 10000 + F.month(day) * 100 + F.day(day)


def month_start(day: Column) -> Column:
    """First day of the month, as a DATE."""
    return F.trunc(day, "MM")


def week_from_sunday(day: Column) -> Column:
    """Week of the year, 0 to 53: weeks start on Sunday, days before the first
    Sunday are week 0.  (Spark's ``weekofyear`` is the ISO week, a different number.)
    """
    return F.floor((F.dayofyear(day) + 7 - F.dayofweek(day)) / 7)


def day_or_today(as_of: date | None) -> Column:
    """The given day, or the current date when none is given."""
    return F.current_date() if as_of is None else F.lit(as_of)

"""Partial-precision dates: year, optional month, optional day, kept with a sort key.

``sort = year * 10000 + month * 100 + day`` with 0 for a missing part. Values stay structs of
integers; they are never cast to a calendar date, so a missing part keeps meaning "unknown".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names in the order of the months.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
FULL_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sort_key(year, month, day) -> Column:
    zero = F.lit(0)
    return (_col(year) * 10000 + F.coalesce(_col(month), zero) * 100 + F.coalesce(_col(day), zero)).cast("int")


def partial_date(year, month=None, day=None) -> Column:
    """Struct (year, month, day, sort); null where the year is."""
    null = F.lit(None).cast("int")
    y = _col(year).cast("int")
    m = _col(month).cast("int") if month is not None else null
    d = _col(day).cast("int") if day is not None else null
    return F.when(y.isNotNull(), F.struct(y.alias("year"), m.alias("month"), d.alias("day"), sort_key(y, m, d).alias("sort")))


def in_month(sort, year: int, month: int) -> Column:
    """Month-precision rows are in their month, year-only rows in none; an impossible month has no rows."""
    if not (1 <= month <= 12 and 1000 <= year <= 9999):
        return F.lit(False)
    low = year * 10000 + month * 100
    return _col(sort).between(low, low + 99)


def upcoming(sort, day, today: int) -> Column:
    """Not before this month, and not before today where a day is known."""
    month_start = today // 100 * 100
    return (_col(sort) >= month_start) & ((_col(sort) >= today) | _col(day).isNull())


def possibly_future(year, month, day, today: int) -> Column:
    """Whether the latest day it could mean is after today."""
    return (_col(year) * 10000 + F.coalesce(_col(month), F.lit(12)) * 100 + F.coalesce(_col(day), F.lit(31))) > today


def precision(month, day) -> Column:
    return F.when(_col(month).isNull(), 1).when(_col(day).isNull(), 2).otherwise(3)


def consistent(a_year, a_month, a_day, b_year, b_month, b_day) -> Column:
    """They agree on every part that both give."""
    month_ok = _col(a_month).isNull() | _col(b_month).isNull() | (_col(a_month) == _col(b_month))
    day_ok = _col(a_day).isNull() | _col(b_day).isNull() | (_col(a_day) == _col(b_day))
    return (_col(a_year) == _col(b_year)) & month_ok & day_ok


def display(year, month, day) -> Column:
    """"Aug 4, 2026", "Aug 2026" or "2026"."""
    y = _col(year).cast("string")
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.coalesce(_col(month), F.lit(1)).cast("int"))
    return F.when(_col(month).isNull(), y).when(_col(day).isNull(), F.concat(name, F.lit(" "), y)).otherwise(F.concat(name, F.lit(" "), _col(day).cast("string"), F.lit(", "), y))


def iso(year, month, day) -> Column:
    """yyyy, yyyy-mm or yyyy-mm-dd."""
    two = lambda c: F.lpad(_col(c).cast("string"), 2, "0")
    y = F.lpad(_col(year).cast("string"), 4, "0")
    return F.when(_col(month).isNull(), y).when(_col(day).isNull(), F.concat_ws("-", y, two(month))).otherwise(F.concat_ws("-", y, two(month), two(day)))


def _number(text, pattern: str, i: int) -> Column:
    """The group as a number; a cast of an empty text raises and catches an error for each row, so it is null before."""
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).try_cast("int")


def from_iso(text) -> Column:
    """Partial date of a leading yyyy-mm-dd with possible month and day; else null."""
    t = _col(text)
    part = lambda i: _number(t, r"^(\d{4})-(\d{2})-(\d{2})", i)
    ok = t.rlike(r"^\d{4}-\d{2}-\d{2}") & part(2).between(1, 12) & part(3).between(1, 31)
    return F.when(ok, partial_date(part(1), part(2), part(3)))


#: The shapes of report dates and of dates in prose.
REPORTED = r"^(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?$"
DASHED = r"^(\d{4})-(\d{2})(?:-(\d{2}))?$"
WORDED = r"^([A-Za-z]+)\.?\s+(?:(\d{1,2})(?:st|nd|rd|th)?,?\s+)?(\d{4})$"


def degrade(text) -> Column:
    """Partial date of yyyy, yyyy-mm or yyyy-mm-dd that loses impossible parts; years 1900 to 2200 only."""
    t = F.trim(_col(text))
    y, m, d = (_number(t, REPORTED, i) for i in (1, 2, 3))
    month = F.when(m.between(1, 12), m)
    day = F.when(month.isNotNull() & d.between(1, 31), d)
    return F.when(y.between(1900, 2200), partial_date(y, month, day))


def from_us(text) -> Column:
    """Partial date of "Month D, YYYY" with a full month name and a day of 1 to 31; else null."""
    t = F.trim(_col(text))
    at = lambda i: F.regexp_extract(t, r"^([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})$", i)
    names = F.array(*[F.lit(m.lower()) for m in FULL_MONTHS])
    m = F.array_position(names, F.lower(at(1))).cast("int")
    d = at(2).try_cast("int")
    return F.when((m > 0) & d.between(1, 31), partial_date(at(3).try_cast("int"), m, d))


def from_prose(text) -> Column:
    """Partial date of "Oct 13, 2026", "October 2026", "2026-10-13", "2026-10" or "2026"; impossible or unknown parts are lost, other shapes are null."""
    t = F.trim(_col(text))
    number = lambda pattern, i: _number(t, pattern, i)
    named = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(F.left(F.regexp_extract(t, WORDED, 1), F.lit(3)))).cast("int")
    y = F.coalesce(number(DASHED, 1), number(WORDED, 3), number(r"^(\d{4})$", 1))
    m = F.coalesce(number(DASHED, 2), named)
    month = F.when(m.between(1, 12), m)
    d = F.coalesce(number(DASHED, 3), number(WORDED, 2))
    return F.when(y.isNotNull(), partial_date(y, month, F.when(month.isNotNull() & d.between(1, 31), d)))


def add_months(index, n: int) -> Column:
    """Struct (year, month) of ``year * 12 + month - 1`` moved by n months, also below zero."""
    i = _col(index) + n
    return F.struct(F.floor(i / 12).cast("int").alias("year"), (F.pmod(i, F.lit(12)) + 1).cast("int").alias("month"))


def parse_month(text) -> Column:
    """Struct (year, month) of a strict yyyy-mm from year 1000 on; else null."""
    y, m = (F.regexp_extract(_col(text), r"^([0-9]{4})-([0-9]{2})$", i).try_cast("int") for i in (1, 2))
    return F.when((y >= 1000) & m.between(1, 12), F.struct(y.alias("year"), m.alias("month")))


def month_param(year, month) -> Column:
    return F.concat(F.lpad(_col(year).cast("string"), 4, "0"), F.lit("-"), F.lpad(_col(month).cast("string"), 2, "0"))


def month_title(year, month) -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, FULL_MONTHS)), _col(month)), F.lit(" "), _col(year).cast("string"))


def days_in_month(year, month) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(_col(year), _col(month), F.lit(1))))


def first_weekday(year, month) -> Column:
    """0 is Sunday."""
    return F.dayofweek(F.make_date(_col(year), _col(month), F.lit(1))) - 1


def day_key(day) -> Column:
    """yyyymmdd of a date or time, as sort keys have it."""
    return F.date_format(_col(day), "yyyyMMdd").cast("int")

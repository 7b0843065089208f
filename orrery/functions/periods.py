"""The period that a phrase names: `from` and `to` dates of an entry such as "December 2008 and January 2009"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.dates import MONTHS

_FULL = sorted((name for name, _ in MONTHS if len(name) > 4 or name in ("june", "july", "may")), key=dict(MONTHS).get)
_MARK = rf"\b({'|'.join(_FULL)}|(?:18|19|20)\d\d)\b"


def period_of(phrase: Column) -> Column:
    """``from_date, to_date`` of a column's phrases, in SQL functions; nulls where no year is named.

    A phrase is read as its marks, the months' full names and the years, in
    order. A month belongs to the first year behind it or, with none behind it,
    to the last year; the period runs from the earliest month to the latest.
    Days narrow it where one month is named, days beyond a month's end count as
    that end. Without months it is whole years. Letter case does not matter.
    """
    low = F.lower(F.coalesce(phrase, F.lit("")))
    marks = F.regexp_extract_all(low, F.lit(_MARK), F.lit(1))
    is_year = lambda m: m.rlike("^[0-9]")
    names = F.array(*map(F.lit, _FULL))
    years = F.transform(F.filter(marks, is_year), lambda y: y.cast("int"))

    def placed(mark: Column, at: Column) -> Column:
        behind = F.filter(F.slice(marks, at + 2, F.size(marks)), is_year)
        year = F.coalesce(F.try_element_at(behind, F.lit(1)).cast("int"), F.try_element_at(years, F.lit(-1)))
        return F.when(~is_year(mark), year * 12 + F.array_position(names, mark).cast("int") - 1)

    months = F.array_compact(F.transform(marks, placed))
    days = F.transform(F.regexp_extract_all(low, F.lit(r"\b(\d{1,2})(?:st|nd|rd|th)?\b"), F.lit(1)), lambda d: d.cast("int"))
    days = F.when(F.size(months) == 1, days)
    year, month = (lambda m: F.floor(m / 12).cast("int")), (lambda m: (m % 12 + 1).cast("int"))
    first, last = F.array_min(months), F.array_max(months)

    def day_in(m: Column, wanted: Column) -> Column:
        end = F.dayofmonth(F.last_day(F.make_date(year(m), month(m), F.lit(1))))
        return F.make_date(year(m), month(m), F.greatest(F.lit(1), F.least(wanted, end)))

    whole = F.size(months) == 0
    begin = F.when(whole, F.make_date(F.array_min(years), F.lit(1), F.lit(1))).otherwise(day_in(first, F.coalesce(F.array_min(days), F.lit(1))))
    end = F.when(whole, F.make_date(F.array_max(years), F.lit(12), F.lit(31))).otherwise(day_in(last, F.coalesce(F.array_max(days), F.lit(31))))
    named = F.size(years) > 0
    return F.struct(F.when(named, begin).alias("from_date"), F.when(named, end).alias("to_date"))

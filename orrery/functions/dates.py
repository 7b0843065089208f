"""Dates and months in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, longer ones first; the first name contained wins.
MONTHS = [
    ("january", 1), ("february", 2), ("september", 9), ("november", 11), ("december", 12), ("october", 10), ("august", 8),
    ("march", 3), ("april", 4), ("june", 6), ("july", 7), ("sept", 9), ("jan", 1), ("feb", 2), ("mar", 3), ("apr", 4),
    ("may", 5), ("jun", 6), ("jul", 7), ("aug", 8), ("sep", 9), ("oct", 10), ("nov", 11), ("dec", 12),
]


def _at(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _int(text: Column) -> Column:
    return text.try_cast("int")


def month_by_name(text: Column) -> Column:
    low, out = F.lower(text), F.lit(None).cast("int")
    for name, number in reversed(MONTHS):
        out = F.when(low.contains(name), F.lit(number)).otherwise(out)
    return out


def _make(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


_DOTTED = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?:\s.*)?$"
_NAMED = r"^(\d{1,2})[-/ ]([A-Za-z]{3,9})[-/ ](\d{4})(?:\s.*)?$"
_YEAR_FIRST = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[ T].*)?$"
_SLASHED = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})(?:\s.*)?$"
_EPOCH = r"^\d{10,13}$"
_SHORT_YEAR = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2})(?:\s.*)?$"
_MONTH_FIRST = r"^([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?:\s.*)?$"
#: Two-digit years from this one on are of the last century.
PIVOT = 70
#: A date within a text: day, month by number or name, year, as :func:`mixed_date` has them at a text's start.
WITHIN = rf"(?i)\b\d{{1,2}}[-/.\s]+(?:\d{{1,2}}|{'|'.join(n for n, _ in MONTHS)})[-/.,\s]+(?:19|20)\d{{2}}\b"


def mixed_date(text: Column) -> Column:
    """A date from text in one of several layouts, tried in a fixed order; null where none fits.

    ``d.m.yyyy`` is day first; ``d-Mon-yyyy`` and ``d Month yyyy``; year first;
    10 to 13 digits are an epoch, in milliseconds over 1e12; slashes are month
    first unless the first number is over 12, and day first where month first
    is no date; so with years of two digits, which are of this century up to
    PIVOT. ``Month d, yyyy`` comes last.
    """
    t = F.trim(text)
    epoch = t.try_cast("long")
    seconds = F.when(epoch > 10**12, (epoch / 1000).cast("long")).otherwise(epoch)
    a, b, year = _int(_at(t, _SLASHED, 1)), _int(_at(t, _SLASHED, 2)), _int(_at(t, _SLASHED, 3))
    slashed = F.when(a > 12, _make(year, b, a)).otherwise(F.coalesce(_make(year, a, b), _make(year, b, a)))
    c, d, short = (_int(_at(t, _SHORT_YEAR, k)) for k in (1, 2, 3))
    full = F.when(short < PIVOT, short + 2000).otherwise(short + 1900)
    shortened = F.when(c > 12, _make(full, d, c)).otherwise(F.coalesce(_make(full, c, d), _make(full, d, c)))
    return (
        F.when(t.rlike(_DOTTED), _make(_int(_at(t, _DOTTED, 3)), _int(_at(t, _DOTTED, 2)), _int(_at(t, _DOTTED, 1))))
        .when(t.rlike(_NAMED), _make(_int(_at(t, _NAMED, 3)), month_by_name(_at(t, _NAMED, 2)), _int(_at(t, _NAMED, 1))))
        .when(t.rlike(_YEAR_FIRST), _make(_int(_at(t, _YEAR_FIRST, 1)), _int(_at(t, _YEAR_FIRST, 2)), _int(_at(t, _YEAR_FIRST, 3))))
        .when(t.rlike(_EPOCH), F.to_date(F.timestamp_seconds(seconds)))
        .when(t.rlike(_SLASHED), slashed)
        .when(t.rlike(_SHORT_YEAR), shortened)
        .when(t.rlike(_MONTH_FIRST), _make(_int(_at(t, _MONTH_FIRST, 3)), month_by_name(_at(t, _MONTH_FIRST, 1)), _int(_at(t, _MONTH_FIRST, 2))))
    )


def month_of(text: Column) -> Column:
    """A month from text: by a contained name, by a bare number from 1 to 12, or by ``yyyy-mm``."""
    t = F.trim(text)
    bare = _int(_at(t, r"^(\d{1,2})$", 1))
    dated = _int(_at(t, r"\d{4}[-/](\d{1,2})", 1))
    return F.coalesce(month_by_name(t), F.when(bare.between(1, 12), bare), F.when(dated.between(1, 12), dated))


def year_of(text: Column) -> Column:
    return _int(_at(text, r"((?:19|20)\d{2})", 1))


def date_key(year: Column, month: Column) -> Column:
    """``yyyy-mm``; null when either is."""
    return F.when(year.isNotNull() & month.isNotNull(), F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0")))


#: Sorts after every date.
NO_DATE = "9999-99-99"


def sortable(text: Column) -> Column:
    """A text key that orders free-form dates: ISO as it is, else year, first month in calendar order and first day."""
    iso = _at(text, r"(\d{4}-\d{2}-\d{2})", 1)
    year = _at(text, r"((?:19|20)\d{2})", 1)
    low, month = F.lower(text), F.lit("00")
    for number in range(12, 0, -1):
        name = next(n for n, m in MONTHS if m == number and len(n) == 3)
        month = F.when(low.contains(name), F.lit(f"{number:02d}")).otherwise(month)
    day = _first_day(text)
    return F.when(iso != "", iso).when(year != "", F.concat_ws("-", year, month, day)).otherwise(F.lit(NO_DATE))


def _first_day(text: Column) -> Column:
    found = F.filter(F.regexp_extract_all(text, F.lit(r"\b(\d{1,2})\b"), F.lit(1)), lambda d: d.try_cast("int") <= 31)
    return F.when(F.size(found) > 0, F.lpad(F.try_element_at(found, F.lit(1)), 2, "0")).otherwise(F.lit("00"))


def padded(window_from: Column, window_to: Column, days: int) -> tuple[Column, Column]:
    """A date window widened by some days at either end."""
    return F.date_sub(window_from, days), F.date_add(window_to, days)


def repaired(text: Column) -> Column:
    """ISO dates without a stray letter behind them."""
    return F.regexp_replace(text, r"(\d{4}-\d{2}-\d{2})[A-Za-z]\b", "$1")

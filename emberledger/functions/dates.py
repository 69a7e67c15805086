"""Dates in the spellings found in exports and on bills."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberledger.functions.text import bind, strip

_SEP = r"[-/.]"
_SERIAL = r"^\d{5,6}$"
_YEAR_FIRST = rf"^(\d{{4}}){_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}})$"
_YEAR_LAST = rf"^(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}(\d{{4}}|\d{{2}})$"
_GAP = r"[\s\-/.,]+"
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_MONTH_FIRST = rf"(?i)^{_MONTH}{_GAP}(\d{{1,2}}){_GAP}(\d{{4}}|\d{{2}})$"
_DAY_FIRST = rf"(?i)^(\d{{1,2}}){_GAP}(?:of\s+)?{_MONTH}{_GAP}(\d{{4}}|\d{{2}})$"
_NAMED_YEAR_FIRST = rf"(?i)^(\d{{4}}){_GAP}{_MONTH}{_GAP}(\d{{1,2}})$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
_TIME_TAIL = (
    r"(?i)(?:[T\s]+\d{1,2}:\d{2}.*|[T\s]+\d{1,2}\s*[ap]m|(?<=^\d{8})[T\s]*\d{4}(?:\d{2})?(?:Z|"
    r"[+-]\d{2}:?\d{2})?|(?<=\d)T\d{4}(?:\d{2})?Z?)$"
)
_WEEKDAY = r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+"


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d")


def _four_digit(year: Column, pivot_year: int) -> Column:
    """Two-digit years land within fifty years of ``pivot_year``."""
    century = pivot_year - pivot_year % 100
    full = year.cast("int") + century
    shifted = (
        F.when(full >= pivot_year + 50, full - 100)
        .when(full < pivot_year - 50, full + 100)
        .otherwise(full)
    )
    return F.when(F.length(year) == 2, shifted.cast("string")).otherwise(year)


def _cleaned(s: Column) -> Column:
    """Without time of day, weekday and ordinal endings."""
    d = F.regexp_replace(F.regexp_replace(s, _TIME_TAIL, ""), _WEEKDAY, "")
    return F.regexp_replace(d, r"(?i)\b(\d{1,2})(st|nd|rd|th)\b", "$1")


def _read_iso(s: Column) -> Column:
    """The commonest spelling, which needs no cleaning; null for what ``_read`` has to look at."""
    return F.when(F.rlike(s, F.lit(r"^[1-9]\d{3}-\d{2}-\d{2}\z")), s.try_cast("date"))


def _read(s: Column, pivot_year: int) -> Column:
    serial = s.try_cast("int")
    from_serial = F.when(
        serial.between(10000, 100000), F.date_add(F.lit("1899-12-30").cast("date"), serial)
    )
    return F.when(F.rlike(s, F.lit(_SERIAL)), from_serial).otherwise(
        bind(_cleaned(s), lambda d: _read_spelled(d, pivot_year))
    )


def _read_spelled(d: Column, pivot_year: int) -> Column:
    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(d, pattern, group)

    def is_(pattern: str) -> Column:
        return F.rlike(d, F.lit(pattern))

    a, b, c = (part(_YEAR_FIRST, g) for g in (1, 2, 3))
    p, q = part(_YEAR_LAST, 1), part(_YEAR_LAST, 2)
    year = _four_digit(part(_YEAR_LAST, 3), pivot_year)

    def named(pattern: str, month: int, day: int) -> Column:
        place = ({1, 2, 3} - {month, day}).pop()
        text = F.concat_ws(" ", F.initcap(part(pattern, month)), part(pattern, day),
                           _four_digit(part(pattern, place), pivot_year))
        return F.try_to_date(text, "MMM d y")

    return (
        F.when(is_(_YEAR_FIRST), F.coalesce(_date(a, b, c), _date(a, c, b)))
        .when(is_(_YEAR_LAST), F.coalesce(_date(year, p, q), _date(year, q, p)))
        .when(is_(_MONTH_FIRST), named(_MONTH_FIRST, 1, 2))
        .when(is_(_DAY_FIRST), named(_DAY_FIRST, 2, 1))
        .when(is_(_NAMED_YEAR_FIRST), named(_NAMED_YEAR_FIRST, 2, 3))
        .when(is_(_COMPACT), _date(part(_COMPACT, 1), part(_COMPACT, 2), part(_COMPACT, 3)))
    )


def parse_date(raw: Column, pivot_year: int = 2025) -> Column:
    """Date text to ``date``; null when no spelling fits or a part is missing.

    Spreadsheet serials (10000..100000), ISO and compact dates, US month-first with day-first as
    fallback, and month names in any order, with two- or four-digit years; a time of day, a
    weekday and ordinal endings are left aside.
    """
    return bind(strip(raw), lambda s: F.coalesce(_read_iso(s), _read(s, pivot_year)))

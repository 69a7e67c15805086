"""Small text expressions: stripping, case folding, number formatting, regex substitution."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything the Unicode standard calls white space.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once, however often the body uses it.

    A lambda variable holds the value. Without it, Catalyst would copy the whole expression
    to every place it is used in, which also makes generated methods too long for the JIT.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind (not only blanks)."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    stripped = strip(c)
    return F.when(stripped != "", stripped)


def squeeze(c: Column) -> Column:
    """Strip, and collapse every inner run of white space to one blank."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def fold_case(c: Column) -> Column:
    """Full Unicode case folding from built-in expressions.

    Upper-then-lower performs the expanding foldings (``ß`` to ``ss``, ligatures, long s);
    the letters for which it goes wrong are stepped around with ``translate``: capital sharp
    s, dotless i (kept apart by a private-use character) and final sigma. The translate
    between ``upper`` and ``lower`` also keeps the optimizer from dropping the inner call.
    Cherokee letters and scripts newer than Unicode 15 fold to lower instead of upper.
    """
    guarded = F.translate(c, "ẞı", "ß")
    lowered = F.lower(F.translate(F.upper(guarded), "\u0000", ""))
    return F.translate(lowered, "ς", "σı")


def fixed_text(c: Column, digits: int) -> Column:
    """Number with ``digits`` decimals and no thousands separators (ties to even)."""
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))


def signed_fixed_text(c: Column, digits: int) -> Column:
    return F.concat(F.when(c >= 0, F.lit("+")).otherwise(F.lit("")), fixed_text(c, digits))


def plain_decimal_text(c: Column) -> Column:
    """Decimal in plain notation without trailing zeros: ``1000.000000`` -> ``1000``."""
    text = c.cast("string")
    return F.when(
        F.contains(text, F.lit(".")), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    ).otherwise(text)


def regex_quote(c: Column) -> Column:
    r"""``\Q..\E`` quoting of a text for use inside a regular expression."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


_MARK = "\u0001"


def regex_parts(c: Column, pattern: str) -> Column:
    """The text around the matches and the matches in turn: text first and last, matches between.

    The matches are marked in a single pass and the text is split at the marks. Only a text that
    has the mark itself takes two passes, one for the text around and one for the matches.
    """
    marked = F.split(F.regexp_replace(c, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    around = F.split(c, pattern, -1)
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    apart = F.flatten(F.zip_with(around, found, lambda a, b: F.array_compact(F.array(a, b))))
    return F.when(F.contains(c, F.lit(_MARK)), apart).otherwise(marked)


def matches_of(parts: Column) -> Column:
    """The matches among the parts of ``regex_parts``."""
    return F.filter(parts, lambda _p, n: n % 2 == 1)


def substituted(parts: Column, replacement: Callable[[Column], Column]) -> Column:
    """The text of the parts of ``regex_parts`` with an expression in place of each match."""
    return F.array_join(F.transform(
        parts, lambda p, n: F.when(n % 2 == 1, replacement(p)).otherwise(p)), "")


def fill(template: str, **values: Column) -> Column:
    """Message text with its ``{name}`` marks replaced by columns (null if one is null)."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [
        values[p].cast("string") if n % 2 else F.lit(p) for n, p in enumerate(parts) if p
    ]
    return F.concat(*pieces)

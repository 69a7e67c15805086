"""Quantities as people type them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberledger.functions.text import bind, strip

_CURRENCY_SIGNS = r"[$€£¥₹]"
_CURRENCY_CODES = r"(?i)\b(USD|EUR|GBP|CAD|AUD|JPY|INR)\b"
_NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

_PLAIN = r"^\d{1,14}(\.\d+)?\z"  # needs no cleaning


def parse_quantity(raw: Column) -> Column:
    """Localised number text to ``decimal(20,6)``; null when it is not a finite number.

    Parentheses or a leading minus negate, currency signs and codes are dropped, and every
    comma is a thousands separator.
    """
    return bind(strip(raw), lambda s: F.when(
        F.rlike(s, F.lit(_PLAIN)), s.try_cast("decimal(20,6)")).otherwise(_read(s)))


def _read(s: Column) -> Column:
    in_parens = F.startswith(s, F.lit("(")) & F.endswith(s, F.lit(")"))
    minus = F.startswith(s, F.lit("-"))
    plus = F.startswith(s, F.lit("+"))
    body = (
        F.when(in_parens, strip(F.substr(s, F.lit(2), F.length(s) - 2)))
        .when(minus | plus, strip(F.substr(s, F.lit(2))))
        .otherwise(s)
    )
    body = F.regexp_replace(body, _CURRENCY_SIGNS, "")
    body = F.regexp_replace(body, _CURRENCY_CODES, "")
    body = strip(F.replace(body, F.lit(","), F.lit("")))
    signed = F.concat(F.when(in_parens | minus, F.lit("-")).otherwise(F.lit("")), body)
    return bind(
        signed,
        lambda n: F.when(F.rlike(n, F.lit(_NUMERIC)), n.try_cast("decimal(20,6)")),
    )

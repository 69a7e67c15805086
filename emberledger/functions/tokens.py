"""Deterministic tokens for supplier names and account numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberledger.functions.text import bind, fold_case, squeeze, strip

SUPPLIER_PREFIX = "TOKEN_SUPP_"
ACCOUNT_PREFIX = "TOKEN_ACCT_"


def _digest(prefix: str, normalised: Column) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(normalised, 256), 1, 10)))


def _token(prefix: str, raw: Column, normalise, is_blank) -> Column:
    unknown = F.lit(prefix + "UNKNOWN")
    return bind(
        strip(raw),
        lambda s: F.when(s.isNull() | (s == ""), unknown)
        .when(F.startswith(s, F.lit(prefix)), s)
        .otherwise(bind(normalise(s), lambda n: F.when(is_blank(n), unknown).otherwise(
            _digest(prefix, n)))),
    )


def tokenize_supplier(name: Column) -> Column:
    """Token of a supplier name; case and spacing do not matter, tokens pass through."""
    return _token(SUPPLIER_PREFIX, name, lambda s: fold_case(squeeze(s)), lambda n: n == "")


def tokenize_account(account: Column) -> Column:
    """Token of an account number; blanks, dashes and case do not matter."""
    return _token(
        ACCOUNT_PREFIX, account,
        lambda s: F.upper(F.regexp_replace(s, r"(?U)[\s\-]+", "")),
        lambda n: ~F.rlike(n, F.lit(r"(?U)\p{Alnum}")),
    )

"""Units of measure: normal form, compound factor units, conversion ratios."""

from __future__ import annotations

from decimal import Context, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberledger.constants import NUMERATOR_EXACT, NUMERATOR_FRAGMENTS, UNIT_RATIOS
from emberledger.functions.text import strip

RATIO = "decimal(34,30)"
NUMERATOR_RATIO = "decimal(12,11)"


def normalize_unit(unit: Column) -> Column:
    return F.replace(F.lower(strip(unit)), F.lit(" "), F.lit(""))


def factor_numerator(factor_unit: Column) -> Column:
    """``kgCO2e`` of ``kgCO2e/kWh``; the whole text when it is not of the form a/b."""
    parts = F.split(factor_unit, "/")
    return strip(F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).otherwise(factor_unit))


def factor_denominator(factor_unit: Column) -> Column:
    parts = F.split(factor_unit, "/")
    return F.when(F.size(parts) == 2, strip(F.get(parts, F.lit(1)))).otherwise(F.lit("unit"))


def numerator_to_tonnes(numerator: Column) -> Column:
    """Multiplier from an emission numerator (kg, g, lb, t of CO2e) to tonnes."""
    bare = F.regexp_replace(normalize_unit(numerator), r"[_\s\-]", "")
    chain = F
    for name, ratio in NUMERATOR_EXACT:
        chain = chain.when(bare == name, F.lit(ratio).cast(NUMERATOR_RATIO))
    for fragment, ratio in NUMERATOR_FRAGMENTS:
        chain = chain.when(
            F.contains(bare, F.lit(fragment)), F.lit(ratio).cast(NUMERATOR_RATIO)
        )
    return chain.otherwise(F.lit("1").cast(NUMERATOR_RATIO))


def convertible_pairs() -> list[tuple[str, str, Decimal]]:
    """All (from, to, ratio) that convert: the listed pairs, then inverses of listed pairs.

    An inverse carries 28 significant digits, and never shadows a listed pair.
    """
    direct = {(a, b): r for a, b, r in UNIT_RATIOS}
    digits28 = Context(prec=28)
    inverse = {
        (b, a): digits28.divide(Decimal(1), r)
        for (a, b), r in direct.items()
        if (b, a) not in direct
    }
    return [(a, b, r) for (a, b), r in {**direct, **inverse}.items()]

import hashlib
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from emberledger.functions import dates, numbers, text, tokens, units
from emberledger.operators.cleansing import ColumnMappingError, resolve_columns


def apply(spark, values, fn):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")
    rows = df.select("n", fn(F.col("v")).alias("out")).collect()
    return [r.out for r in sorted(rows)]


def test_quantities(spark):
    cases = {
        "$1,234.50": D("1234.5"), "2500": D("2500"), "0.85": D("0.85"),
        "€ 5,432.10": D("5432.10"), "£ 1,000,000": D("1000000"), "(150.25)": D("-150.25"),
        "-75.00": D("-75"), "1234.5": D("1234.5"), " USD 12 ": D("12"), "+3": D("3"),
        "1.234,56": D("1.23456"), "1e3": D("1000"), "(-5)": None, "INVALID_QTY": None,
        "NaN": None, "inf": None, "": None, "  ": None, "--5": None,
    }
    assert apply(spark, cases, numbers.parse_quantity) == list(cases.values())


def test_dates(spark):
    jan15 = date(2025, 1, 15)
    cases = {
        "2025-01-15": jan15, "2025-01-15T00:00:00Z": jan15, "01/15/2025": jan15,
        "15/01/2025": jan15, "15-01-2025": jan15, "45672": jan15, "Jan 15, 2025": jan15,
        "15th January 2025": jan15, "2025/1/15": jan15, "1.15.25": jan15, "20250115": jan15,
        "Wednesday, January 15 2025": jan15, "2025-01-15 10:30": jan15,
        "03/04/2025": date(2025, 3, 4), "INVALID_DATE": None, "": None, "13/13/2025": None,
        "99/99/9999": None,
    }
    assert apply(spark, cases, dates.parse_date) == list(cases.values())


def test_dates_with_month_names(spark):
    jan15 = date(2025, 1, 15)
    spelled = ["15-Jan-25", "15/Jan/2025", "15.Jan.2025", "Jan 15, 25", "January 15 2025",
               "Jan/15/2025", "2025 Jan 15", "2025-Jan-15", "20250115T1000", "20250115T100000Z",
               "15 of January 2025", "15 Jan. 2025", "Wed, 15 Jan 2025 10:00:00 GMT",
               "2025-01-15 3 pm"]
    assert apply(spark, spelled, dates.parse_date) == [jan15] * len(spelled)
    unclear = ["2025-01", "15. Januar", None, "Jan 2025", "15 Foo 2025", "32-Jan-25"]
    assert apply(spark, unclear, dates.parse_date) == [None] * len(unclear)


def _supp(name):
    return "TOKEN_SUPP_" + hashlib.sha256(name.encode()).hexdigest()[:10].upper()


def _acct(name):
    return "TOKEN_ACCT_" + hashlib.sha256(name.encode()).hexdigest()[:10].upper()


def test_supplier_tokens(spark):
    cases = {
        "Acme Industrial Supplies LLC": _supp("acme industrial supplies llc"),
        "  pacific gas & electric  ": _supp("pacific gas & electric"),
        "\tPACIFIC  GAS & ELECTRIC\n": _supp("pacific gas & electric"),
        " TOKEN_SUPP_A1B2C3D4E5  ": "TOKEN_SUPP_A1B2C3D4E5",
        "": "TOKEN_SUPP_UNKNOWN", "\t\n": "TOKEN_SUPP_UNKNOWN",
        "Weißer GROẞ ΟΔΟΣ ﬁrma ı": _supp("Weißer GROẞ ΟΔΟΣ ﬁrma ı".casefold()),
    }
    assert apply(spark, cases, tokens.tokenize_supplier) == list(cases.values())
    assert apply(spark, [None], tokens.tokenize_supplier) == ["TOKEN_SUPP_UNKNOWN"]


def test_account_tokens(spark):
    cases = {
        "ACCT-9842-1104": _acct("ACCT98421104"), "acct 9842 1104": _acct("ACCT98421104"),
        "  acct - 9842 - 1104  ": _acct("ACCT98421104"),
        "  TOKEN_ACCT_98421104AB  ": "TOKEN_ACCT_98421104AB",
        " - - ": "TOKEN_ACCT_UNKNOWN", ".:;!?": "TOKEN_ACCT_UNKNOWN", "": "TOKEN_ACCT_UNKNOWN",
    }
    assert apply(spark, cases, tokens.tokenize_account) == list(cases.values())


def test_factor_units(spark):
    cases = {
        "kgCO2e/kWh": ("kgCO2e", "kWh", D("0.001")), "gCO2e/kWh": ("gCO2e", "kWh", D("0.000001")),
        "tCO2e/tonne": ("tCO2e", "tonne", D(1)), "MTCO2e / x": ("MTCO2e", "x", D(1)),
        "lb_CO2e/kWh": ("lb_CO2e", "kWh", D("0.00045359237")),
        "kgCO2e": ("kgCO2e", "unit", D("0.001")), "a/b/c": ("a/b/c", "unit", D(1)),
        "tonnes ghg/l": ("tonnes ghg", "l", D("0.000001")),
    }
    got = apply(spark, cases, lambda c: F.struct(
        units.factor_numerator(c), units.factor_denominator(c),
        units.numerator_to_tonnes(units.factor_numerator(c))))
    assert [tuple(g) for g in got] == list(cases.values())


def test_inverse_ratios_carry_28_digits():
    pairs = {(a, b): r for a, b, r in units.convertible_pairs()}
    assert pairs[("liters", "gallon")] == D("0.2641720523581484153798999216")
    assert ("ccf", "mmbtu") not in pairs and ("mmbtu", "kwh") not in pairs
    assert pairs[("kwh", "mwh")] == D("0.001")


def test_number_texts(spark):
    df = spark.createDataFrame([(D("1000.000000"), D("0.500000"), D("0.000000"))],
                               "a decimal(20,6), b decimal(20,6), c decimal(20,6)")
    row = df.select(*[text.plain_decimal_text(F.col(c)) for c in "abc"],
                    text.fixed_text(F.lit(12345.678), 2),
                    text.signed_fixed_text(F.lit(D("-3.14159")), 2),
                    text.signed_fixed_text(F.lit(D("3.14159")), 2)).first()
    assert tuple(row) == ("1000", "0.5", "0", "12345.68", "-3.14", "+3.14")


def test_column_mapping_in_both_directions_and_errors():
    headers = ["TxnID", "Vendor", "ExpenseCategory", "UsageAmount", "UOM", "Country", "StartDate"]
    want = {"quantity": "UsageAmount", "activity_type": "ExpenseCategory",
            "period_start": "StartDate"}
    got = resolve_columns(headers, want)
    assert got == resolve_columns(headers, {v: k for k, v in want.items()})
    assert got["unit"] == "UOM" and got["supplier_ref"] == "Vendor"
    assert got["raw_line_ref"] == "TxnID" and got["geography"] == "Country"
    with pytest.raises(ColumnMappingError, match="NonExistent"):
        resolve_columns(headers, {"quantity": "NonExistent"})
    with pytest.raises(ColumnMappingError, match="Missing required column.*quantity"):
        resolve_columns(["Fuel", "Unit", "Date"])

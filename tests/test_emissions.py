from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from emberledger import schemas
from emberledger.operators import emissions, factors
from emberledger.operators.factors import FactorIndex
from emberledger.sources.factor_tables import published_factors

ACT = ("activity_id string, activity_type string, quantity decimal(20,6), unit string, "
       "geography string, period_start date")


def index_of(table, rows):
    full = [(i, "SRC", str(i), a, g, "u", v, fu, pub, f, t)
            for i, a, g, v, fu, pub, f, t in rows]
    return FactorIndex.build(table(full, schemas.EMISSION_FACTOR))


def test_calculation_goldens(table):
    cases = [
        # quantity, unit, factor, factor unit -> tonnes, unit ratio
        ("1000", "kWh", "0.3859", "kgCO2e/kWh", "0.38590000", "1"),
        ("2.5", "MWh", "0.3859", "kgCO2e/kWh", "0.96475000", "1000"),
        ("100", "therms", "5.3", "kgCO2e/therm", "0.53000000", "1"),
        ("15", "MMBtu", "5.3", "kgCO2e/therm", "0.79500000", "10"),
        ("20", "gallons", "2.705", "kgCO2e/liter", "0.20479078", "3.785411784"),
        ("300", "passenger.miles", "0.158", "kgCO2e/passenger.km", "0.07628291", "1.609344"),
        ("10", "tonne", "1.85", "tCO2e/tonne", "18.50000000", "1"),
        ("1000", "kWh", "385.9", "gCO2e/kWh", "0.38590000", "1"),
        ("50", "liters", "8.78", "kgCO2e/gallon", "0.11597153", None),
        ("-1000", "kWh", "0.3859", "kgCO2e/kWh", "-0.38590000", "1"),
        ("123456789012", "kWh", "0.3859", "kgCO2e/kWh", "47641974.87973080", "1"),
        ("100", "kg", "23500", "kgCO2e/kg", "2350.00000000", "1"),
        ("10", "kWh", "2.5", "kgCO2e/liter", None, None),
        ("10", "ccf", "53.06", "kgCO2e/MMBtu", None, None),
    ]
    index = index_of(table, [
        (f"f{n}", f"type{n}", "GLO", v, fu, "2025-01-01", "2025-01-01", None)
        for n, (_q, _u, v, fu, _r, _x) in enumerate(cases)
    ])
    acts = table([(n, f" TYPE{n} ", q, u, "glo", "2025-06-01")
                  for n, (q, u, _v, _fu, _r, _x) in enumerate(cases)], ACT)
    done = {int(r.activity_id): r for r in emissions.compute(acts, index).collect()}
    for n, (*_rest, result, ratio) in enumerate(cases):
        expected = None if result is None else D(result)
        assert done[n].result_tco2e == expected, cases[n]
        assert done[n].calc_status == ("computed" if result else "calculation_error")
        if ratio:
            assert done[n].unit_ratio == D(ratio)
    errors = emissions.unit_errors(emissions.compute(acts, index)).collect()
    assert any("'kWh' to factor unit 'liter'" in e.error for e in errors)


def test_formula_text(table):
    index = index_of(table, [("f", "gas", "GB", "2.705", "kgCO2e/liter", "2025-01-01",
                              "2025-01-01", None)])
    acts = table([("a", "gas", "20", "gallons", "GB", "2025-06-01")], ACT)
    row = emissions.calculations(
        emissions.compute(acts, index), "me", F.lit("2025-01-01").cast("timestamp")).first()
    assert row.formula_applied == (
        "20 gallons [converted: 75.70823568 liter] * 2.705 kgCO2e/liter / 1000 [kg to t] "
        "= 0.20479078 tCO2e")


def test_matching_by_place_and_date(table):
    index = index_of(table, [
        ("ca", "elec", "US-CA", "0.2", "kg/kWh", "2025-01-01", "2025-01-01", None),
        ("us25", "elec", "US", "0.4", "kg/kWh", "2025-01-01", "2025-01-01", None),
        ("us24", "elec", "US", "0.5", "kg/kWh", "2024-01-01", "2024-01-01", "2024-12-31"),
        ("us24b", "elec", "US", "0.45", "kg/kWh", "2024-06-01", "2024-03-01", "2024-09-30"),
        ("air", "air", "GLO", "0.1", "kg/km", "2025-01-01", "2025-01-01", None),
        ("gb", "gas", "GB", "0.1", "kg/kWh", "2025-01-01", "2025-01-01", None),
    ])
    cases = {
        ("elec", "US-CA", "2025-06-01"): ("ca", "exact"),
        ("elec", "US-TX", "2025-06-01"): ("us25", "national_fallback"),
        ("air", "FR", "2025-06-01"): ("air", "global_fallback"),
        ("air", "GLO", "2025-06-01"): ("air", "exact"),
        ("elec", "us", "2024-12-31"): ("us24", "exact"),
        ("elec", "US", "2025-01-01"): ("us25", "exact"),
        ("elec", "US", "2024-03-01"): ("us24b", "exact"),
        ("elec", "US", "2024-09-30"): ("us24b", "exact"),
        ("elec", "US", "2024-10-01"): ("us24", "exact"),
        ("elec", "US", "2023-12-31"): (None, "none"),
        ("elec", "CA", "2025-06-01"): (None, "none"),
        ("gas", "US", "2025-06-01"): (None, "none"),
        ("coal", "US", "2025-06-01"): (None, "none"),
    }
    acts = table([(n, t, "1", "kWh", g, d) for n, (t, g, d) in enumerate(cases)], ACT)
    matched = factors.match_factors(acts, index)
    got = {int(r.activity_id): (r.factor_id, r.fallback_level) for r in matched.collect()}
    assert [got[n] for n in range(len(cases))] == list(cases.values())
    reasons = {r.activity_type: r.reason for r in
               factors.explain_unmatched(matched, index).where("geography = 'US'").collect()}
    assert reasons["gas"].startswith("No factor found matching geography 'US'")
    assert reasons["coal"].endswith("activity_type 'coal' active on 2025-06-01")


def test_matching_without_broadcast_gives_the_same(spark, table):
    """A factor table that the planner finds too large is joined by shuffle instead."""
    facts = published_factors(spark)
    acts = table([(n, t, "10", "kWh", g, "2025-03-01") for n, (t, g) in enumerate(
        [("electricity_purchase", "US-NY"), ("electricity_purchase", "US-TX"),
         ("business_travel_air", "FR"), ("freight_road", "US")])], ACT)
    small = emissions.compute(acts, FactorIndex.build(facts))
    cols = ["activity_id", "factor_id", "fallback_level", "result_tco2e", "calc_status"]
    broadcast = sorted(small.select(cols).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        large = emissions.compute(acts, FactorIndex.build(facts)).select(cols)
        assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
        assert sorted(large.collect()) == broadcast
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tonnes_are_exact_over_the_whole_range(spark):
    import random
    from decimal import ROUND_HALF_UP, localcontext

    rng = random.Random(5)
    pairs = [("100000000000.5", "0.0000035999999999712"), ("90000000000000", "0.0000036"),
             ("999500000000", "1"), ("1000000000000", "1"), ("1", "0.000000005"),
             ("-3", "0.000000005"), ("-0.000001", "99999999999"), ("0", "5"),
             ("99999999999999.999999", "0.009999999999999999999999999")]
    for _ in range(300):
        pairs.append((format(D(rng.randrange(10 ** rng.randrange(1, 20))).scaleb(-6), "f"),
                      format(D(rng.randrange(10 ** rng.randrange(1, 37))).scaleb(-27), "f")))
    df = spark.createDataFrame(pairs, "q string, m string").select("q", "m", emissions.tonnes(
        F.col("q").cast("decimal(20,6)"), F.col("m").cast("decimal(38,27)")).alias("t"))
    with localcontext() as exact:
        exact.prec = 80
        for q, m, t in df.collect():
            want = (D(q) * D(m)).quantize(D("1e-8"), ROUND_HALF_UP)
            assert t == (None if abs(want) >= 10 ** 12 else want), (q, m)


def test_overflow_has_its_own_reason(table):
    index = index_of(table, [
        ("f", "elec", "US", "5", "t/kWh", "2025-01-01", "2025-01-01", None),
        ("g", "huge", "US", "900000000000", "g/kWh", "2025-01-01", "2025-01-01", None)])
    acts = table([("big", "elec", "99999999999999", "kWh", "US", "2025-06-01"),
                  ("fits", "elec", "199900000000", "kWh", "US", "2025-06-01"),
                  ("huge", "huge", "0.000007", "kWh", "US", "2025-06-01"),
                  ("odd", "elec", "1", "miles", "US", "2025-06-01")], ACT)
    done = emissions.compute(acts, index)
    errors = {r.activity_id: r.error for r in emissions.unit_errors(done).collect()}
    assert set(errors) == {"odd", "big"} and errors["odd"].startswith("Cannot convert")
    assert errors["big"].startswith("The result does not fit")
    got = {r.activity_id: r.result_tco2e for r in done.collect()}
    assert got["fits"] == D("999500000000") and got["huge"] == D("6.3")


def test_published_factors_end_to_end(spark, table):
    from emberledger.operators.classification import classify

    acts = table([
        ("1", "electricity_purchase", "1000", "kWh", "US", "2025-01-15"),
        ("2", "natural_gas_combustion", "5", "MMBtu", "US", "2025-01-15"),
    ], ACT).selectExpr("*", "'L' as raw_line_ref")
    facts = published_factors(spark)
    loaded = factors.new_factors(
        facts.selectExpr("*", "monotonically_increasing_id() as file_order"), None,
        F.col("file_order"))
    assert loaded.count() == 14  # the second US gas row repeats the load key
    done = emissions.compute(classify(acts), FactorIndex.build(loaded)).orderBy("activity_id")
    assert [r.result_tco2e for r in done.collect()] == [D("0.38590000"), D("0.26530000")]
    assert factors.new_factors(
        facts.selectExpr("*", "1 as file_order"), loaded,
        F.col("file_order")).count() == 0


def test_latest_and_summary(table):
    calcs = table([("c1", "a", "f", "x", "1", "r", "2025-01-01 00:00:00"),
                   ("c2", "a", "f", "x", "2", "r", "2025-01-02 00:00:00"),
                   ("c3", "b", "f", "x", "3", "r", "2025-01-01 00:00:00")], schemas.CALCULATION)
    assert {r.calculation_id for r in emissions.latest_calculations(calcs).collect()} == {"c2", "c3"}
    computed = table([("d", "computed"), ("d", "pending_factor"), ("e", "calculation_error")],
                     "source_document_id string, calc_status string")
    rows = {r[0]: tuple(r)[1:] for r in
            emissions.calculation_summary(computed, "source_document_id").collect()}
    assert rows == {"d": (1, 1, 0), "e": (0, 0, 1)}


@pytest.mark.parametrize("bad", [None, "x"])
def test_unknown_unit_is_an_error(table, bad):
    index = index_of(table, [("f", "gas", "GB", "1", "kgCO2e/kWh", "2025-01-01", "2025-01-01", None)])
    acts = table([("a", "gas", "20", bad, "GB", "2025-06-01")], ACT)
    assert emissions.compute(acts, index).first().calc_status == "calculation_error"

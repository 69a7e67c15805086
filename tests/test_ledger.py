"""Classification, inventory, anomaly, scenario, disclosure and lineage operators."""
from decimal import Decimal as D

from pyspark.sql import functions as F

from emberledger.operators import (
    anomalies,
    audit,
    classification,
    disclosures,
    eligibility,
    inventory,
    ledger,
    lineage,
    narrative,
    scenario,
    suppliers,
)

# Labelled line items, "activity type | unit | line reference | scope | category".
LABELLED = """
natural_gas_boiler_consumption | therms | FAC-01-GAS | 1 | stationary_combustion
heating_fuel_oil_furnace | gallons | FAC-02-OIL | 1 | stationary_combustion
company_fleet_diesel_refuel | gallons | FLEET-001 | 1 | mobile_combustion
maintenance_company_vehicle_petrol | liters | VEH-19 | 1 | mobile_combustion
facility_chiller_r-410a_refrigerant_leakage | kg | HVAC-01 | 1 | fugitive_emissions
lime_calcination_kiln_emissions | tonnes | PROC-KILN-01 | 1 | process_emissions
purchased_grid_electricity_hq | kWh | UTIL-HQ-JAN | 2 | purchased_electricity
district_steam_heating_network | therms | STEAM-DIST-01 | 2 | purchased_steam
district_chilled_water_cooling_system | ton_hours | CHILL-NET-01 | 2 | purchased_cooling
district_heating_hot_water_supply | MMBtu | DIST-HEAT-05 | 2 | purchased_heating
commercial_domestic_flight_economy | passenger.km | EXP-TRV-001 | 3 | business_travel
employee_public_transit_commute_passes | trips | COMM-METRO-01 | 3 | employee_commuting
third_party_freight_trucking_logistics | tonne.km | LOG-TRK-101 | 3 | upstream_transportation_distribution
municipal_solid_waste_landfill_disposal | tonnes | WST-LF-01 | 3 | waste_generated_in_operations
data_center_server_rack_equipment_purchase | units | CAP-HW-10 | 3 | capital_goods
office_supplies_and_stationery_procurement | USD | INV-SUPP-88 | 3 | purchased_goods_services
something_else_entirely | USD | INV-1 | 3 | purchased_goods_services
"""


def test_classifier_on_labelled_items(table):
    rows = [[p.strip() for p in ln.split("|")] for ln in LABELLED.split("\n") if ln]
    acts = table([(n, *r[:3]) for n, r in enumerate(rows)],
                 "activity_id string, activity_type string, unit string, raw_line_ref string")
    labels = table([(n, *r[3:]) for n, r in enumerate(rows)],
                   "activity_id string, expected_scope int, expected_category string")
    done = classification.classify(acts)
    for r in classification.classifier_accuracy(done, labels, "activity_id").collect():
        assert r.scope_accuracy == r.category_accuracy == 1.0
    last = done.where(f"activity_id = '{len(rows) - 1}'").first()
    assert (last.classification_confidence, last.status) == (0.5, "pending_review")
    detail = classification.classification_audit(done, F.lit(None)).first().detail
    assert '"scope":1' in detail and '"status":"classified"' in detail
    counts = classification.classification_summary(done).first()
    assert (counts.total_processed, counts.pending_review_count) == (len(rows), 1)


def test_reviews(table):
    acts = table([("a", "x", "u", "r"), ("b", "x", "u", "r")],
                 "activity_id string, activity_type string, unit string, raw_line_ref string")
    decisions = table(
        [("a", 1, "mobile_combustion", "r1", "2025-01-01 00:00:00", "n"),
         ("a", 3, "business_travel", "r2", "2025-01-02 00:00:00", "n"),
         ("a", 1, "business_travel", "r3", "2025-01-03 00:00:00", "n")],
        "activity_id string, scope int, ghg_category string, reviewer_id string, "
        "decided_at timestamp, notes string")
    done = classification.apply_reviews(classification.classify(acts), decisions)
    rows = {r.activity_id: r for r in done.collect()}
    assert (rows["a"].ghg_category, rows["a"].classification_confidence, rows["a"].old_status) == (
        "business_travel", 1.0, "pending_review")
    assert rows["b"].status == "pending_review" and not rows["b"].reviewed
    _ok, bad = classification.split_decisions(decisions)
    assert bad.first().error == "Invalid category 'business_travel' for scope 1."
    assert classification.review_audit(done).first().actor == "user:r2"


LED = ("calculation_id string, activity_id string, factor_id string, factor_source string, "
       "source_document_id string, entity_id string, activity_type string, unit string, "
       "quantity decimal(20,6), scope int, ghg_category string, supplier_ref string, "
       "period_start date, period_end date, result_tco2e decimal(20,8)")


def row(cid, activity, qty, scope, cat, t, start="2025-02-01", end="2025-02-28", entity="E",
        unit="kWh", supplier="S"):
    return (cid, "a" + cid, "f", "DEFRA", "d", entity, activity, unit, qty, scope, cat, supplier,
            start, end, t)


def test_dashboard_goldens(table):
    led = table([row("1", "gas", 1, 1, "stationary_combustion", "53.0"),
                 row("2", "elec", 1, 2, "purchased_electricity", "38.59"),
                 row("3", "air", 1, 3, None, "8.0"),
                 row("4", "air", 1, None, "", "1.0", start="2024-03-01")], LED)
    flags = table([("E", "OPEN", "CRITICAL"), ("E", "CONFIRMED", "CRITICAL")],
                  "entity_id string, status string, severity string")
    inv = inventory.inventory(led)
    board = inventory.dashboard(inv, inventory.open_flag_counts(flags)).where(
        "reporting_year = 2025").first()
    assert board.gross_tco2e == D("99.59") and board.total_calculations == 3
    assert board.top_hotspots[0].ghg_category == "stationary_combustion"
    assert board.top_hotspots[2].ghg_category == "Scope 3 Uncategorized"
    assert [s.share_percentage for s in board.scope_breakdown] == [D("53.22"), D("38.75"), D("8.03")]
    assert [p.reporting_year for p in board.historical_trends] == [2024, 2025]
    assert (board.open_anomalies_count, board.critical_anomalies_count) == (1, 1)
    assert inventory.scope_totals(inv).where("reporting_year = 2024 and scope = 1").first()[
        "total_tco2e"] == 0


def test_yearly_variance(table):
    led = table([row("1", "g", 10000, 1, "c", "53.0", "2024-02-01", "2024-03-01"),
                 row("2", "g", 9500, 1, "c", "5.3"),
                 row("3", "g", 100, 2, "c", "10", "2024-02-01", "2024-03-01"),
                 row("4", "g", 20, 2, "c", "2"),
                 row("5", "g", 10, 3, "c", "1", "2024-02-01", "2024-03-01"),
                 row("6", "g", 11, 3, "c", "4")], LED)
    flags = {r.subject_id: r for r in anomalies.yoy_flags(anomalies.yearly_scopes(led)).collect()}
    assert set(flags) == {"scope-1", "scope-3"}  # scope 2 fell with its activity
    assert flags["scope-1"].flag_type == "YOY_DROP" and flags["scope-1"].severity == "CRITICAL"
    assert flags["scope-1"].title == "Unexplained 90.0% Drop in Scope 1 Emissions"
    assert "(from 53.00 to 5.30 tCO2e)" in flags["scope-1"].description
    assert flags["scope-3"].flag_type == "YOY_SPIKE" and flags["scope-3"].metric == 300.0
    context = narrative.ledger_context(led).where("reporting_year = 2025").first()
    assert context.total_tco2e == D("11.3") and context.base_total_tco2e == D("64")
    assert round(float(context.ledger_pct_change), 2) == -82.34
    assert narrative.ledger_context(led).where("reporting_year = 2026").count() == 0


def test_outliers_omissions_and_scan(table):
    rows = [row(str(n), "elec", 1000, 2, "c", "0.16") for n in range(10)]
    rows += [row("x", "elec", 1000, 2, "c", "16.0"),
             row("old", "gas", 5, 1, "c", "7", "2024-03-01", "2024-03-31"),
             row("span", "air", 5, 3, "c", "7", "2024-12-15", "2025-01-15")]
    led = table(rows, LED)
    scores = anomalies.intensity_scores(led).collect()
    assert [r.calculation_id for r in scores] == ["x"] and 3.0 <= scores[0].z_score < 3.1
    omitted = anomalies.omission_flags(anomalies.yearly_scopes(led)).collect()
    assert [r.title for r in omitted] == ["Omission of Scope 1 Emissions"]
    flags = anomalies.anomaly_scan(led)
    assert {r.flag_type for r in flags.collect()} == {"INTENSITY_OUTLIER", "SCOPE_INCOMPLETENESS"}
    scanned = led.selectExpr("entity_id", "'2025' as reporting_period")
    assert '"flags_generated":2' in anomalies.scan_audit(flags, scanned, F.lit(None)).first().detail
    ids = [r.flag_id for r in flags.orderBy("flag_type").collect()]
    decisions = table([(ids[0], "CONFIRMED", "agreed", "me", "2025-05-01 00:00:00"),
                       (ids[1], "DISMISSED", "no", "me", "2025-05-01 00:00:00")],
                      "flag_id string, new_status string, notes string, actor string, "
                      "decided_at timestamp")
    resolved = {r.flag_id: r.status for r in anomalies.resolve_flags(flags, decisions).collect()}
    assert resolved == {ids[0]: "CONFIRMED", ids[1]: "OPEN"}
    counted = audit.list_anomalies(flags, entity_id="E", severity="CRITICAL")
    assert counted.count() == 1


def test_cohorts_of_less_than_three_and_flat_cohorts_are_silent(table):
    led = table([row("1", "e", 10, 2, "c", "1"), row("2", "e", 10, 2, "c", "100"),
                 row("3", "f", 10, 2, "c", "1"), row("4", "f", 10, 2, "c", "1"),
                 row("5", "f", 10, 2, "c", "1"), row("6", "f", 0, 2, "c", "9")], LED)
    assert anomalies.intensity_scores(led, zscore_cutoff=0.1).count() == 0


def test_scenario_goldens(table):
    led = table([row("1", "electricity_purchase", 1, 2, "purchased_electricity", "40"),
                 row("2", "natural_gas", 1, 1, "stationary_combustion", "53"),
                 row("3", "business_flight", 1, 3, "business_travel", "10")], LED)
    ask = table(
        [("s", "E", "2025", 0, "SOLAR_PPA_GRID_ELEC", "0.5", None, "-2000"),
         ("s", "E", "2025", 1, "BUSINESS_TRAVEL_MODAL_SHIFT", "0.6", None, "-5000"),
         ("s", "E", "2025", 2, "UNKNOWN", "0.6", None, None),
         ("t", "E", "1990", 0, "EV_FLEET_TRANSITION", "1", None, None)],
        "scenario_id string, entity_id string, reporting_period string, request_idx int, "
        "lever_id string, implementation_rate decimal(7,6), custom_capex_usd decimal(20,4), "
        "custom_annual_opex_delta_usd decimal(20,4)")
    impacts = scenario.simulate(led, ask)
    rows = {r.lever_id: r for r in impacts.collect()}
    assert len(rows) == 3
    assert rows["SOLAR_PPA_GRID_ELEC"].reduction_tco2e == D("20")
    assert rows["SOLAR_PPA_GRID_ELEC"].mac_usd_per_tco2e == D("-100.00")
    travel = rows["BUSINESS_TRAVEL_MODAL_SHIFT"]
    assert travel.reduction_tco2e == D("5.1") and travel.roi_rank == 1
    assert travel.mac_usd_per_tco2e == D("-980.39")
    ev = rows["EV_FLEET_TRANSITION"]  # no diesel: all of scope 1; 1990 falls back to all rows
    assert ev.baseline_emissions_tco2e == D("53") and ev.mac_usd_per_tco2e == D("0.00")
    targets = table([("s", "E", "2025", "20")], "scenario_id string, entity_id string, "
                    "reporting_period string, target_reduction_percent decimal(7,4)")
    total = scenario.scenario_totals(impacts, targets).where("scenario_id = 's'").first()
    assert total.total_reduction_tco2e == D("25.1") and total.target_met
    assert total.simulated_gross_tco2e == D("77.9") and total.total_reduction_percent == D("24.37")


def test_disclosure_rollup_citations_and_refs(table):
    led = table([row(f"{n:08d}-calc", "e", 1, 2, "purchased_electricity", "0.5") for n in range(5)]
                + [row("z", "x", 1, 7, None, "0.25")], LED)
    rolled = {(r.level, r.scope, r.ghg_category): r for r in disclosures.rollup(led).collect()}
    assert rolled[(0, None, None)].total_tco2e == D("2.75")
    assert rolled[(2, 3, "Uncategorized")].line_item_count == 1
    assert rolled[(1, 2, None)].proportion_pct == D("90.9")
    cited = {r.scope: r.citation_text for r in disclosures.citations(led).collect()}
    assert cited[2] == "00000000..., 00000001..., 00000002... (+2 more)" and cited[3] == "z..."
    asked = table([("E", "GHG_PROTOCOL", "2025-Q2"), ("E", "CA_SB253", "1990")],
                  "entity_id string, framework string, reporting_period string")
    made = disclosures.disclosure_rows(disclosures.requested_lines(led, asked), asked)
    assert [r.total_tco2e for r in made.collect()] == [D("2.75")] * 2  # quarter: year; else: all
    table_with_refs = table([("d1",), ("d2",)], "disclosure_id string").withColumn(
        "line_item_refs", F.array(F.lit("z"), F.lit("z"), F.lit("gone")))
    lines = disclosures.explode_refs(table_with_refs)
    assert lines.count() == 4
    totals = disclosures.totals_from_lines(lines, led).collect()
    assert [(r.total_tco2e, r.scope_3_tco2e) for r in totals] == [(D("0.25"), D("0.25"))] * 2
    verdicts = lineage.calculation_deletable(led.select("calculation_id"), lines)
    blocked = verdicts.where("not can_delete").collect()
    assert [(r.calculation_id, r.blocking_count) for r in blocked] == [("z", 2)]
    asked = table([("z",), ("00000000-calc",), ("nope",)], "calculation_id string")
    rest, outcome = lineage.guarded_delete(led, "calculation_id", asked, verdicts)
    assert {r[0]: r[1] for r in outcome.collect()} == {
        "z": "blocked", "00000000-calc": "deleted", "nope": "not_found"}
    assert rest.count() == 5
    gone = lineage.deletion_audit(led, "calculation_id", outcome, "calculation",
                                  "CALCULATION_DELETED", "auditor", F.lit(None), ["result_tco2e"])
    assert [r.entity_id for r in gone.collect()] == ["00000000-calc"]


def test_eligibility_cases(table):
    profiles = table(
        [("a", "1500000000", True, "0", "0", 10, False),
         ("b", "1000000000", True, "0", "0", 10, False),
         ("c", "1", False, "60000000", "1", 300, True),
         ("d", "1", False, "60000000", "1", 250, True),
         ("e", "1", False, "150000001", "1", 1, False)],
        "entity_id string, annual_revenue_usd decimal(20,2), does_business_in_california boolean, "
        "eu_net_turnover_eur decimal(20,2), balance_sheet_total_eur decimal(20,2), "
        "employee_count int, is_eu_parent boolean")
    got = {(r.entity_id, r.framework): r for r in eligibility.eligibility(profiles).collect()}
    yes = {k for k, r in got.items() if r.is_eligible and k[1] != "GHG_PROTOCOL"}
    assert yes == {("a", "CA_SB253"), ("c", "CSRD_ESRS_E1"), ("e", "CSRD_ESRS_E1")}
    assert "($1,500,000,000.00)" in got[("a", "CA_SB253")].reason
    assert got[("d", "CSRD_ESRS_E1")].reason.startswith("EU entity only satisfied 1/3")
    asked = table([("b", "CA_SB253"), ("nobody", "CA_SB253")], "entity_id string, framework string")
    ok, rejected = eligibility.gate_requests(asked, profiles)
    assert ok.first().entity_id == "nobody" and "does not exceed" in rejected.first().rejection


def test_supplier_gaps_and_outreach(table):
    led = table([row("1", "freight", 1, 3, "c", "20"), row("2", "freight", 1, 3, "c", "5"),
                 row("3", "elec", 1, 2, "c", "9")], LED)
    gap = suppliers.supplier_gaps(led).first()
    assert (gap.estimated_tco2e, gap.line_item_count) == (D("25"), 2)
    asks = table([("E", "2025", "S", "freight", None, "REDUCTION_PLEDGE", "", None)],
                 "entity_id string, reporting_period string, supplier_ref string, activity_type "
                 "string, supplier_name string, template_type string, custom_subject string, "
                 "custom_body string")
    draft = suppliers.outreach_drafts(asks).first()
    assert draft.subject == "Your climate targets, 2025 — S"
    assert draft.body.startswith("To the management of S,\n\n'freight' bought from you")
    actions = table(
        [("o", "CREATE", "2025-01-01 00:00:00", 1, None), ("o", "SEND", "2025-01-02 00:00:00", 2, None),
         ("o", "RESPOND", "2025-01-03 00:00:00", 3, "0.5"), ("p", "CREATE", "2025-01-01 00:00:00", 4, None)],
        "outreach_id string, action string, action_ts timestamp, action_id int, "
        "primary_factor_value decimal(20,8)").selectExpr(
            "*", "'u' as primary_factor_unit", "1 as verified_quantity", "'n' as response_notes")
    state = {r.outreach_id: r for r in suppliers.outreach_state(actions).collect()}
    assert state["o"].status == "RECEIVED" and state["o"].primary_factor_value == D("0.5")
    assert state["o"].sent_at.day == 2 and state["p"].status == "DRAFT" and state["p"].sent_at is None
    answered = suppliers.supplier_gaps(led, table(
        [("E", "2025", "S", "freight", "RECEIVED")],
        "entity_id string, reporting_period string, supplier_ref string, activity_type string, "
        "status string")).first()
    assert answered.has_primary_response


def test_periods(table):
    led = table([row("1", "e", 1, 2, "c", "1", "2024-12-20", "2025-01-10"),
                 row("2", "e", 1, 2, "c", "1", "2025-05-01", "2025-05-31")], LED)

    def pick(period, mode, fallback=False):
        asked = table([("E", period)], "entity_id string, reporting_period string")
        rows = ledger.select_period(led, asked, mode, fallback).collect()
        return sorted(r.calculation_id for r in rows)

    assert pick("2025", "overlap_year") == ["1", "2"] and pick("2024", "overlap_year") == ["1"]
    assert pick("2025-Q1", "start_year") == ["2"] and pick("2025-Q1", "quarter") == []
    assert pick("1999", "start_year") == [] and pick("1999", "start_year", True) == ["1", "2"]


def test_trace(table):
    calcs = table([("c", "a", "f")], "calculation_id string, activity_id string, factor_id string")
    acts = table([("a", "E", "t", 1, "u", "US", "2025-01-01", "L1", "doc")],
                 "activity_id string, entity_id string, activity_type string, quantity int, "
                 "unit string, geography string, period_start date, raw_line_ref string, "
                 "source_document_id string")
    facs = table([("f", "EPA", "1", "0.5", "kg/u")], "factor_id string, source string, "
                 "source_version string, factor_value decimal(20,8), factor_unit string")
    docs = table([("doc", "x.csv", "completed")], "document_id string, filename string, status string")
    log = table([("a", "CLASSIFY", "s", "2025-01-01 00:00:00"), ("doc", "INGEST", "s", "2025-01-01 00:00:00"),
                 ("other", "X", "s", "2025-01-01 00:00:00")],
                "entity_id string, action string, actor string, event_ts timestamp")
    traced = lineage.trace(calcs, acts, facs, docs)
    assert traced.first().filename == "x.csv"
    assert {r.action for r in lineage.trace_events(traced, log).collect()} == {"CLASSIFY", "INGEST"}
    usage = {r.factor_id: r.can_delete for r in lineage.factor_deletable(
        table([("f",), ("g",)], "factor_id string"), calcs).collect()}
    assert usage == {"f": False, "g": True}

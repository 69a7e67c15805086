"""Registered queries against their SQL counterparts on the smallest test tables.

All of them take minutes: EMBERLEDGER_ALL_QUERIES=1 runs them, otherwise a cross-section.
"""
import os
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

SAMPLE = (
    "q_scope_totals", "q_emissions", "q_factor_match", "q_anomaly_scan", "q_review_apply",
    "q_redact_text", "q_bill_lines", "q_macc", "q_disclosures", "q_trace", "q_calc_audit",
    "q_emissions_range", "q_redact_names", "q_yoy_chosen", "q_scan_audit", "q_trace_whole",
)


def _names():
    from emberledger.plans.queries import registered

    return list(registered()) if os.environ.get("EMBERLEDGER_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    from check_oracles import duck

    return duck(SF)


def test_every_query_has_an_oracle():
    import __spark_entry__ as entry
    from emberledger.plans.oracles import oracles
    from emberledger.plans.queries import registered

    assert set(oracles()) == set(registered())
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(registered())


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, con, name):
    import __spark_entry__ as entry
    from check_oracles import compare

    verdict = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert verdict.startswith("ok"), verdict


def test_calculation_runs_in_the_stage_of_the_scan(spark, table):
    """Matching and calculating add no exchange to a stored activity table."""
    from emberledger.plans.testbed import Testbed
    from emberledger.operators.emissions import compute

    bed = Testbed(spark, SF)
    acts = table([("a", "electricity_purchase", "1", "kWh", "US", "2025-01-01")],
                 "activity_id string, activity_type string, quantity decimal(20,6), unit string, "
                 "geography string, period_start date")
    plan = compute(acts, bed.index())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Sort" not in plan
    assert plan.count("BroadcastHashJoin") == 4

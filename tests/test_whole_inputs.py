"""Queries over all rows of their tables, held against counts of the tables themselves."""
from pathlib import Path

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def test_exports_write_and_stream_all_line_items(spark):
    from emberledger.plans.queries import registered

    got = registered()["q_exports"](spark, SF).agg(
        F.sum("n_rows"), F.sum("n_ids"), F.sum("n_errors"),
        F.count_distinct("supplier_ref")).first()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    n, suppliers = lines.count(), lines.select("l_suppkey").distinct().count()
    assert tuple(got) == (n, n, 0, suppliers)


def test_outreach_audit_has_the_steps_of_all_gaps(spark):
    from emberledger.operators import suppliers
    from emberledger.plans.queries import registered
    from emberledger.plans.testbed import Testbed

    got = {r.action: r["count"] for r in registered()["q_outreach_audit"](
        spark, SF).groupBy("action").count().collect()}
    gaps = suppliers.supplier_gaps(Testbed(spark, SF).ledger())
    n, answered = gaps.count(), gaps.where("entity_id = 'BUILDING'").count()
    assert gaps.where("line_item_count = 1").count() > 0
    assert got == {"CREATE_SUPPLIER_OUTREACH": n, "DISPATCH_SUPPLIER_OUTREACH": n,
                   "RECORD_SUPPLIER_PRIMARY_DATA": answered}

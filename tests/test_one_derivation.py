"""Queries that derive the ledger once, and what they pass over."""
import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from emberledger.operators import bills, emissions


LINEITEM_SCANS = {"q_period_filter": 0, "q_scan_audit": 0, "q_guarded_delete": 0,
                  "q_intensity_outliers": 0, "q_trace": 0, "q_trace_whole": 0,
                  "q_disclosures": 0, "q_latest_calculation": 1}


@pytest.mark.parametrize("name", LINEITEM_SCANS)
def test_the_ledger_is_derived_once(spark, tmp_path, name):
    """Passes over the ledger read it settled, or share one pass over the line items."""
    tables = small_tables(spark, tmp_path)
    plan = __spark_entry__.queries()[name](spark, tables)._jdf.queryExecution().executedPlan()
    scans = [line for line in plan.toString().split("\n")
             if "FileScan" in line and "l_orderkey#" in line]
    assert len(scans) == LINEITEM_SCANS[name]


def small_tables(spark, folder) -> str:
    rows = {
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                     "c_mktsegment string", [(1, "Customer#1", 0, 5.0, "BUILDING")]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int",
                     [(1, "Supplier#1", 3)]),
        "part": ("p_partkey long, p_type string", [(1, "ECONOMY")]),
        "orders": ("o_orderkey long, o_custkey long", [(1, 1)]),
        "events": ("event_id long, ts timestamp, user_id long, event_type string, value double, "
                   "props string", []),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                     "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                     "l_returnflag string, l_linestatus string, l_shipdate timestamp",
                     [(1, 1, 1, 1, 5.0, 9.0, 0.01, 0.02, "R", "F", dt.datetime(1999, 5, 1))]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_calc_audit_reads_each_detail_once(spark, tmp_path):
    df = __spark_entry__.queries()["q_calc_audit"](spark, small_tables(spark, tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan
    row = df.first()
    assert (row.action, row.fallback_level, row.reason) == ("CALCULATE", "national_fallback", None) \
        or row.emission_factor_id is not None


def test_bill_lines_pass_over_lines_without_digit_or_unit(spark):
    bills_ = spark.createDataFrame(
        [(1, ["Only words\n12 pieces\n1,200.5 KWH used\nGallons: 7\nton-km = 3", None])],
        "doc_id long, pages array<string>")
    done = bills.bill_lines(bills.bill_header(bills_, F.lit("2025-01-31").cast("date")))
    assert [(r.raw_line_ref, str(r.quantity)) for r in done.orderBy("raw_line_ref").collect()] == [
        ("page:1,line:3", "1200.500000"), ("page:1,line:4", "7.000000"),
        ("page:1,line:5", "3.000000")]
    assert "RLIKE(" in done._jdf.queryExecution().optimizedPlan().toString().upper()


def test_short_multipliers_give_the_same_tonnes(spark):
    """One multiplication or several: halves round up at the eighth decimal either way."""
    rng = random.Random(5)
    rows = [(Decimal(rng.randrange(-10 ** 19, 10 ** 19)).scaleb(-6),
             Decimal(rng.randrange(-10 ** n, 10 ** n)).scaleb(-rng.choice([3, 9, 12, 13, 27])))
            for n in range(1, 14) for _ in range(9)]
    rows += [(Decimal("0.5"), Decimal("0.00000001")), (None, Decimal(1)), (Decimal(1), None)]
    df = spark.createDataFrame(rows, "q decimal(20,6), m decimal(38,27)")
    with localcontext() as c:
        c.prec = 90
        want = [None if None in r else (r[0] * r[1]).quantize(Decimal("1e-8"), ROUND_HALF_UP)
                for r in rows]
    got = [r.t for r in df.select(emissions.tonnes(F.col("q"), F.col("m")).alias("t")).collect()]
    assert got == [w if w is None or abs(w) < Decimal("1e12") else None for w in want]

"""Traces against plain Python, and what is shuffled for them."""
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from emberledger.operators import lineage
from emberledger.operators.bounds import BUCKETS, buckets, settled
from test_one_derivation import small_tables

TRACED = ("calculation_id string, activity_id string, source_document_id string, "
          "factor_source string, filename string, document_status string")
# Two rows of one calculation, one without an id, documents that are unknown or not given.
ROWS = [("c1", "a1", "d1", "EPA", "d1.csv", "ok"), ("c1", "a1", "d1", "EPA", "d1.csv", "ok"),
        ("c2", "a2", "d1", "EPA", "d1.csv", "ok"), ("c3", "a2", None, "EPA", None, None),
        (None, "a1", "d1", "EPA", "d1.csv", "ok"), ("c4", "a4", "d9", "EPA", None, None)]
LOG = [("a1", 1), ("a1", 4), ("d1", 2), ("c2", 3), ("d9", 8), (None, 9), ("x", 9)]
LINKED = [("c1", "z"), ("c1", "y"), (None, "z"), ("c4", "z")]


def tables(spark):
    log = spark.createDataFrame(LOG, "entity_id string, n int").select(
        "entity_id", F.lit("TOUCH").alias("action"), F.lit("u").alias("actor"),
        F.timestamp_seconds("n").alias("event_ts"))
    return (spark.createDataFrame(ROWS, TRACED), log,
            spark.createDataFrame(LINKED, "calculation_id string, disclosure_id string"))


def subjects_of(row):
    found = [("calculation", row[0]), ("activity", row[1])]
    return found + [("document", row[2])] * (row[4] is not None)


def test_events_of_repeated_and_unknown_subjects(spark):
    traced, log, _linked = tables(spark)
    got = lineage.trace_events(traced, log, ["filename"]).select(
        "calculation_id", "filename", "subject_kind", "subject_id", F.unix_seconds("event_ts"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(
        str((r[0], r[4], kind, s, n)) for r in ROWS for kind, s in subjects_of(r)
        for e, n in LOG if s is not None and e == s)


def test_summary_of_repeated_and_unknown_subjects(spark):
    got = lineage.trace_summary(*tables(spark)).select(
        "calculation_id", "activity_id", "event_count", F.unix_seconds("last_event_ts"),
        "disclosure_count", "first_disclosure_id")

    def of(row):
        times = [n for r in ROWS if r[0] == row[0] for _k, s in subjects_of(r)
                 for e, n in LOG if row[0] is not None and e == s]
        cited = [d for c, d in LINKED if c is not None and c == row[0]]
        return (row[0], row[1], len(times), max(times, default=None), len(cited),
                min(cited, default=None))

    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(of(r)) for r in ROWS)


def test_a_table_settled_by_a_column_is_not_shuffled_by_it(spark):
    rows = spark.range(1000).selectExpr("if(id % 9 = 0, null, concat('k', id % 50)) k", "id v")
    kept = settled(rows, "kept", by="k")
    assert sorted(map(str, kept.collect())) == sorted(map(str, rows.collect()))
    assert buckets(spark) == min(BUCKETS, 4) == 4
    assert "settled_" not in "".join(t.name for t in spark.catalog.listTables())
    counted = kept.groupBy("k").count()
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r["count"] for r in counted.collect()} == {
        r.k: r["count"] for r in rows.groupBy("k").count().collect()}
    assert settled(rows.limit(0), "none", by="k").count() == 0


@pytest.mark.parametrize("name", ["q_trace", "q_trace_whole"])
def test_no_table_of_calculations_is_shuffled_twice(spark, tmp_path, monkeypatch, name):
    """Calculations meet their activities, subjects the log and traces their counts as they lie."""
    monkeypatch.setattr(lineage, "settled", lambda df, name, by: shuffles.append(
        exchanges(df)) or settled(df, name, by))
    shuffles, threshold = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = __spark_entry__.queries()[name](spark, small_tables(spark, tmp_path))
        last = exchanges(done)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # Only the way to the documents (and to the factors, which are broadcast otherwise).
    (of_trace,) = shuffles
    assert not [e for e in of_trace if e.startswith("activity_id")]
    assert [e for e in last if e.startswith("subject_id")] == ["subject_id"]
    # The counts of events; the citations twice, as their disclosures are not broadcast here.
    assert len([e for e in last if e.startswith("calculation_id")]) == (
        3 if name == "q_trace_whole" else 0)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\((\w+)", plan)

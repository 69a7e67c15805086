"""Replacing rows by their places, and how wide rows move on the way."""
from pyspark.sql import functions as F

import __spark_entry__
from emberledger.operators.bounds import settled
from emberledger.sources import ledger_store

from test_one_derivation import small_tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_go_by_place_without_moving_those_that_stay(spark, tmp_path):
    """Two chunks of a file, null and repeated keys on either side."""
    path, n = str(tmp_path / "ledger"), 70_000
    key = F.when(F.col("id") % 1000 != 7, F.concat(F.lit("k"), (F.col("id") % 69_000).cast("string")))
    rows = spark.range(n).coalesce(1).select(
        key.alias("activity_id"), F.lit("E").alias("entity_id"),
        F.lit("2024-05-01").cast("date").alias("period_start"), F.col("id").alias("result"))
    ledger_store.append(rows, path)
    new = rows.where("id % 3 = 0 or id = 7").withColumn("result", F.lit(-1).cast("long"))
    base = ledger_store.ledger_table(spark, path).snapshot()
    marks = ledger_store._marked(base, new.select("activity_id"), "activity_id")
    assert "Exchange hash" not in plan_of(
        ledger_store._unmarked(base, marks, {p for p, _f in base.folders}))
    want = rows.join(new.select("activity_id"), "activity_id", "left_anti").union(
        new.select("activity_id", "entity_id", "period_start", "result"))
    ledger_store.replace_rows(spark, new, path, "activity_id")
    got = ledger_store.scan(spark, path).select("activity_id", "result")
    want = want.select("activity_id", "result")
    assert got.count() == want.count() > n * 2 // 3
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_many_marks_are_joined_as_the_planner_likes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    rows = spark.range(9).select(
        "id", F.lit("E").alias("entity_id"), F.lit("2024-05-01").cast("date").alias("period_start"))
    ledger_store.append(rows, path)
    monkeypatch.setattr(ledger_store, "_BROADCAST_CHUNKS", 0)
    ledger_store.replace_rows(spark, rows.where("id = 8"), path, "id")
    assert ledger_store.scan(spark, path).count() == 9


def test_stored_ids_are_packed(spark, tmp_path):
    """Hex digests take half their length on disk."""
    ids = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("id"))
    folder = settled(ids, "packed").inputFiles()
    size = sum(spark._jvm.java.io.File(f.replace("file://", "")).length() for f in folder)
    assert size < 20_000 * 25


def test_orders_meet_their_customers_before_the_line_items(spark, tmp_path):
    df = __spark_entry__.queries()["q_scope_totals"](spark, small_tables(spark, tmp_path))
    tree = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [x for x in tree if "Join" in x]
    assert next(i for i, x in enumerate(joins) if "o_custkey" in x) == len(joins) - 1

"""Matching by sorting against matching by joins, and recalculation against a full run."""
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from emberledger.operators import factor_merge
from emberledger.operators.emissions import compute
from emberledger.operators.factors import FactorIndex, match_factors
from emberledger.sources import ledger_store

FACTOR = ("factor_id string, source string, source_version string, activity_type string, "
          "geography string, unit string, factor_value decimal(20,8), factor_unit string, "
          "published_date date, effective_from date, effective_to date")
ACTIVITY = ("activity_id string, entity_id string, activity_type string, quantity decimal(20,6), "
            "unit string, geography string, period_start date")
START = date(2020, 1, 1)


def day(n):
    return START + timedelta(days=n)


def versions(seed, n=30):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = r.randrange(1500)
        out.append((f"f{i}", "S", str(i), r.choice(["power", "gas"]),
                    r.choice(["US", "US-CA", "GLO", "GB"]), "kWh", f"0.{r.randint(1, 9)}",
                    "kgCO2e/kWh", day(r.randrange(1500)), day(a),
                    r.choice([None, day(a + r.randrange(600))])))
    return out


def some_activities(seed, n=400, hot=0.0):
    r = random.Random(seed)
    kinds = [" Power", "gas", "coal", None]
    places = ["us-ca", "US-TX", "GB", "GLO", "-", None]
    return [(f"a{i}", f"E{i % 5}", "power" if r.random() < hot else r.choice(kinds), "5", "kWh",
             "US-CA" if r.random() < hot else r.choice(places),
             None if r.random() < 0.05 else day(r.randrange(-100, 2200))) for i in range(n)]


@pytest.fixture(scope="module")
def indexes(spark, table):
    old = versions(1)
    new = [f for f in old if f[0] not in ("f3", "f7")] + versions(2, 34)[30:]
    return [FactorIndex.build(table([f[:1] + f[1:] for f in fs], FACTOR)) for fs in (old, new)]


def bag(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("hot_rows", [7, 1_000_000])
def test_merged_equals_joined(table, indexes, hot_rows):
    acts = table(some_activities(3, hot=0.6), ACTIVITY)
    joined, merged = match_factors(acts, indexes[0]), factor_merge.match_by_merge(
        acts, indexes[0], hot_rows)
    assert merged.columns == joined.columns
    assert bag(merged) == bag(joined)


def test_no_activities_or_no_factors(table, indexes):
    acts = table(some_activities(4, 20), ACTIVITY)
    assert factor_merge.match_by_merge(acts.where("false"), indexes[0]).count() == 0
    none = FactorIndex.build(table(versions(1), FACTOR).where("false"))
    assert {r.fallback_level for r in factor_merge.match_by_merge(acts, none).collect()} == {"none"}


def test_a_hot_place_is_dealt_to_all_tasks(spark, indexes):
    """Nine of ten activities in one place: no task gets more than three times the median."""
    acts = spark.range(20_000).select(
        F.concat(F.lit("a"), "id").alias("activity_id"), F.lit("power").alias("activity_type"),
        F.when(F.col("id") % 10 > 0, "US-CA").otherwise(F.concat(F.lit("P"), "id"))
        .alias("geography"),
        F.date_add(F.lit(START), (F.col("id") % 2000).cast("int")).alias("period_start"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        merged = factor_merge.match_by_merge(acts, indexes[0], hot_rows=250)
        sizes = sorted(r["count"] for r in merged.groupBy(F.spark_partition_id()).count().collect())
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(sizes) == 4 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    # What is broadcast is the list of hot keys, never a span.
    assert all("span_to" not in line for line in plan.splitlines() if "BroadcastExchange" in line)


def test_changed_spans_are_the_days_on_which_factors_differ(spark, table, indexes):
    changes = factor_merge.changed_spans(*indexes).collect()
    spans = [i.timeline.collect() for i in indexes]

    def in_force(side, key, d):
        return [(s.factor_id, s.factor_value) for s in spans[side]
                if (s.f_type, s.f_geo) == key and s.span_from <= d <= s.span_to]

    assert changes
    for key in {(s.f_type, s.f_geo) for side in spans for s in side}:
        for d in map(day, range(-10, 2300, 3)):
            changed = [c for c in changes
                       if (c.f_type, c.f_geo) == key and c.changed_from <= d <= c.changed_to]
            assert len(changed) == (in_force(0, key, d) != in_force(1, key, d)), (key, d)


def test_recalculation_equals_a_full_run_and_reads_changed_years_only(
        spark, table, indexes, tmp_path):
    old, new = indexes
    acts = table(some_activities(5), ACTIVITY)
    ledger_store.append(acts, str(tmp_path / "acts"))
    stored = ledger_store.ledger_table(spark, str(tmp_path / "acts")).snapshot()
    done = factor_merge.recalculated(stored, old, new)
    keep = ["activity_id", "factor_id", "factor_value", "calc_status", "result_tco2e"]
    was, now, got = ({r[0]: tuple(r) for r in d.select(*keep).collect()}
                     for d in (compute(acts, old), compute(acts, new), done))
    assert done.count() == len(got)
    assert {k for k in now if was[k] != now[k]} <= set(got) and 0 < len(got) < len(now)
    assert {**was, **got} == now


def test_years_without_a_change_are_not_read(spark, table, tmp_path):
    fs = [("a", "S", "1", "power", "US", "kWh", "0.1", "kgCO2e/kWh", day(0), day(0), None)]
    late = ("b", "S", "2", "power", "US", "kWh", "0.2", "kgCO2e/kWh", day(800), day(800), day(900))
    old, new = (FactorIndex.build(table(f, FACTOR)) for f in (fs, [*fs, late]))
    rows = [(f"a{n}", "E", "power", "5", "kWh", "US", day(n)) for n in range(0, 1800, 30)]
    ledger_store.append(table(rows, ACTIVITY), str(tmp_path / "acts"))
    stored = ledger_store.ledger_table(spark, str(tmp_path / "acts")).snapshot()
    done = factor_merge.recalculated(stored, old, new)
    assert {r.activity_id for r in done.collect()} == {f"a{n}" for n in range(810, 901, 30)}
    assert {f.split("period_year=")[1][:4] for f in done.inputFiles() if "period_year" in f} == {
        "2022"}

"""Kept traces against the joins they stand for, and how little a point lookup opens."""
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from emberledger.operators import lineage
from emberledger.sources import trace_store
from emberledger.sources.snapshots import ConcurrentWrite, SnapshotTable

TRACED = ("calculation_id string, " + ", ".join(
    trace_store._split(trace_store._FIELDS[trace_store.CALCULATION])))
LOG = "entity_id string, action string, actor string, event_ts timestamp"
LINKED = ("calculation_id string, disclosure_id string, framework string, "
          "reporting_period string, status string")


def traced(spark, low, high, result=1.5, document="d"):
    """Calculations c<n>; every document is one of ten, a third of the rows have document 0."""
    known = {
        "calculation_id": F.concat(F.lit("c"), "id"), "activity_id": F.concat(F.lit("a"), "id"),
        "factor_id": F.lit("f"), "result_tco2e": F.lit(result), "factor_source": F.lit("EPA"),
        "source_document_id": F.when(F.col("id") % 3 == 0, F.lit(f"{document}0")).otherwise(
            F.concat(F.lit(document), F.col("id") % 10)),
    }
    known["filename"] = F.when(~known["source_document_id"].endswith("9"), F.concat(
        known["source_document_id"], F.lit(".csv")))
    fields = [f.split(" ", 1) for f in TRACED.split(", ")]
    return spark.range(low, high).select(*[
        known.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])


def log(spark, low, high):
    n = F.col("id")
    return spark.range(low, high).select(
        F.concat(F.when(n % 2 == 0, "d").when(n % 4 == 1, "a").otherwise("c"),
                 F.when(n % 2 == 0, n % 10).otherwise(n)).alias("entity_id"),
        F.lit("TOUCH").alias("action"), F.concat(F.lit("u"), n).alias("actor"),
        F.expr("timestamp'2025-01-01' + make_interval(0, 0, 0, 0, 0, int(id))").alias("event_ts"))


def linked(spark, low, high, name="x"):
    return spark.range(low, high).where("id % 5 = 0").select(
        F.concat(F.lit("c"), "id").alias("calculation_id"), F.lit(name).alias("disclosure_id"),
        F.lit("GHG").alias("framework"), F.lit("2025").alias("reporting_period"),
        F.lit("draft").alias("status"))


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def now(spark, path):
    return trace_store.trace_table(spark, path).snapshot()


def test_lookup_equals_the_joins_and_opens_few_files(spark, tmp_path):
    path = f"{tmp_path}/traces"
    calcs, events, cited = traced(spark, 0, 4000), log(spark, 0, 3000), linked(spark, 0, 4000)
    trace_store.append(spark, path, trace_store.entries(
        calcs, events.where("actor < 'u5'"), cited))
    # A later commit may have another number of folders.
    trace_store.append(spark, path, trace_store.entries(
        log=events.where("actor >= 'u5'"), buckets=8))
    base = now(spark, path)
    whole = len(base.rows().inputFiles())
    for ids in (["c15"], ["c0", "c9", "c1001", "absent", "Straße", ""]):
        got = trace_store.lookup(base, ids)
        want = calcs.where(F.col("calculation_id").isin(ids))
        assert rows(got.calculations) == rows(want)
        all_events = lineage.trace_events(want, events)
        assert rows(got.events) == rows(all_events) and got.events.count()
        assert rows(got.citations) == rows(cited.where(F.col("calculation_id").isin(ids)))
    assert whole > 100
    one = trace_store.lookup(base, ["c15"])
    # One folder of calculations and one of citations; two commits of events for three subjects.
    assert len(one.calculations.inputFiles()) == 1 and len(one.citations.inputFiles()) == 1
    assert len(one.events.inputFiles()) <= 6
    plan = one.calculations._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(lookup_key,c15)" in plan
    start = time.perf_counter()
    again = trace_store.lookup(base, ["c15"])
    assert again.calculations.count() == 1 and again.citations.count() == 1
    print(f"point lookup {time.perf_counter() - start:.2f} s of {whole} files")
    assert rows(trace_store.summary(base)) == rows(lineage.trace_summary(calcs, events, cited))


def test_files_are_sorted_by_key(spark, tmp_path):
    path = f"{tmp_path}/traces"
    trace_store.append(spark, path, trace_store.entries(traced(spark, 0, 3000)))
    trace_store.append(spark, path, trace_store.entries(
        traced(spark, 0, 1), log(spark, 0, 3000), linked(spark, 0, 3000), buckets=4))
    files = now(spark, path).rows().inputFiles()
    for file in files:
        held = pq.ParquetFile(file.removeprefix("file://"))
        keys = held.read(["lookup_key"])[0].to_pylist()
        assert keys == sorted(keys)
    assert len(files) == 64 + 4 + 4 + 1


def test_replace_changes_the_ids_alone(spark, tmp_path):
    path = f"{tmp_path}/traces"
    trace_store.append(spark, path, trace_store.entries(
        traced(spark, 0, 300), log(spark, 0, 100), linked(spark, 0, 300)))
    before = now(spark, path)
    # c10 to c12 get new results, c13 and c15 go, c500 is new; a null id matches nothing.
    changed = spark.createDataFrame(
        [("c10",), ("c11",), ("c12",), ("c13",), ("c15",), ("c15",), (None,)],
        "calculation_id string")
    new = traced(spark, 10, 13, 9.25, "e").union(traced(spark, 500, 501))
    trace_store.replace(spark, path, changed, trace_store.entries(new, linked=linked(
        spark, 10, 13, "y")))
    after = now(spark, path)
    want = traced(spark, 0, 10).union(traced(spark, 14, 15)).union(traced(spark, 16, 300)).union(new)
    cited = linked(spark, 0, 10).union(linked(spark, 16, 300)).union(linked(spark, 10, 13, "y"))
    assert rows(trace_store.summary(after)) == rows(
        lineage.trace_summary(want, log(spark, 0, 100), cited))
    assert trace_store.lookup(after, ["c13", "c15"]).calculations.count() == 0
    # Folders of other keys, and all of the events, are those of before.
    stay = {f for p, f in before.folders if trace_store._place(p)[0] == trace_store.EVENT}
    assert stay <= {f for _p, f in after.folders}
    assert len({f for _p, f in before.folders} & {f for _p, f in after.folders}) > len(stay) + 50
    # A reader of the version before still sees it.
    assert trace_store.lookup(before, ["c13", "c15"]).calculations.count() == 2


def test_of_two_writers_one_is_refused(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/traces"
    trace_store.append(spark, path, trace_store.entries(traced(spark, 0, 20)))
    ids = spark.createDataFrame([("c3",), ("c900",)], "calculation_id string")
    first, write_rows = iter([True]), SnapshotTable._write_rows

    def meanwhile(self, new, added):
        done = write_rows(self, new, added)
        if next(first, False):  # the other writer adds an id of ours in a folder of its own
            trace_store.append(spark, path, trace_store.entries(
                traced(spark, 900, 901), buckets=2))
        return done

    monkeypatch.setattr(SnapshotTable, "_write_rows", meanwhile)
    with pytest.raises(ConcurrentWrite):
        trace_store.replace(spark, path, ids, trace_store.entries(traced(spark, 3, 4, 2.0)))


def test_empty_relations_and_too_many_ids(spark, tmp_path):
    path = f"{tmp_path}/traces"
    trace_store.append(spark, path, trace_store.entries(traced(spark, 0, 2)))
    got = trace_store.lookup(now(spark, path), ["c1", "c1"])
    assert got.calculations.count() == 1 and got.events.count() == 0 and got.citations.count() == 0
    none = trace_store.lookup(now(spark, path), [])
    assert none.calculations.count() == 0 and none.events.count() == 0
    with pytest.raises(ValueError, match="at most"):
        trace_store.lookup(now(spark, path), [str(i) for i in range(1001)])
    with pytest.raises(ValueError, match="power of two"):
        trace_store.entries(traced(spark, 0, 2), buckets=12)

"""Streamed totals with recalculations equal those of the latest calculations."""
import random
import uuid

from pyspark.sql import functions as F

from emberledger.operators.emissions import latest_calculations
from emberledger.streaming import retraction

DDL = ("activity_id string, calculation_id string, computed_at timestamp, entity_id string, "
       "period_start date, scope int, result_tco2e decimal(20,8)")


def test_replays_late_runs_and_moves(spark, table, tmp_path):
    rng, runs, batches = random.Random(3), [], []
    for n in range(240):
        key = rng.randrange(40)
        runs.append((f"a{key}", f"c{n % 90}", f"2025-01-{1 + n % 7:02d} 10:00:00",
                     rng.choice("EF"), f"{rng.choice([2024, 2025])}-03-01", rng.choice([1, 2, 3]),
                     f"{rng.randrange(-50, 900)}.00000001"))
    runs.append(("n", "c", "2025-01-01 00:00:00", None, "2024-01-01", None, "5"))
    runs += [("x", "c", "2025-01-01 00:00:00", "E", None, 1, "5"),
             (None, "c", "2025-01-01 00:00:00", "E", "2024-01-01", 1, "5"),
             ("y", "c", None, "E", "2024-01-01", 1, "5"),
             ("z", "c", "2025-01-01 00:00:00", "E", "2024-01-01", 1, None)]
    # Equal runs of one activity are replays: the last of them with one time and id is as good.
    unique = {(r[0], r[1], r[2]): r for r in runs}
    runs = list(unique.values())
    rng.shuffle(runs)
    batches = [runs[:90], runs[60:150], runs[150:], runs[::3]]
    name, inbox, out = str(uuid.uuid4()), str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    for rows in batches:
        table(rows, DDL).coalesce(1).write.mode("append").parquet(inbox)
        seen += rows
        stream = spark.readStream.schema(DDL).parquet(inbox)
        retraction.keep_differences(stream, out, name).awaitTermination()
        latest = latest_calculations(table(seen, DDL).dropna(
            subset=["activity_id", "computed_at", "period_start", "result_tco2e"]))
        want = latest.groupBy(
            "entity_id", F.year("period_start"), F.coalesce("scope", F.lit(3))).agg(
            F.sum("result_tco2e"), F.count("*"))
        got = retraction.net_scope_totals(spark, out)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(
            map(str, map(tuple, want.collect())))


def test_a_batch_handed_over_again_counts_once(spark, table, tmp_path, monkeypatch):
    inbox, out, name = str(tmp_path / "in"), str(tmp_path / "out"), str(uuid.uuid4())
    table([("a", "c", "2025-01-01 00:00:00", "E", "2024-01-01", 1, "5")], DDL).write.parquet(inbox)
    stream = spark.readStream.schema(DDL).parquet(inbox)
    real, fails = retraction.upsert_available, [True]

    def failing(df, name, write, mode):
        def once(rows, batch):
            write(rows, batch)
            if fails.pop() if fails else False:
                raise OSError("stopped after the write")
        return real(df, name, once, mode)

    monkeypatch.setattr(retraction, "upsert_available", failing)
    query = retraction.keep_differences(stream, out, name)
    try:
        query.awaitTermination()
    except Exception as error:
        assert "stopped after the write" in str(error)
    retraction.keep_differences(stream, out, name).awaitTermination()
    row = retraction.net_scope_totals(spark, out).first()
    assert (int(row.total_tco2e), row.activity_count) == (5, 1)


def test_folded_batches_count_like_all_of_them(spark, table, tmp_path, monkeypatch):
    """No row passes through Python, and what is held is folded to one row for each activity."""
    monkeypatch.setattr(retraction, "FOLD", 2)
    inbox, out, name = str(tmp_path / "in"), str(tmp_path / "out"), str(uuid.uuid4())
    for n in range(6):
        rows = [(f"a{k}", f"c{n}", f"2025-01-{1 + (n * k) % 7:02d} 00:00:00", "E", "2024-01-01", 1,
                 str(10 * n + k)) for k in range(5)]
        table(rows, DDL).coalesce(1).write.mode("append").parquet(inbox)
        retraction.keep_differences(
            spark.readStream.schema(DDL).parquet(inbox), out, name).awaitTermination()
    seen = spark.read.schema(DDL).parquet(inbox)
    got = retraction.net_scope_totals(spark, out).first()
    want = latest_calculations(seen).agg(F.sum("result_tco2e"), F.count("*")).first()
    assert (got.total_tco2e, got.activity_count) == tuple(want)
    kept = retraction._Kept(spark, f"{spark.conf.get('spark.checkpoint.dir')}/{name}-current")
    folders, unfolded = kept.before(6)
    assert folders == ["folded/batch=5"] and unfolded == 0
    assert kept.read(*folders).count() == 5
    assert kept._batches("changed") == [4, 5]
    plan = retraction.changes(retraction.runs(seen), kept.read(*folders))._jdf.queryExecution()
    assert "Python" not in plan.toString() and "Pandas" not in plan.toString()

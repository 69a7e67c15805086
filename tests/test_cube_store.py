"""The kept inventory against one worked out anew, through inserts, moves and deletions."""
import random

import pytest
from pyspark.sql import functions as F

from emberledger.operators import inventory
from emberledger.sources import cube_store, ledger_store
from emberledger.sources.snapshots import ConcurrentWrite, SnapshotTable

DDL = ("calculation_id string, entity_id string, scope int, ghg_category string, "
       "period_start date, result_tco2e decimal(20,8)")


def lines(table, seed, n=60, year=None):
    r = random.Random(seed)
    return table([
        (f"{seed}-{i}", r.choice(["E1", "E2", None]), r.choice([1, 2, 3, 7, None]),
         r.choice(["Purchased", "", None]),
         r.choice([None, f"{year or r.choice([2023, 2024])}-05-0{r.randint(1, 9)}"]),
         r.choice([None, "0.00000001", "-3.5", r.randint(1, 999)])) for i in range(n)], DDL)


def stored(spark, tmp_path):
    return ledger_store.ledger_table(spark, f"{tmp_path}/ledger").snapshot()


def refreshed(spark, tmp_path, ledger=None):
    return cube_store.refresh(spark, ledger or stored(spark, tmp_path), f"{tmp_path}/cube")


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def assert_kept_equals_fresh(spark, tmp_path, ledger=None):
    kept = cube_store.kept_inventory(spark, f"{tmp_path}/cube")
    fresh = inventory.inventory((ledger or stored(spark, tmp_path)).rows())
    assert kept.schema.simpleString() == fresh.schema.simpleString()
    assert bag(kept) == bag(fresh)


def delete(spark, tmp_path, condition):
    base = stored(spark, tmp_path)
    held = base.table.partitions_of(base.rows().where(condition))
    base.table.commit(base, base.rows(held.__contains__).where(F.expr(f"not ({condition})")), held)


def test_inserts_moves_and_deletions(spark, table, tmp_path):
    path = f"{tmp_path}/ledger"
    ledger_store.append(lines(table, 1), path)
    refreshed(spark, tmp_path)
    assert_kept_equals_fresh(spark, tmp_path)
    assert refreshed(spark, tmp_path) == set()
    # An insert reads the folders of its own commit only.
    ledger_store.append(lines(table, 2, year=2024), path)
    added = stored(spark, tmp_path).added
    assert all(added in f for f in refreshed(spark, tmp_path))
    assert_kept_equals_fresh(spark, tmp_path)
    # Rows that move to another year, entity and scope, over two commits at once.
    for year in (2021, 2023):
        moved = lines(table, 1, 30, year).withColumn("entity_id", F.lit("E9"))
        ledger_store.replace_rows(spark, moved, path, "calculation_id")
    refreshed(spark, tmp_path)
    assert_kept_equals_fresh(spark, tmp_path)
    # A group that loses all of its rows is gone.
    delete(spark, tmp_path, "entity_id <=> 'E9'")
    refreshed(spark, tmp_path)
    assert_kept_equals_fresh(spark, tmp_path)
    assert not cube_store.kept_inventory(spark, f"{tmp_path}/cube").where("entity_id = 'E9'").count()
    cube_store.compact(spark, f"{tmp_path}/cube")
    cube = cube_store.cube_table(spark, f"{tmp_path}/cube").snapshot()
    assert {p[1] for p, _f in cube.folders} == {str(stored(spark, tmp_path).version)}
    assert_kept_equals_fresh(spark, tmp_path)
    ledger_store.append(lines(table, 3), path)
    refreshed(spark, tmp_path)
    assert_kept_equals_fresh(spark, tmp_path)
    delete(spark, tmp_path, "true")
    refreshed(spark, tmp_path)
    assert bag(cube_store.kept_inventory(spark, f"{tmp_path}/cube")) == []


def test_vacuumed_and_older_versions_are_worked_out_anew(spark, table, tmp_path):
    path = f"{tmp_path}/ledger"
    ledger_store.append(lines(table, 1), path)
    first = stored(spark, tmp_path)
    refreshed(spark, tmp_path)
    ledger_store.replace_rows(spark, lines(table, 1, 20, 2022), path, "calculation_id")
    refreshed(spark, tmp_path)
    refreshed(spark, tmp_path, first)  # back to an older version
    assert_kept_equals_fresh(spark, tmp_path, first)
    stored(spark, tmp_path).table.vacuum(keep=1, spare_ms=0)
    refreshed(spark, tmp_path)
    assert_kept_equals_fresh(spark, tmp_path)


def test_of_two_refreshes_one_is_refused(spark, table, tmp_path, monkeypatch):
    path = f"{tmp_path}/ledger"
    ledger_store.append(lines(table, 1, 20, 2023), path)
    before = stored(spark, tmp_path)
    ledger_store.append(lines(table, 2, 20, 2024), path)
    first, write_rows = iter([True]), SnapshotTable._write_rows

    def meanwhile(self, rows, added):
        done = write_rows(self, rows, added)
        if next(first, False):
            refreshed(spark, tmp_path, before)
        return done

    monkeypatch.setattr(SnapshotTable, "_write_rows", meanwhile)
    with pytest.raises(ConcurrentWrite):
        refreshed(spark, tmp_path)
    monkeypatch.undo()
    refreshed(spark, tmp_path)
    assert_kept_equals_fresh(spark, tmp_path)

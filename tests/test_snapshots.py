"""Snapshot tables: a commit is seen whole or not at all, and conflicts are refused."""
import pytest

from emberledger.sources import ledger_store
from emberledger.sources.snapshots import ConcurrentWrite, SnapshotTable

DDL = "activity_id string, entity_id string, period_start date, result_tco2e decimal(20,8)"
OLD = {"a": ("2024-05-01", 1), "b": ("2025-05-01", 2), "c": ("2025-05-01", 3)}


@pytest.fixture
def store(table, tmp_path):
    path = str(tmp_path / "ledger")
    ledger_store.append(rows(table, OLD), path)
    return path


def rows(table, values):
    return table([(k, "E", day, str(x)) for k, (day, x) in values.items()], DDL)


def held(spark, path, version=None):
    return {r.activity_id: (str(r.period_start), int(r.result_tco2e))
            for r in ledger_store.scan(spark, path, version=version).collect()}


NEW = {"b": ("2024-06-01", 20), "d": ("2026-01-01", 4)}  # b moves to another year


@pytest.mark.parametrize("step", ["_write_rows", "_write_manifest", "_publish"])
@pytest.mark.parametrize("after", [False, True])
def test_a_writer_that_stops_leaves_one_version_whole(
        spark, table, store, monkeypatch, step, after):
    real = getattr(SnapshotTable, step)

    def stopping(self, *args):
        if after:
            real(self, *args)
        raise OSError("stopped")

    monkeypatch.setattr(SnapshotTable, step, stopping)
    with pytest.raises(OSError, match="stopped"):
        ledger_store.replace_rows(spark, rows(table, NEW), store, "activity_id")
    monkeypatch.undo()
    done = step == "_publish" and after
    assert held(spark, store) == ({**OLD, **NEW} if done else OLD)
    ledger_store.replace_rows(spark, rows(table, NEW), store, "activity_id")  # tried again
    assert held(spark, store) == {**OLD, **NEW}


def test_readers_stay_with_their_version(spark, table, store):
    before = ledger_store.scan(spark, store)
    version = ledger_store.replace_rows(spark, rows(table, NEW), store, "activity_id")
    assert version == 2 and before.count() == 3
    assert {r.activity_id: int(r.result_tco2e) for r in before.collect()}["b"] == 2
    assert held(spark, store, 1) == OLD and held(spark, store, 2) == {**OLD, **NEW}


def interrupted(monkeypatch, other):
    """Lets ``other`` write once between the rows and the manifest of the next commit."""
    real, waiting = SnapshotTable._write_rows, [other]

    def write(self, *args):
        done = real(self, *args)
        if waiting:
            waiting.pop()()
        return done

    monkeypatch.setattr(SnapshotTable, "_write_rows", write)


def test_of_two_writers_on_one_partition_one_is_refused(spark, table, store, monkeypatch):
    other = {"c": ("2025-05-01", 33)}
    interrupted(monkeypatch, lambda: ledger_store.replace_rows(
        spark, rows(table, other), store, "activity_id"))
    with pytest.raises(ConcurrentWrite):
        ledger_store.replace_rows(spark, rows(table, {"b": ("2025-05-01", 22)}), store,
                                  "activity_id")
    assert held(spark, store) == {**OLD, **other}


def test_writers_of_one_key_in_two_partitions_do_not_both_win(spark, table, store, monkeypatch):
    interrupted(monkeypatch, lambda: ledger_store.append(
        rows(table, {"n": ("2030-01-01", 1)}), store))
    with pytest.raises(ConcurrentWrite):
        ledger_store.replace_rows(spark, rows(table, {"n": ("2031-01-01", 2)}), store,
                                  "activity_id")
    assert held(spark, store) == {**OLD, "n": ("2030-01-01", 1)}


def test_writers_on_different_partitions_both_win(spark, table, store, monkeypatch):
    other, own = {"z": ("2030-01-01", 9)}, {"a": ("2024-05-01", 11)}
    interrupted(monkeypatch, lambda: ledger_store.append(rows(table, other), store))
    assert ledger_store.replace_rows(spark, rows(table, own), store, "activity_id") == 3
    assert held(spark, store) == {**OLD, **other, **own}


def test_a_version_is_published_once(spark, table, store):
    snapshots = ledger_store.ledger_table(spark, store)
    draft = snapshots._write_manifest("{}")
    assert not snapshots._publish(draft, 1) and held(spark, store) == OLD


def test_other_years_are_not_listed_and_null_partitions_are_kept(spark, table, store):
    ledger_store.append(table([("n", "E", None, "7")], DDL), store)
    assert held(spark, store)["n"] == ("None", 7)
    files = ledger_store.scan(spark, store, year=2024).inputFiles()
    assert files and all("period_year=2024" in f for f in files)
    ledger_store.replace_rows(spark, rows(table, {"n": ("2024-01-01", 8)}), store, "activity_id")
    assert held(spark, store) == {**OLD, "n": ("2024-01-01", 8)}


def test_vacuum_keeps_what_the_last_versions_list(spark, table, store):
    for n in range(3):
        ledger_store.replace_rows(spark, rows(table, {"b": ("2025-05-01", 30 + n)}), store,
                                  "activity_id")
    snapshots = ledger_store.ledger_table(spark, store)
    snapshots.vacuum(keep=2, spare_ms=0)
    assert snapshots.versions() == [3, 4]
    assert held(spark, store, 3)["b"][1] == 31 and held(spark, store)["b"][1] == 32
    assert held(spark, store)["a"] == OLD["a"]
    data = snapshots._files.globStatus(snapshots._at("data/commit=*"))
    assert len(data) == 3  # the first commit holds a's partition still


def test_no_rows(spark, table, tmp_path):
    empty = ledger_store.ledger_table(spark, str(tmp_path / "none")).snapshot()
    assert empty.version == 0
    with pytest.raises(ValueError, match="no rows yet"):
        empty.rows()
    path = str(tmp_path / "empty")
    ledger_store.append(table([], DDL), path)
    assert held(spark, path) == {}

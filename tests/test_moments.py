"""Kept statistics of cohorts against those of the whole ledger."""
import math
import random

import pytest

from emberledger.operators import anomalies
from emberledger.sources import ledger_store, moment_store
from emberledger.sources.snapshots import ConcurrentWrite, SnapshotTable

DDL = ("calculation_id string, entity_id string, activity_type string, unit string, quantity "
       "decimal(20,6), result_tco2e decimal(20,8), period_start date, period_end date")


def lines(table, seed, n=200, entity="E1", year=None):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        y = year or r.choice([2022, 2023, 2024])
        rows.append((f"{entity}-{seed}-{i}", entity, r.choice(["power", "gas"]), "kWh",
                     r.choice([None, 0, 5, 5, 5, 5]), r.random() + (5000 if i % 40 == 0 else 1000),
                     f"{y}-12-2{r.randint(0, 9)}", f"{y + r.randint(0, 1)}-12-31"))
    return table(rows, DDL)


def near(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9))


def assert_kept_equals_whole(spark, tmp_path):
    stored = ledger_store.scan(spark, f"{tmp_path}/ledger")
    whole = anomalies.merged_cohorts(anomalies.cohort_moments(stored))
    kept = moment_store.cohorts(spark, f"{tmp_path}/moments")
    a, b = ({tuple(r[:4]): tuple(r[4:]) for r in d.collect()} for d in (whole, kept))
    assert set(a) == set(b) and all(near(x, y) for k in a for x, y in zip(a[k], b[k], strict=True))
    scores = [{(r.calculation_id, r.reporting_year): r.z_score for r in d.collect()} for d in (
        anomalies.intensity_scores(stored, 2.0),
        anomalies.intensity_scores(stored, 2.0, cohorts=kept))]
    assert set(scores[0]) == set(scores[1]) and scores[0]
    assert all(near(scores[0][k], scores[1][k]) for k in scores[0])


def refreshed(spark, tmp_path):
    ledger = ledger_store.ledger_table(spark, f"{tmp_path}/ledger").snapshot()
    return moment_store.refresh(spark, ledger, f"{tmp_path}/moments")


def test_refresh_reads_changed_partitions_only(spark, table, tmp_path):
    path = f"{tmp_path}/ledger"
    ledger_store.append(lines(table, 1), path)
    assert {p[0] for p in refreshed(spark, tmp_path)} == {"2022", "2023", "2024"}
    assert_kept_equals_whole(spark, tmp_path)
    assert refreshed(spark, tmp_path) == set()
    # Two commits, one refresh: new rows in one year, and corrected ones that keep their year.
    ledger_store.append(lines(table, 2, 50, year=2023), path)
    fixed = lines(table, 2, 10, year=2023)
    ledger_store.replace_rows(spark, fixed, path, "calculation_id")
    assert {p[0] for p in refreshed(spark, tmp_path)} == {"2023"}
    assert_kept_equals_whole(spark, tmp_path)
    # A year that loses all of its rows loses its statistics.
    stored = ledger_store.ledger_table(spark, path)
    now = stored.snapshot()
    gone = {p for p, _f in now.folders if p[0] == "2022"}
    stored.commit(now, now.rows().where("false"), gone)
    assert refreshed(spark, tmp_path) == set()
    assert_kept_equals_whole(spark, tmp_path)


def test_of_two_refreshes_one_is_refused(spark, table, tmp_path, monkeypatch):
    ledger_store.append(lines(table, 3, 20), f"{tmp_path}/ledger")
    first = iter([True])
    write_rows = SnapshotTable._write_rows

    def meanwhile(self, rows, added):
        done = write_rows(self, rows, added)
        if next(first, False):
            refreshed(spark, tmp_path)
        return done

    monkeypatch.setattr(SnapshotTable, "_write_rows", meanwhile)
    with pytest.raises(ConcurrentWrite):
        refreshed(spark, tmp_path)

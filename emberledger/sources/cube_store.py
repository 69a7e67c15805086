"""The inventory of a stored ledger, kept up by differences.

A refresh reads the ledger folders that came or went since the version it last saw, counts the
rows of the former up and of the latter down, and adds the net change of each group as rows of a
version of its own. Results are decimals, so the sums equal those of a fresh aggregation exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberledger.operators import inventory
from emberledger.sources.snapshots import Snapshot, SnapshotTable

_GROUP = ["entity_id", "reporting_year", "scope", "ghg_category"]
_SUM = "decimal(38,8)"
#: Every refresh claims this partition, which holds nothing: of two at a time one is refused.
_TURN = ("turn", "turn")


def cube_table(spark: SparkSession, path: str) -> SnapshotTable:
    return SnapshotTable(spark, path, ["cube_year", "ledger_version"])


def seen_version(cube: Snapshot) -> int:
    """The ledger version of the last difference; 0 before the first."""
    return max((int(p[1]) for p, _f in cube.folders), default=0)


def _moved(rows: DataFrame, sign: int) -> DataFrame:
    return inventory.labelled(rows).groupBy(*_GROUP).agg(
        (F.coalesce(F.sum("result_tco2e"), F.lit(0)) * sign).cast(_SUM).alias("moved_tco2e"),
        (F.count("result_tco2e") * sign).alias("moved_results"),
        (F.count(F.lit(1)) * sign).alias("moved_rows"))


def _net(moved: DataFrame) -> DataFrame:
    """The net change of each group that changed at all."""
    net = moved.groupBy(*_GROUP).agg(
        F.sum("moved_tco2e").cast(_SUM).alias("moved_tco2e"),
        F.sum("moved_results").alias("moved_results"), F.sum("moved_rows").alias("moved_rows"))
    return net.where("moved_tco2e <> 0 or moved_results <> 0 or moved_rows <> 0")


def _commit(base: Snapshot, net: DataFrame, version: int, replaced: set) -> None:
    base.table.commit(base, net.withColumns({
        "cube_year": F.col("reporting_year"), "ledger_version": F.lit(version)}),
        replaced | {_TURN})


def refresh(spark: SparkSession, ledger: Snapshot, path: str) -> set[str]:
    """Brings the cube to the state of ``ledger``; returns the ledger folders that it read.

    Where the version last seen has been vacuumed, or is ahead of ``ledger``, the cube is worked
    out anew. Of two refreshes at a time, one is refused (``ConcurrentWrite``).
    """
    base = cube_table(spark, path).snapshot()
    seen = seen_version(base)
    if seen == ledger.version and seen:
        return set()
    whole = seen > ledger.version or (seen and seen not in ledger.table.versions())
    before = ledger.table.snapshot(0 if whole else seen)
    now, then = {f for _p, f in ledger.folders}, {f for _p, f in before.folders}
    came, went = now - then, then - now
    if not came and not went and not whole:
        return set()
    moved = [_moved(ledger.rows_in(came), 1)] if came else []
    if went:
        moved.append(_moved(before.rows_in(went), -1))
    replaced = {p for p, _f in base.folders} if whole else set()
    if not moved:
        base.table.commit(base, base.rows().where("false"), replaced | {_TURN})
    else:
        net = moved[0] if len(moved) == 1 else moved[0].union(moved[1])
        _commit(base, _net(net), ledger.version, replaced)
    return came | went


def compact(spark: SparkSession, path: str) -> None:
    """Folds all differences into one row for each group that still has rows."""
    base = cube_table(spark, path).snapshot()
    if base.folders:
        _commit(base, _net(base.rows()), seen_version(base), {p for p, _f in base.folders})


def kept_inventory(spark: SparkSession, path: str) -> DataFrame:
    """What ``inventory.inventory`` gives for the ledger version last seen, from the cube alone."""
    net = _net(cube_table(spark, path).snapshot().rows()).where("moved_rows <> 0")
    return net.select(
        *_GROUP,
        F.when(F.col("moved_results") > 0, F.col("moved_tco2e")).cast(inventory.TOTAL)
        .alias("total_tco2e"),
        F.col("moved_rows").alias("activity_count"))

"""Statistics of the ledger's cohorts, kept beside a stored ledger and refreshed by partition.

A kept partition names the ledger folders that it was worked out from. A refresh reads only the
partitions of the ledger whose folders have changed since, whatever versions lie between.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberledger.operators.anomalies import cohort_moments, merged_cohorts
from emberledger.operators.bounds import fixed_table
from emberledger.sources.ledger_store import PARTITIONS
from emberledger.sources.snapshots import Partition, Snapshot, SnapshotTable

_SOURCE = "source_folders"


def moment_table(spark: SparkSession, path: str) -> SnapshotTable:
    return SnapshotTable(spark, path, [*PARTITIONS, _SOURCE])


def _sources(ledger: Snapshot) -> dict[Partition, str]:
    """A digest of the folders of each partition of the ledger."""
    folders = defaultdict(list)
    for partition, folder in ledger.folders:
        folders[partition].append(folder)
    return {p: hashlib.sha256("|".join(sorted(f)).encode()).hexdigest()[:32]
            for p, f in folders.items()}


def refresh(spark: SparkSession, ledger: Snapshot, path: str) -> set[Partition]:
    """Brings the kept statistics to the state of ``ledger``; returns the partitions it read.

    Of two refreshes at a time that touch one partition, one is refused (``ConcurrentWrite``).
    """
    base = moment_table(spark, path).snapshot()
    current = {(*p, source) for p, source in _sources(ledger).items()}
    kept = {p for p, _folder in base.folders}
    missing, stale = current - kept, kept - current
    read = {p[:-1] for p in missing}
    if not missing and not stale:
        return read
    names = fixed_table(spark, [tuple(p) for p in sorted(missing)] or [("", "", "")],
                        ["_y", "_b", _SOURCE])
    parts = cohort_moments(ledger.rows(read.__contains__), *PARTITIONS)
    year, bucket = (F.col(c).cast("string") for c in PARTITIONS)
    null = F.lit("__HIVE_DEFAULT_PARTITION__")
    rows = parts.join(F.broadcast(names), (F.coalesce(year, null) == F.col("_y"))
                      & (F.coalesce(bucket, null) == F.col("_b"))).drop("_y", "_b")
    moment_table(spark, path).commit(base, rows, missing | stale)
    return read


def cohorts(spark: SparkSession, path: str) -> DataFrame:
    """The statistics of all cohorts, for ``intensity_scores``."""
    return merged_cohorts(moment_table(spark, path).snapshot().rows())

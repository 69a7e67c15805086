"""A kept index of traces: one id is answered from the few files that hold it.

Three relations share one ``SnapshotTable``, so that a commit changes them together: calculations
(with activity, factor and document) and their citations by calculation, log events by subject.
Each is dealt to folders by a checksum of its key, which a reader works out without a job; within
a folder the files are sorted by key and carry Bloom filters of it. A folder's number tells the
relation and the number of folders it was one of: one whole number, and never the same for all rows
of a commit, as the writer of Spark keeps the order of rows only for such a partition column.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberledger.operators import lineage
from emberledger.operators.bounds import settled
from emberledger.sources.snapshots import Partition, Snapshot, SnapshotTable

KEY = "lookup_key"
CALCULATION, CITATION, EVENT = "calculation", "citation", "event"
#: Folders of a relation in one commit, a power of two; commits of one table may differ.
BUCKETS = 64
#: Keys of one point lookup; more of them are a join.
MAX_KEYS = 1000

_RELATIONS = (CALCULATION, CITATION, EVENT)
_FOLDER = "folder"
_FIELDS = {
    CALCULATION: "struct<activity_id string, factor_id string, source_document_id string, "
                 "result_tco2e decimal(20,8), entity_id string, activity_type string, "
                 "quantity decimal(20,6), unit string, geography string, period_start date, "
                 "raw_line_ref string, factor_source string, factor_version string, "
                 "factor_value decimal(20,8), factor_unit string, filename string, "
                 "document_status string>",
    CITATION: "struct<disclosure_id string, framework string, reporting_period string, "
              "status string>",
    EVENT: "struct<action string, actor string, event_ts timestamp>",
}


@dataclass(frozen=True)
class Trace:
    """What is kept about the calculations asked for."""

    calculations: DataFrame
    events: DataFrame
    citations: DataFrame


def trace_table(spark: SparkSession, path: str) -> SnapshotTable:
    return SnapshotTable(spark, path, [_FOLDER], order=[KEY], options={
        f"parquet.bloom.filter.enabled#{KEY}": "true",
        "parquet.block.size": str(16 << 20),  # small row groups: a point lookup reads one
    })


def _folder(key: Column, relation: str, buckets: int) -> Column:
    """Of n buckets, bucket b of relation r is folder (n + b) * relations + r."""
    bucket = F.pmod(F.crc32(key.cast("binary")), F.lit(buckets)) + buckets
    return (bucket * len(_RELATIONS) + _RELATIONS.index(relation)).cast("int")


def _place(partition: Partition) -> tuple[str, int, int]:
    """Relation, number of buckets and bucket of a folder."""
    slot, relation = divmod(int(partition[0]), len(_RELATIONS))
    buckets = 1 << (slot.bit_length() - 1)
    return _RELATIONS[relation], buckets, slot - buckets


def _entries(rows: DataFrame, relation: str, key: str, buckets: int) -> DataFrame:
    """Rows of one relation in the shape of the table; rows without a key can be asked for by
    nobody and are left out."""
    def of(name: str) -> Column:
        if name != relation:
            return F.lit(None)
        fields = [f.partition(" ")[0] for f in _split(_FIELDS[name])]
        return F.struct(*[F.col(f) for f in fields])

    return rows.where(F.col(key).isNotNull()).select(
        F.col(key).alias(KEY), *[of(n).cast(d).alias(n) for n, d in _FIELDS.items()],
        _folder(F.col(key), relation, buckets).alias(_FOLDER))


def _split(struct: str) -> list[str]:
    return struct.removeprefix("struct<").removesuffix(">").split(", ")


def entries(traced: DataFrame | None = None, log: DataFrame | None = None,
            linked: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Index rows of ``lineage.trace``, of an audit log (``entity_id`` is the subject) and of
    ``lineage.linked_disclosures``; at least one of the three."""
    if buckets < 1 or buckets & (buckets - 1):
        raise ValueError("the number of buckets has to be a power of two")
    parts = []
    if traced is not None:
        parts.append(_entries(traced, CALCULATION, "calculation_id", buckets))
    if log is not None:
        parts.append(_entries(log, EVENT, "entity_id", buckets))
    if linked is not None:
        parts.append(_entries(linked, CITATION, "calculation_id", buckets))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def append(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Adds ``entries`` in one commit; returns the version."""
    return trace_table(spark, path).append(rows)


def replace(spark: SparkSession, path: str, changed: DataFrame, rows: DataFrame) -> int:
    """Puts ``rows`` in the place of the calculations and citations of the ids in ``changed``
    (``calculation_id``); ids without new rows are gone afterwards. Events stay.

    The folders that hold the ids are rewritten, no others; ``ConcurrentWrite`` if another writer
    has changed one of them meanwhile.
    """
    table = trace_table(spark, path)
    base, rows = table.snapshot(), settled(rows, "trace-rows")
    ids = settled(changed.select(F.col("calculation_id").alias(KEY)).distinct(), "trace-ids")
    held = {p for p, _f in base.folders}
    sizes = {(r, n) for r, n, _b in map(_place, held) if r != EVENT}
    hit = {(str(c),) for r, n in sorted(sizes)
           for (c,) in ids.select(_folder(F.col(KEY), r, n)).distinct().collect()}
    touched = hit & held
    kept = base.rows(touched.__contains__).join(ids, KEY, "left_anti")
    # Rows of the same ids that another writer adds go to folders this commit need not touch.
    return table.commit(
        base, kept.select(*rows.columns).union(rows), touched,
        clash=lambda new: bool(
            new.where(F.col(EVENT).isNull()).join(ids, KEY, "left_semi").limit(1).count()))


def _relation(base: Snapshot, relation: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows of a relation: all of them, or those of some keys from the folders that can hold
    them."""
    if keys is None:
        rows = base.rows(lambda p: _place(p)[0] == relation)
    else:
        sums = [zlib.crc32(k.encode()) for k in keys]

        def wanted(partition: Partition) -> bool:
            its, buckets, bucket = _place(partition)
            return its == relation and any(s % buckets == bucket for s in sums)

        rows = base.rows(wanted).where(F.col(KEY).isin(list(keys)))
    return rows.select(KEY, f"{relation}.*")


def lookup(base: Snapshot, calculation_ids: Iterable[str]) -> Trace:
    """Everything kept about a few calculations; their subjects (at most three for each) pass
    through the driver, the answers do not."""
    ids = sorted(set(calculation_ids))
    if len(ids) > MAX_KEYS:
        raise ValueError(f"a lookup takes at most {MAX_KEYS} ids; join the relations instead")
    traced = _relation(base, CALCULATION, ids).withColumnRenamed(KEY, "calculation_id")
    found = lineage.trace_subjects(traced).collect()
    subjects = {(r.calculation_id, r.subject_kind, r.subject_id) for r in found}
    events = _relation(base, EVENT, sorted({s for _c, _k, s in subjects}))
    names = base.table.spark.createDataFrame(
        sorted(subjects), f"calculation_id string, subject_kind string, {KEY} string")
    return Trace(
        traced,
        events.join(F.broadcast(names), KEY).withColumnRenamed(KEY, "subject_id"),
        _relation(base, CITATION, ids).withColumnRenamed(KEY, "calculation_id"))


def summary(base: Snapshot) -> DataFrame:
    """``lineage.trace_summary`` of everything kept."""
    return lineage.trace_summary(
        _relation(base, CALCULATION).withColumnRenamed(KEY, "calculation_id"),
        _relation(base, EVENT).withColumnRenamed(KEY, "entity_id"),
        _relation(base, CITATION).withColumnRenamed(KEY, "calculation_id"))

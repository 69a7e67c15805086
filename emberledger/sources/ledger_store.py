"""Ledger tables on shared storage, partitioned so that period filters prune files.

Every change is a commit of a ``SnapshotTable``: readers see the table before it or after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberledger.operators.bounds import settled
from emberledger.sources.snapshots import FILE, ROW, Partition, Snapshot, SnapshotTable

PARTITIONS = ["period_year", "entity_bucket"]
ENTITY_BUCKETS = 64
#: Rows of one of Spark's bit maps, of 4 KB, and bit maps that are broadcast (64 MB, for 500
#: million rows); of more, the join by file and chunk is left to the planner.
_CHUNK_BITS, _BROADCAST_CHUNKS = 15, 16384


def with_partitions(df: DataFrame, buckets: int = ENTITY_BUCKETS) -> DataFrame:
    """Year of the start and a bucket of the entity: few, bounded directories per year."""
    return df.withColumn("period_year", F.year("period_start")).withColumn(
        "entity_bucket", entity_bucket(F.col("entity_id"), buckets)
    )


def entity_bucket(entity_id, buckets: int = ENTITY_BUCKETS):
    return F.pmod(F.xxhash64(entity_id), F.lit(buckets)).cast("int")


def ledger_table(spark: SparkSession, path: str) -> SnapshotTable:
    return SnapshotTable(spark, path, PARTITIONS, options={"compression": "zstd"})


def append(df: DataFrame, path: str, buckets: int = ENTITY_BUCKETS) -> int:
    """Add rows; returns the version that has them."""
    return ledger_table(df.sparkSession, path).append(with_partitions(df, buckets))


def replace_rows(
    spark: SparkSession, df: DataFrame, path: str, key: str, buckets: int = ENTITY_BUCKETS
) -> int:
    """Insert rows in place of stored rows with the same key (recomputed calculations).

    A row may move to another year or entity: the stored partitions that hold one of the keys are
    rewritten along with those that the new rows fall into, and no others are. The keys' search
    reads two columns of the table and marks the places of the rows that go, a bit for each row;
    what stays is copied file by file. Returns the version that has the rows; ``ConcurrentWrite``
    if another writer has changed one of those partitions, or one of the keys, in the meantime.
    """
    table = ledger_table(spark, path)
    rows, base = settled(with_partitions(df, buckets), "ledger-rows"), table.snapshot()
    marks = _marked(base, rows.select(key), key)
    touched = table.partitions_of(marks.select(*PARTITIONS).union(rows.select(*PARTITIONS)))
    return table.commit(
        base, rows, touched, kept=_unmarked(base, marks, touched),
        clash=lambda new: bool(new.join(rows.select(key), key, "left_semi").limit(1).count()))


def _marked(base: Snapshot, keys: DataFrame, key: str) -> DataFrame:
    """(partition, file, chunk, marks): bit maps of the rows of a file whose key is among them."""
    found = base.placed_rows().select(key, *PARTITIONS, FILE, ROW).join(keys, key, "left_semi")
    chunk = [*PARTITIONS, FILE, "_chunk"]
    # Dealt out first, so that each bit map is made once and not in parts by every task.
    dealt = found.select(*PARTITIONS, FILE, F.shiftright(ROW, _CHUNK_BITS).alias("_chunk"),
                         _place().alias("_bit")).repartition(*chunk)
    return settled(dealt.groupBy(*chunk).agg(
        F.bitmap_construct_agg("_bit").alias("_marks")), "ledger-marks")


def _unmarked(base: Snapshot, marks: DataFrame, touched: set[Partition]) -> DataFrame:
    """The rows of the touched partitions that have no mark."""
    chunks = marks.select(FILE, "_chunk", "_marks")
    if marks.count() <= _BROADCAST_CHUNKS:
        chunks = F.broadcast(chunks)
    placed = base.placed_rows(touched.__contains__).withColumn(
        "_chunk", F.shiftright(ROW, _CHUNK_BITS)).join(chunks, [FILE, "_chunk"], "left")
    place = _place()
    byte = F.conv(F.hex(F.substring("_marks", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))),
                  16, 10).cast("int")
    gone = F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1
    return placed.where(F.col("_marks").isNull() | ~gone).select(*base.schema.names)


def _place():
    return F.col(ROW).bitwiseAND(F.lit((1 << _CHUNK_BITS) - 1))


def scan(
    spark: SparkSession,
    path: str,
    entity_id: str | None = None,
    year: int | None = None,
    document_id: str | None = None,
    buckets: int = ENTITY_BUCKETS,
    version: int | None = None,
) -> DataFrame:
    """Stored rows of the latest version, or of the one asked for. The folders of other years are
    not opened; the bucket of the entity and the document are pushed to the scan."""
    def wanted(partition: Partition) -> bool:
        return year is None or partition[0] == str(year)

    df = ledger_table(spark, path).snapshot(version).rows(wanted)
    if year is not None:
        df = df.where(F.col("period_year") == year)
    if entity_id is not None:
        df = df.where(F.col("entity_bucket") == entity_bucket(F.lit(entity_id), buckets))
        df = df.where(F.col("entity_id") == entity_id)
    if document_id is not None:
        df = df.where(F.col("source_document_id") == document_id)
    return df

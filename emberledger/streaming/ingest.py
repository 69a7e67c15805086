"""Incremental ingestion, calculation and totals with Structured Streaming.

Classification, factor matching and calculation keep no state, so the batch operators run on
a stream as they are: matching is a set of stream-static joins with the factor index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberledger.constants import DEFAULT_GEOGRAPHY
from emberledger.operators.classification import classify
from emberledger.operators.emissions import compute
from emberledger.operators.factors import FactorIndex
from emberledger.operators.inventory import TOTAL, scope_or_three
from emberledger.session import checkpoint_root
from emberledger.sources.delimited import identified, read_delimited


def ingest_exports(
    spark: SparkSession,
    folder: str,
    name: str,
    write: Callable[[DataFrame, int], None],
    mapping: dict[str, str] | None = None,
    default_geography: str = DEFAULT_GEOGRAPHY,
    files_per_batch: int = 100,
) -> StreamingQuery:
    """Hand the built rows of the exports that arrive in a folder to ``write(rows, batch_id)``.

    The stream is one of files, not of lines: each micro-batch reads its files with the batch
    reader, so that layouts may differ, rows have their line references, and ids are those of a
    batch read (see ``delimited.identified``). Rows keep their ``row_errors``. A batch may be
    handed over again after a failure, with the same ids.
    """
    files = (
        spark.readStream.format("binaryFile").schema(
            "path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", files_per_batch).load(folder).select("path")
    )

    def read(batch: DataFrame, batch_id: int) -> None:
        paths = [r.path for r in batch.collect()]  # at most files_per_batch
        if paths:
            rows = read_delimited(batch.sparkSession, paths, mapping, default_geography).rows
            write(identified(rows), batch_id)

    return upsert_available(files, name, read, "append")


def calculated(activities: DataFrame, index: FactorIndex) -> DataFrame:
    """Classified and calculated activities; works on streams and on tables alike."""
    return compute(classify(activities), index)


def running_scope_totals(computed: DataFrame) -> DataFrame:
    """Totals per entity, year and scope that keep up with a stream of calculations.

    State holds one row per entity, year and scope, and does not grow with the rows.
    """
    return (
        computed.where("calc_status = 'computed'")
        .groupBy("entity_id", F.year("period_start").alias("reporting_year"),
                 scope_or_three(F.col("scope")).alias("scope"))
        .agg(F.sum("result_tco2e").cast(TOTAL).alias("total_tco2e"),
             F.count(F.lit(1)).alias("activity_count"))
    )


def append_available(df: DataFrame, path: str, name: str) -> StreamingQuery:
    """Append everything that has arrived to a Parquet table, exactly once, and stop."""
    return (
        df.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", f"{checkpoint_root(df.sparkSession)}/{name}")
        .outputMode("append").trigger(availableNow=True).start()
    )


def upsert_available(
    df: DataFrame, name: str, write: Callable[[DataFrame, int], None], mode: str = "update"
) -> StreamingQuery:
    """Hand the changed rows of each micro-batch to ``write(rows, batch_id)``, then stop.

    A batch may be handed over again after a failure: ``write`` has to replace by key.
    """
    return (
        df.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", f"{checkpoint_root(df.sparkSession)}/{name}")
        .trigger(availableNow=True).start()
    )

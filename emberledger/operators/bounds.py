"""Fixed tables, and tables settled on shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from emberledger.session import checkpoint_root

#: Buckets of a settled table at most: of 200 million rows, each has some 3 million to sort.
BUCKETS = 64


def fixed_table(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """A table of constants (text and integers) that lives in the query plan itself."""
    data = {c: pa.array([r[n] for r in rows]) for n, c in enumerate(columns)}
    return spark.createDataFrame(pa.table(data))


def buckets(spark: SparkSession) -> int:
    """Buckets of a settled table. What is joined to one comes in as many partitions, or else the
    planner may shuffle the table to the larger number."""
    return min(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def settled(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows written to the shared folder and read back, so that no join derives them anew and
    the planner knows their size. Ids are hex digests, which zstd halves and snappy does not.

    With ``by`` they are dealt to buckets of that column as they are written: joins and groups by
    it then shuffle nothing, and columns under zstd take half of what rows take in a shuffle. Every
    writing task has a file for each bucket, hence few of them. One value is one bucket, which is
    never split: ``by`` is for ids with few rows each.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    if by is None:
        df.write.parquet(path, compression="zstd")
        return spark.read.schema(df.schema).parquet(path)
    # Spark knows the buckets of tables only: this one is named for as long as it takes to read it.
    table = f"spark_catalog.default.settled_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets(spark), by).saveAsTable(table, "parquet", path=path, compression="zstd")
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files are not its own and stay
    return rows

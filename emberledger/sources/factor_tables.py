"""Emission factor tables from JSON files, and the published ones that come with the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberledger import schemas
from emberledger.constants import PUBLISHED_FACTORS
from emberledger.operators.bounds import fixed_table


def factor_id() -> Column:
    return F.md5(
        F.concat_ws("|", "source", "source_version", "activity_type", "geography", "factor_unit",
                    F.col("effective_from").cast("string"))
    ).alias("factor_id")


def typed_factors(text_rows: DataFrame) -> DataFrame:
    """Factor rows read as text, with exact decimals, dates and an id."""
    extra = [c for c in text_rows.columns if c == "file_order"]
    return text_rows.select(
        "source", "source_version", "activity_type", "geography", "unit",
        F.col("factor_value").cast(schemas.FACTOR_VALUE).alias("factor_value"), "factor_unit",
        *[F.col(c).cast("date").alias(c)
          for c in ("published_date", "effective_from", "effective_to")],
        *extra,
    ).select(factor_id(), "*")


def read_factor_files(spark: SparkSession, paths) -> DataFrame:
    """JSON arrays of factors with ``file_order``, the order rows are to be loaded in."""
    rows = spark.read.schema(schemas.FACTOR_FILE).option("multiLine", True).json(paths)
    return typed_factors(rows.withColumn("file_order", F.monotonically_increasing_id()))


def published_factors(spark: SparkSession) -> DataFrame:
    columns = [c.split()[0] for c in schemas.FACTOR_FILE.split(", ")]
    return typed_factors(fixed_table(spark, PUBLISHED_FACTORS, columns))

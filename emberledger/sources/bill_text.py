"""Text of utility bills, page by page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_BREAK = "\f"


def read_bill_texts(spark: SparkSession, paths) -> DataFrame:
    """Bills stored as text files, pages separated by form feeds: doc_id and pages."""
    return (
        spark.read.option("wholetext", True).text(paths)
        .select(
            F.col("_metadata.file_path").alias("doc_id"),
            F.split("value", PAGE_BREAK, -1).alias("pages"),
        )
        .where(F.exists("pages", lambda p: F.rlike(p, F.lit(r"\S"))))
    )

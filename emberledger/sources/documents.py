"""Registry of uploaded documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberledger.functions.text import strip
from emberledger.operators.audit import audit_rows

FILE_TYPES = ("csv", "xlsx", "pdf")


def file_type(filename: Column, explicit: Column | None = None) -> Column:
    """Declared type if it is a known one, else the extension; null when unsupported."""
    by_name = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    known = F.when(by_name.isin(*FILE_TYPES), by_name)
    if explicit is None:
        return known
    declared = F.ltrim(F.lower(strip(explicit)), F.lit("."))
    return F.when(declared.isin(*FILE_TYPES), declared).otherwise(known)


def safe_name(filename: Column) -> Column:
    """File name without anything that could climb out of its folder."""
    flat = F.replace(filename, F.lit(".."), F.lit(""))
    flat = F.translate(flat, "/\\", "__")
    flat = F.ltrim(flat, F.lit("_"))
    return F.when(flat == "", F.lit("file")).otherwise(flat)


def register(
    files: DataFrame, entity_id: Column, filename: Column, content: Column,
    explicit_type: Column | None = None,
) -> DataFrame:
    """Document rows for file contents (binary or text)."""
    digest = F.sha2(content.cast("binary"), 256)
    return files.withColumns(
        {"_entity": entity_id, "_name": filename, "_hash": digest}
    ).select(
        F.md5(F.concat_ws("|", "_entity", "_hash", "_name")).alias("document_id"),
        F.col("_entity").alias("entity_id"), F.col("_name").alias("filename"),
        file_type(F.col("_name"), explicit_type).alias("file_type"),
        F.octet_length(content).cast("bigint").alias("file_size_bytes"),
        F.col("_hash").alias("file_hash_sha256"),
        F.concat(F.lit("documents/"), "_entity", F.lit("/"), "_hash", F.lit("/"),
                 safe_name(F.col("_name"))).alias("storage_path"),
        F.lit("pending").alias("status"),
    )


def register_folder(spark: SparkSession, path: str, entity_id: str) -> DataFrame:
    """Document rows for every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return register(files, F.lit(entity_id), name, F.col("content"))


def first_copies(documents: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Drop repeated uploads: one document per entity and content, and none already known."""
    key = ["entity_id", "file_hash_sha256"]
    rest = [c for c in documents.columns if c not in key]
    first = (
        documents.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), F.struct("filename", "document_id")).alias("_d"))
        .select(*key, "_d.*").select(*documents.columns)
    )
    return first if existing is None else first.join(existing, key, "left_anti")


def ingestion_audit(documents: DataFrame, outcomes: DataFrame, event_ts: Column) -> DataFrame:
    """Audit rows of the documents that were read; ``outcomes`` as of ``document_outcome``."""
    read = documents.join(
        outcomes.where("status = 'completed'").select("document_id", "rows_created"),
        "document_id",
    )
    return audit_rows(
        read, "source_document", F.col("entity_id"), "ingest_and_parse",
        F.lit("ingestion_pipeline"), event_ts,
        [F.col("document_id").alias("source_document_id"), "filename", "file_type",
         "rows_created"],
    )

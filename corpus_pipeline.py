"""The corpus pipeline: quality, line dedup, one of each group of near copies, decontamination,
tokens. Every stage works on all rows that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberledger.llm import decontamination, line_dedup, near_duplicates, quality, sentence_pieces
from emberledger.llm.queries import piece_model, table
from emberledger.llm.shared import ship, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Words of a shingle and percent of similarity from which the stage takes texts for near copies;
#: op9 has settings of its own.
NEAR_SIZE, NEAR_PERCENT = 5, 80


def _with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of documents with the new text and its length."""
    new = {"text": F.col(text), "n_chars": F.char_length(text).cast("long")}
    return docs.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).where("kept").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a later document holds too."""
    return _with_text(line_dedup.dedup_lines(docs), docs.columns, "line_text")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id."""
    groups = near_duplicates.near_groups(
        docs.select("doc_id", "text"), size=NEAR_SIZE, percent=NEAR_PERCENT)
    others = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("near_copy"))
    return docs.join(others, F.col("doc_id") == F.col("near_copy"), "left_anti")


def cut_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their benchmark spans; those over the coverage limit go."""
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return _with_text(found.where("not over"), docs.columns, "clean_text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and decoded text."""
    rows = sentence_pieces.encode(docs.select("doc_id", "source", "lang", "text"), piece_model())
    return rows.select(
        "doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids", F.sha2("decoded_text", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good), ("line_dedup", dedup_lines), ("near_copies", keep_one_of_near_copies),
    ("decontamination", cut_leaks), ("tokens", encode),
]

#: The quality model cannot be written in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to shared storage and read again."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs

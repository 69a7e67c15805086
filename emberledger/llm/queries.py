"""The registered queries of the corpus operators: each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberledger.llm import (
    decontamination, fill_in_middle, licenses, line_dedup, near_duplicates, personal_data, quality,
    recompression, sentence_pieces, simhash, spelling, suffix_dedup, token_counts,
)
from emberledger.llm.shared import ship

Query = Callable[[SparkSession, str], DataFrame]


def piece_model() -> str:
    """The vocabulary file of the piece tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("line_text", 256).alias("kept_sha256"))


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digest(documents(spark, sf_dir), piece_model()).drop("text")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).drop("text")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.digest(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), piece_model()).drop("text")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return personal_data.find(docs, personal_data.train(docs)).drop("text", "redacted")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    spans = F.expr("transform(licenses, x -> concat_ws(':', x.license, x.begin, x.stop))")
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(spans, ",").alias("licenses"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_groups(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(
        documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), cut=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(documents(spark, sf_dir)).drop("text")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(documents(spark, sf_dir))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_suffix_dedup, op2_line_dedup, op3_sentence_pieces, op4_quality_rules,
    op5_substring_dedup, op6_token_counts, op7_personal_data, op8_license_scans,
    op9_ngram_jaccard_join, op10_decontamination, op11_fill_in_middle,
    op12_spelling_variants, op13_simhash_near_dedup)}

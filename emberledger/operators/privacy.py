"""Redaction of supplier names and account numbers in free text.

Names are replaced first (longest first), then prefixed identifiers (``ACCT-..``), then
labelled ones (``Account Number: ..``), and at last any other mention of an identifier that
was found. All of it is built-in expressions over one text column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberledger.constants import ACCOUNT_LABEL_PATTERN, ACCOUNT_STANDALONE_PATTERN
from emberledger.functions.text import (
    bind,
    matches_of,
    regex_parts,
    regex_quote,
    squeeze,
    strip,
    substituted,
)
from emberledger.functions.tokens import SUPPLIER_PREFIX, tokenize_account, tokenize_supplier
from emberledger.operators.bounds import fixed_table
from emberledger.operators.names import ENTRY, with_names


def supplier_pattern(name: Column) -> Column:
    """Pattern of a name: any case, any spacing, whole words."""
    left = F.when(F.rlike(name, F.lit(r"(?U)^\w")), F.lit(r"\b")).otherwise(F.lit(""))
    right = F.when(F.rlike(name, F.lit(r"(?U)\w$")), F.lit(r"\b")).otherwise(F.lit(""))
    words = F.transform(F.split(squeeze(name), " "), regex_quote)
    return F.concat(F.lit("(?iU)"), left, F.array_join(words, r"\s+"), right)


def supplier_dictionary(suppliers: DataFrame) -> DataFrame:
    """Names (column ``name``) with length, token and pattern, tokens left out."""
    return (
        suppliers.select(strip(F.col("name")).alias("name"))
        .where((F.col("name") != "") & ~F.startswith("name", F.lit(SUPPLIER_PREFIX)))
        .distinct()
        .select(
            "name", F.length("name").alias("name_length"),
            tokenize_supplier(F.col("name")).alias("token"),
            supplier_pattern(F.col("name")).alias("pattern"),
        )
    )


def name_candidates(
    docs: DataFrame, text: str, suppliers: Sequence[str] | DataFrame, key: str
) -> DataFrame:
    """Add ``_names``: the dictionary entries that may be in each text, longest name first.

    One way for lists and tables of any length: see ``names``.
    """
    if not isinstance(suppliers, DataFrame):
        suppliers = fixed_table(docs.sparkSession, [(s,) for s in suppliers] or [("",)], ["name"])
    return with_names(docs, text, supplier_dictionary(suppliers), key)


def _replace_names(text: Column, entries: Column) -> Column:
    return F.aggregate(
        entries, text, lambda acc, e: F.regexp_replace(acc, e["pattern"], e["token"])
    )


def replaced_names(text: Column, entries: Column) -> Column:
    """(text, names): the running text after each name in turn, and the entries that changed it.
    A name inside a longer one that is replaced already does not count."""
    start = F.struct(text.alias("text"), F.array().cast(f"array<{ENTRY}>").alias("names"))
    return F.aggregate(entries, start, lambda acc, e: F.when(
        F.rlike(acc["text"], e["pattern"]),
        F.struct(F.regexp_replace(acc["text"], e["pattern"], e["token"]).alias("text"),
                 F.array_append(acc["names"], e).alias("names")),
    ).otherwise(acc))


def _label_identifier(match: Column) -> Column:
    return F.regexp_extract(match, ACCOUNT_LABEL_PATTERN, 2)


def _redact_label(match: Column) -> Column:
    return bind(
        _label_identifier(match),
        lambda identifier: F.concat(
            F.substr(match, F.lit(1), F.length(match) - F.length(identifier)),
            tokenize_account(identifier),
        ),
    )


def redact(
    docs: DataFrame, text: str, suppliers: Sequence[str] | DataFrame = (), key: str = "doc_id"
) -> DataFrame:
    """Add ``redacted_text`` and ``redactions`` (token and raw value of all that was found)."""
    df = name_candidates(docs.withColumn("_text", F.coalesce(text, F.lit(""))), "_text",
                         suppliers, key)
    df = df.withColumn("_done", replaced_names(F.col("_text"), F.col("_names"))).withColumns(
        {"_t1": F.col("_done.text"), "_suppliers": F.col("_done.names")})
    df = df.withColumn("_p1", regex_parts(F.col("_t1"), ACCOUNT_STANDALONE_PATTERN))
    df = df.withColumn("_p2", regex_parts(
        substituted(F.col("_p1"), tokenize_account), ACCOUNT_LABEL_PATTERN))
    df = df.withColumn("_t3", substituted(F.col("_p2"), _redact_label)).withColumn(
        "_raws", F.array_distinct(F.concat(
            matches_of(F.col("_p1")), F.transform(matches_of(F.col("_p2")), _label_identifier))))
    leftover = F.aggregate(
        F.col("_raws"), F.col("_t3"),
        lambda acc, raw: F.when(F.contains(acc, raw), F.regexp_replace(
            acc, F.concat(F.lit(r"(?<!TOKEN_)\b"), regex_quote(raw), F.lit(r"\b")),
            tokenize_account(raw),
        )).otherwise(acc),
    )
    redactions = F.concat(
        F.transform("_suppliers", lambda e: F.struct(
            F.lit("supplier").alias("kind"), e["token"].alias("token"),
            e["name"].alias("raw_value"))),
        F.transform("_raws", lambda r: F.struct(
            F.lit("account").alias("kind"), tokenize_account(r).alias("token"),
            r.alias("raw_value"))),
    )
    return df.select(
        *docs.columns,
        _replace_names(leftover, F.col("_names")).alias("redacted_text"),
        redactions.alias("redactions"),
    )


def token_map(redacted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token and raw value per document; to be written to a restricted place only."""
    return redacted.select(key, F.explode("redactions").alias("r")).select(key, "r.*").distinct()

"""Heterogeneous exports to activity rows: header mapping, typing, validation."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberledger.constants import (
    DEFAULT_GEOGRAPHY,
    HEADER_SYNONYMS,
    REQUIRED_FIELDS,
    TARGET_FIELDS,
)
from emberledger.functions.dates import parse_date
from emberledger.functions.numbers import parse_quantity
from emberledger.functions.text import blank_to_null, strip
from emberledger.functions.tokens import tokenize_supplier
from emberledger.operators.bounds import fixed_table


class ColumnMappingError(ValueError):
    """A header lacks a mapped or required column."""


def normalize_header(header: str | None) -> str:
    return "" if header is None else re.sub(r"[\s\-_]+", " ", str(header).strip().lower())


def normalize_header_column(header: Column) -> Column:
    return F.regexp_replace(F.lower(strip(header)), r"(?U)[\s\-_]+", " ")


def resolve_columns(
    headers: Sequence[str | None], mapping: dict[str, str] | None = None
) -> dict[str, str]:
    """Source column per target field for one header row (schema, not data).

    An explicit mapping may be written in either direction and must name existing columns;
    remaining targets take the first of their synonyms that is present and still free.
    """
    present = [h.strip() for h in headers if h and h.strip()]
    by_norm = {normalize_header(h): h for h in present}
    chosen: dict[str, str] = {}
    for left, right in (mapping or {}).items():
        left, right = str(left).strip(), str(right).strip()
        target, wanted = (right, left) if (
            left not in TARGET_FIELDS and right in TARGET_FIELDS
        ) else (left, right)
        actual = wanted if wanted in present else by_norm.get(normalize_header(wanted))
        if actual is None:
            raise ColumnMappingError(
                f"Mapped column '{wanted}' for field '{target}' not found in source headers: "
                f"{present}"
            )
        chosen[target] = actual
    taken = set(chosen.values())
    for target in TARGET_FIELDS:
        if target not in chosen:
            free = [by_norm[s] for s in HEADER_SYNONYMS[target]
                    if s in by_norm and by_norm[s] not in taken]
            if free:
                chosen[target] = free[0]
                taken.add(free[0])
    missing = [f for f in REQUIRED_FIELDS if f not in chosen]
    if missing:
        raise ColumnMappingError(
            f"Missing required column(s): {', '.join(missing)}. Available headers: {present}"
        )
    return chosen


def header_synonyms(spark, mapping: dict[str, str] | None = None) -> DataFrame:
    """The synonym table, ranked by preference within each target field.

    Explicitly mapped targets have only the mapped header, and a header that is mapped
    explicitly stands for no other target.
    """
    explicit = {}
    for left, right in (mapping or {}).items():
        swap = left.strip() not in TARGET_FIELDS and right.strip() in TARGET_FIELDS
        target, wanted = (right, left) if swap else (left, right)
        explicit[target.strip()] = normalize_header(wanted)
    rows = [(t, w, 0) for t, w in explicit.items()]
    rows += [
        (t, s, n)
        for t, syns in HEADER_SYNONYMS.items() if t not in explicit
        for n, s in enumerate(syns) if s not in explicit.values()
    ]
    return fixed_table(spark, rows, ["target_field", "synonym", "rank"])


def resolve_headers(headers: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Column mapping of many files at once.

    ``headers`` has file_id, pos and header, one row per column. Result: file_id,
    target_field, header, pos.
    """
    named = headers.where(strip(F.col("header")) != "").withColumn(
        "_norm", normalize_header_column(F.col("header"))
    )
    # Of two headers that normalise alike the later one counts.
    unique = named.groupBy("file_id", "_norm").agg(
        F.max_by(F.struct("header", "pos"), F.col("pos")).alias("_h")
    )
    dim = F.broadcast(header_synonyms(headers.sparkSession, mapping))
    return (
        unique.join(dim, F.col("_norm") == F.col("synonym"))
        .groupBy("file_id", "target_field")
        .agg(F.min_by("_h", "rank").alias("_h"))
        .select("file_id", "target_field", strip(F.col("_h.header")).alias("header"),
                F.col("_h.pos").alias("pos"))
    )


def missing_fields(
    headers: DataFrame, resolved: DataFrame, also: Sequence[str] = ()
) -> DataFrame:
    """Required fields that each file lacks (empty text when it lacks none).

    ``also`` names further fields to insist on, such as explicitly mapped ones.
    """
    needed = sorted({*REQUIRED_FIELDS, *also})
    found = resolved.groupBy("file_id").agg(
        *[F.bool_or(F.col("target_field") == f).alias(f"_{f}") for f in needed]
    )
    lacking = F.concat_ws(
        ", ", *[F.when(~F.coalesce(F.col(f"_{f}"), F.lit(False)), F.lit(f)) for f in needed]
    )
    return (
        headers.select("file_id").distinct().join(found, "file_id", "left")
        .select("file_id", lacking.alias("missing_fields"))
    )


def map_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename the columns of one export to the target fields (absent ones become null)."""
    chosen = resolve_columns(df.columns, mapping)
    by_stripped = {c.strip(): c for c in df.columns}
    passed = [c for c in df.columns if c.startswith("_ctx_")]
    return df.select(
        *[
            (F.col(f"`{by_stripped[chosen[t]]}`") if t in chosen else F.lit(None))
            .cast("string").alias(t)
            for t in TARGET_FIELDS
        ],
        *passed,
    )


def build_activities(
    raw: DataFrame,
    default_geography: str = DEFAULT_GEOGRAPHY,
    row_number: Column | None = None,
    pivot_year: int = 2025,
) -> DataFrame:
    """Type, default and validate raw text rows that carry the target fields.

    Every row is kept; ``row_errors`` lists what is wrong with it (empty for a good row) and
    :func:`split_quarantine` separates the two. ``row_number`` names rows that have no line
    reference (``row:n``).
    """
    def date(c: str) -> Column:
        return parse_date(F.col(c), pivot_year)

    text = {t: blank_to_null(F.col(t)) for t in TARGET_FIELDS}
    fallback_ref = (
        F.lit(None).cast("string") if row_number is None
        else F.concat(F.lit("row:"), row_number.cast("string"))
    )
    others = [c for c in raw.columns if c not in TARGET_FIELDS]
    typed = raw.select(
        *others,
        text["activity_type"].alias("activity_type"),
        parse_quantity(F.col("quantity")).alias("quantity"),
        text["unit"].alias("unit"),
        F.coalesce(text["geography"], F.lit(default_geography)).alias("geography"),
        date("period_start").alias("period_start"),
        date("period_end").alias("_end"),
        tokenize_supplier(F.col("supplier_ref")).alias("supplier_ref"),
        F.coalesce(text["raw_line_ref"], fallback_ref).alias("raw_line_ref"),
        text["quantity"].isNull().alias("_no_quantity"),
        text["period_start"].isNull().alias("_no_start"),
        text["period_end"].isNotNull().alias("_has_end"),
    )

    def problem(condition: Column, message: str) -> Column:
        return F.when(condition, F.lit(message))

    errors = F.array_compact(
        F.array(
            problem(F.col("activity_type").isNull(), "activity_type cannot be empty"),
            problem(F.col("_no_quantity"), "quantity cannot be empty"),
            problem(~F.col("_no_quantity") & F.col("quantity").isNull(),
                    "invalid quantity value"),
            problem(F.col("unit").isNull(), "unit cannot be empty"),
            problem(F.col("_no_start"), "period_start date cannot be empty"),
            problem(~F.col("_no_start") & F.col("period_start").isNull(), "invalid date value"),
            problem(F.col("_has_end") & F.col("_end").isNull(), "invalid period_end date"),
        )
    )
    return typed.select(
        *others, "activity_type", "quantity", "unit", "geography", "period_start",
        F.when(F.col("_has_end"), F.col("_end")).otherwise(F.col("period_start"))
        .alias("period_end"),
        "supplier_ref", "raw_line_ref", errors.alias("row_errors"),
    )


def split_quarantine(built: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows)."""
    bad = F.size("row_errors") > 0
    return built.where(~bad).drop("row_errors"), built.where(bad)


def document_outcome(built: DataFrame, strict: bool = True) -> DataFrame:
    """Status, row counts and first error of each document of ``built`` (by document_id).

    ``strict`` fails a document for a single bad row; otherwise only good rows are counted
    in and a document fails when it has none.
    """
    bad = F.size("row_errors") > 0
    counts = built.groupBy("document_id").agg(
        F.count_if(~bad).alias("good_rows"),
        F.count_if(bad).alias("bad_rows"),
        F.min(F.when(bad, F.concat("raw_line_ref", F.lit(": "), F.get("row_errors", F.lit(0)))))
        .alias("error_message"),
    )
    failed = F.col("bad_rows") > 0 if strict else F.col("good_rows") == 0
    return counts.select(
        "document_id",
        F.when(failed, F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
        F.when(failed, F.lit(0)).otherwise(F.col("good_rows")).alias("rows_created"),
        "bad_rows", "error_message",
    )

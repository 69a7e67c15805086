"""Audit rows, the audit log and the paged lists of the ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audit_rows(
    df: DataFrame,
    entity_type: str,
    entity_id: Column,
    action: str,
    actor: Column,
    event_ts: Column,
    detail: Sequence[str | Column],
) -> DataFrame:
    """One audit row per row of ``df``; ``detail`` becomes a JSON object."""
    return df.select(
        F.lit(entity_type).alias("entity_type"),
        entity_id.alias("entity_id"),
        F.lit(action).alias("action"),
        actor.alias("actor"),
        event_ts.alias("event_ts"),
        F.to_json(F.struct(*detail)).alias("detail"),
    )


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order. Spark keeps only limit + offset rows per task for this."""
    return df.orderBy(*order).offset(offset).limit(limit)


def _only(df: DataFrame, **wanted) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def list_audit_log(
    log: DataFrame,
    entity_id: str | None = None,
    entity_type: str | None = None,
    action: str | None = None,
    actor: str | None = None,
) -> DataFrame:
    return _only(log, entity_id=entity_id, entity_type=entity_type, action=action, actor=actor)


def list_anomalies(
    flags: DataFrame,
    entity_id: str | None = None,
    reporting_period: str | None = None,
    status: str | None = None,
    severity: str | None = None,
) -> DataFrame:
    return _only(
        flags, entity_id=entity_id, reporting_period=reporting_period, status=status,
        severity=severity,
    )


def list_disclosures(
    disclosures: DataFrame, entity_id: str | None = None, framework: str | None = None
) -> DataFrame:
    return _only(disclosures, entity_id=entity_id, framework=framework)


def list_outreach(
    outreach: DataFrame, entity_id: str | None = None, status: str | None = None
) -> DataFrame:
    return _only(outreach, entity_id=entity_id, status=status)


def review_queue(activities: DataFrame, entity_id: str | None = None) -> DataFrame:
    """Activities awaiting review; sort newest first with :func:`page`."""
    return _only(activities.where("status = 'pending_review'"), entity_id=entity_id)


def document_detail(documents: DataFrame, activities: DataFrame) -> DataFrame:
    """Documents with their line items, documents without any included."""
    lines = activities.select(
        F.col("source_document_id").alias("_doc"),
        *[c for c in activities.columns if c not in ("source_document_id", "entity_id", "status")],
        F.col("status").alias("activity_status"),
    )
    return documents.join(lines, F.col("document_id") == F.col("_doc"), "left").drop("_doc")

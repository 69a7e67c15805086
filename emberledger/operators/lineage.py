"""Provenance of calculations, and what may be deleted without breaking it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberledger import messages
from emberledger.functions.text import fill
from emberledger.operators.audit import audit_rows
from emberledger.operators.bounds import buckets, settled


def trace(
    calculations: DataFrame,
    activities: DataFrame,
    factors: DataFrame,
    documents: DataFrame,
) -> DataFrame:
    """Calculation with its activity, factor and, where there is one, source document."""
    acts = activities.select(
        "activity_id", "entity_id", "activity_type", "quantity", "unit", "geography",
        "period_start", "raw_line_ref", "source_document_id",
    )
    facs = factors.select(
        "factor_id", F.col("source").alias("factor_source"),
        F.col("source_version").alias("factor_version"), "factor_value", "factor_unit",
    )
    docs = documents.select(
        F.col("document_id").alias("source_document_id"), "filename",
        F.col("status").alias("document_status"),
    )
    # Factors last: what is shuffled to the documents has the id of the factor alone.
    return (
        calculations.join(acts, "activity_id")
        .join(docs, "source_document_id", "left")
        .join(facs, "factor_id")
    )


def trace_subjects(traced: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """What the log may speak of for each calculation: itself, its activity, its document."""
    return traced.select(
        "calculation_id", *carry,
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit("calculation").alias("subject_kind"),
                             F.col("calculation_id").alias("subject_id")),
                    F.struct(F.lit("activity").alias("subject_kind"),
                             F.col("activity_id").alias("subject_id")),
                    F.when(
                        F.col("filename").isNotNull(),
                        F.struct(F.lit("document").alias("subject_kind"),
                                 F.col("source_document_id").alias("subject_id")),
                    ),
                )
            )
        ).alias("s"),
    ).select("calculation_id", *carry, "s.*")


def trace_events(
    traced: DataFrame, audit_log: DataFrame, carry: Sequence[str] = ()
) -> DataFrame:
    """Audit events of each traced calculation: its own, its activity's and its document's.

    One row per calculation and event, in place of a list per calculation: the three kinds of
    subject are unpivoted so that a single equi join with the log finds them all. Columns to
    ``carry`` along spare a join of the events back to the trace. The subjects are settled by
    their ids: three rows per calculation with all that is carried are the largest table of a
    trace, and smaller in files than in a shuffle.
    """
    subjects = settled(trace_subjects(traced, carry), "subjects", by="subject_id")
    log = audit_log.select(
        F.col("entity_id").alias("subject_id"), "action", "actor", "event_ts"
    )
    return subjects.join(log, "subject_id")


def trace_summary(
    traced: DataFrame, audit_log: DataFrame, linked: DataFrame
) -> DataFrame:
    """One row per traced calculation: what it rests on, how many audit events its subjects have
    and when the last was, and the disclosures that cite it. Events are counted per subject
    before they meet the calculations, so a document with many of both multiplies nothing. The
    trace is derived once and settled by calculation; what is joined to it is dealt alike."""
    traced = settled(traced.select(
        "calculation_id", "activity_id", "source_document_id", "factor_source", "filename",
        "document_status"), "traced", by="calculation_id")
    by_calculation = buckets(traced.sparkSession), "calculation_id"
    events = audit_log.groupBy(F.col("entity_id").alias("subject_id")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("event_ts").alias("_last"))
    subjects = trace_subjects(traced).join(events, "subject_id").repartition(
        *by_calculation).groupBy("calculation_id").agg(
        F.sum("_n").alias("event_count"), F.max("_last").alias("last_event_ts"))
    cited = linked.repartition(*by_calculation).groupBy("calculation_id").agg(
        F.count(F.lit(1)).alias("disclosure_count"),
        F.min("disclosure_id").alias("first_disclosure_id"))
    return traced.select(
        "calculation_id", "activity_id", "factor_source", "filename", "document_status",
    ).join(subjects, "calculation_id", "left").join(cited, "calculation_id", "left").withColumns({
        "event_count": F.coalesce("event_count", F.lit(0)),
        "disclosure_count": F.coalesce("disclosure_count", F.lit(0))})


def linked_disclosures(lines: DataFrame, disclosures: DataFrame) -> DataFrame:
    """Disclosures that cite a calculation, one row per pair. The pairs are dealt as a table
    settled by calculation is."""
    pairs = lines.select("calculation_id", "disclosure_id").repartition(
        buckets(lines.sparkSession), "calculation_id")
    return pairs.distinct().join(
        disclosures.select("disclosure_id", "framework", "reporting_period", "status"),
        "disclosure_id",
    )


def calculation_deletable(calculations: DataFrame, lines: DataFrame) -> DataFrame:
    """Whether each calculation is free of disclosures, and how many block it."""
    blocking = (
        lines.select("calculation_id", "disclosure_id").distinct()
        .groupBy("calculation_id").agg(F.count(F.lit(1)).alias("blocking_count"))
    )
    df = calculations.join(blocking, "calculation_id", "left").withColumn(
        "blocking_count", F.coalesce("blocking_count", F.lit(0))
    )
    return df.withColumn("can_delete", F.col("blocking_count") == 0).withColumn(
        "reason",
        F.when(
            F.col("blocking_count") > 0,
            fill(messages.CALCULATION_BLOCKED, id=F.col("calculation_id"),
                 count=F.col("blocking_count")),
        ),
    )


def factor_deletable(factors: DataFrame, calculations: DataFrame) -> DataFrame:
    """Whether each factor is unused, and how many calculations use it."""
    usage = calculations.groupBy("factor_id").agg(F.count(F.lit(1)).alias("calculation_count"))
    df = factors.join(usage, "factor_id", "left").withColumn(
        "calculation_count", F.coalesce("calculation_count", F.lit(0))
    )
    return df.withColumn("can_delete", F.col("calculation_count") == 0).withColumn(
        "reason",
        F.when(
            F.col("calculation_count") > 0,
            fill(messages.FACTOR_BLOCKED, id=F.col("factor_id"),
                 count=F.col("calculation_count")),
        ),
    )


def guarded_delete(
    table: DataFrame, key: str, requested: DataFrame, verdicts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, outcome per requested id).

    ``requested`` holds ids under ``key``; ``verdicts`` has ``key, can_delete, reason``.
    Outcomes: deleted, blocked (with the reason) or not_found.
    """
    outcome = (
        requested.select(key).distinct()
        .join(verdicts.select(key, "can_delete", "reason"), key, "left")
        .select(
            key,
            F.when(F.col("can_delete"), F.lit("deleted"))
            .when(F.col("can_delete").isNull(), F.lit("not_found"))
            .otherwise(F.lit("blocked")).alias("outcome"),
            "reason",
        )
    )
    remaining = table.join(outcome.where("outcome = 'deleted'").select(key), key, "left_anti")
    return remaining, outcome


def deletion_audit(
    table: DataFrame, key: str, outcome: DataFrame, entity_type: str, action: str,
    actor: str, event_ts: Column, detail: list,
) -> DataFrame:
    """Audit rows of what was deleted, with the listed columns of the deleted row."""
    gone = table.join(outcome.where("outcome = 'deleted'").select(key), key)
    return audit_rows(gone, entity_type, F.col(key), action, F.lit(actor), event_ts, detail)

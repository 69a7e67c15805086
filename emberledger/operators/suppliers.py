"""Scope 3 suppliers without primary data, and the outreach to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberledger.functions.text import fill
from emberledger.messages import OUTREACH_TEMPLATES
from emberledger.operators.inventory import TOTAL

GAP = ["entity_id", "reporting_period", "supplier_ref", "activity_type"]


def supplier_gaps(ledger: DataFrame, outreach: DataFrame | None = None) -> DataFrame:
    """Scope 3 emissions per supplier and activity that rest on published factors.

    Every scope 3 group is listed. ``has_primary_response`` tells which suppliers have
    already answered an outreach for the activity and period.
    """
    gaps = (
        ledger.where("scope = 3")
        .withColumn("reporting_period", F.year("period_start").cast("string"))
        # By source first: the greatest text of a group would have Spark sort all of the rows.
        .groupBy(*GAP, "factor_source")
        .agg(F.sum("result_tco2e").alias("_t"), F.count(F.lit(1)).alias("_n"))
        .groupBy(*GAP)
        .agg(
            F.max("factor_source").alias("current_factor_source"),
            F.sum("_t").cast(TOTAL).alias("estimated_tco2e"),
            F.sum("_n").alias("line_item_count"),
        )
    )
    if outreach is None:
        return gaps
    answered = outreach.where("status = 'RECEIVED'").select(*GAP).distinct().withColumn(
        "_answered", F.lit(True)
    )
    return gaps.join(answered, GAP, "left").select(
        *gaps.columns, F.coalesce("_answered", F.lit(False)).alias("has_primary_response")
    )


def _letter(part: int) -> Column:
    """Subject (0) or body (1) by template type; unknown types get the last template."""
    words = {
        "year": F.col("reporting_period"), "name": F.col("_name"),
        "activity": F.col("activity_type"),
    }
    *special, default = OUTREACH_TEMPLATES
    chain = F
    for kind in special:
        chain = chain.when(
            F.col("template_type") == kind, fill(OUTREACH_TEMPLATES[kind][part], **words)
        )
    return chain.otherwise(fill(OUTREACH_TEMPLATES[default][part], **words))


def outreach_drafts(requests: DataFrame) -> DataFrame:
    """Outreach drafts for a table of requests.

    Columns of ``requests``: the gap key, supplier_name, template_type, custom_subject and
    custom_body; a custom text wins over the template. ``supplier_email`` and ``contact_name``
    come along where the requests have them.
    """
    def recipient(c: str) -> Column:
        return (F.col(c) if c in requests.columns else F.lit(None).cast("string")).alias(c)

    named = requests.withColumn(
        "_name",
        F.coalesce(F.when(F.col("supplier_name") != "", F.col("supplier_name")), "supplier_ref"),
    )

    def custom_or(column: str, template: Column) -> Column:
        return F.coalesce(F.when(F.col(column) != "", F.col(column)), template)

    return named.select(
        F.md5(F.concat_ws("|", *GAP, "template_type")).alias("outreach_id"),
        *GAP, "supplier_name", recipient("supplier_email"), recipient("contact_name"),
        "template_type",
        custom_or("custom_subject", _letter(0)).alias("subject"),
        custom_or("custom_body", _letter(1)).alias("body"),
        F.lit("DRAFT").alias("status"),
    )


def outreach_state(actions: DataFrame) -> DataFrame:
    """Current state of each outreach folded from its actions.

    Columns of ``actions``: outreach_id, action (CREATE, SEND or RESPOND), action_ts,
    action_id, and of responses primary_factor_value, primary_factor_unit,
    verified_quantity, response_notes. The last action decides the status; the time of
    sending and the response are those of the last action of that kind.
    """
    order = F.struct("action_ts", "action_id")

    def last(action: str, value: Column) -> Column:
        return F.max_by(
            F.when(F.col("action") == action, value),
            F.when(F.col("action") == action, order),
        )

    response = F.struct(
        "primary_factor_value", "primary_factor_unit", "verified_quantity", "response_notes"
    )
    status = (
        F.when(F.col("action") == "RESPOND", F.lit("RECEIVED"))
        .when(F.col("action") == "SEND", F.lit("SENT"))
        .otherwise(F.lit("DRAFT"))
    )
    return (
        actions.groupBy("outreach_id")
        .agg(
            F.max_by(status, order).alias("status"),
            last("SEND", F.col("action_ts")).alias("sent_at"),
            last("RESPOND", F.col("action_ts")).alias("responded_at"),
            last("RESPOND", response).alias("_response"),
            F.count(F.lit(1)).alias("action_count"),
        )
        .select(
            "outreach_id", "status", "sent_at", "responded_at", "action_count", "_response.*"
        )
    )


def outreach_audit(actions: DataFrame, drafts: DataFrame) -> DataFrame:
    """Audit row of every outreach action, with what it was about: the recipient of a draft, the
    time of sending, the answer with the time it was recorded."""
    action = (
        F.when(F.col("action") == "RESPOND", F.lit("RECORD_SUPPLIER_PRIMARY_DATA"))
        .when(F.col("action") == "SEND", F.lit("DISPATCH_SUPPLIER_OUTREACH"))
        .otherwise(F.lit("CREATE_SUPPLIER_OUTREACH"))
    )
    at = F.date_format("action_ts", "yyyy-MM-dd'T'HH:mm:ss")
    answer = F.struct(
        "primary_factor_value", "primary_factor_unit", "verified_quantity", "response_notes",
        at.alias("recorded_at"),
    )
    draft = F.struct("supplier_ref", "supplier_email", "template_type")
    about = drafts.select("outreach_id", "supplier_ref", "supplier_email", "template_type")
    return actions.join(about, "outreach_id", "left").select(
        F.lit("supplier_outreach").alias("entity_type"), F.col("outreach_id").alias("entity_id"),
        action.alias("action"), F.lit("outreach_agent").alias("actor"),
        F.col("action_ts").alias("event_ts"),
        F.when(F.col("action") == "RESPOND", F.to_json(answer))
        .when(F.col("action") == "SEND", F.to_json(F.struct(at.alias("sent_at"))))
        .otherwise(F.to_json(draft)).alias("detail"),
    )

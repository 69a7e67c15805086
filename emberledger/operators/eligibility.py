"""Which reporting frameworks apply to an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberledger import messages
from emberledger.constants import (
    CSRD_BALANCE_EUR,
    CSRD_EMPLOYEES,
    CSRD_NON_EU_TURNOVER_EUR,
    CSRD_TURNOVER_EUR,
    SB253_REVENUE_USD,
)
from emberledger.functions.text import fill


def _money(c: str) -> Column:
    return F.format_number(F.col(c), 2)


def _status(framework: str, eligible: Column, reason: Column, notes: Column) -> Column:
    return F.struct(
        F.lit(framework).alias("framework"), eligible.alias("is_eligible"),
        reason.alias("reason"), notes.alias("reporting_deadline_notes"),
    )


def _sb253() -> Column:
    rich = F.col("annual_revenue_usd") > SB253_REVENUE_USD
    local = F.col("does_business_in_california")
    revenue = _money("annual_revenue_usd")
    both = rich & local
    reason = F.when(both, fill(messages.SB253_YES, revenue=revenue)).otherwise(
        F.concat(
            F.concat_ws(
                "; ",
                F.when(~rich, fill(messages.SB253_REVENUE, revenue=revenue)),
                F.when(~local, F.lit(messages.SB253_NEXUS)),
            ),
            F.lit("."),
        )
    )
    notes = F.when(both, F.lit(messages.SB253_NOTES)).otherwise(
        F.lit(messages.INELIGIBLE_NOTES)
    )
    return _status("CA_SB253", rich & local, reason, notes)


def _csrd() -> Column:
    met = (
        (F.col("employee_count") > CSRD_EMPLOYEES).cast("int")
        + (F.col("eu_net_turnover_eur") > CSRD_TURNOVER_EUR).cast("int")
        + (F.col("balance_sheet_total_eur") > CSRD_BALANCE_EUR).cast("int")
    )
    eu = F.col("is_eu_parent")
    large_foreign = F.col("eu_net_turnover_eur") > CSRD_NON_EU_TURNOVER_EUR
    words = {
        "met": met, "employees": F.col("employee_count"),
        "turnover": _money("eu_net_turnover_eur"),
        "balance": _money("balance_sheet_total_eur"),
    }
    reason = (
        F.when(eu & (met >= 2), fill(messages.CSRD_YES, **words))
        .when(eu, fill(messages.CSRD_NO, **words))
        .when(large_foreign, fill(messages.CSRD_FOREIGN_YES, **words))
        .otherwise(fill(messages.CSRD_FOREIGN_NO, **words))
    )
    notes = (
        F.when(eu & (met >= 2), F.lit(messages.CSRD_NOTES))
        .when(~eu & large_foreign, F.lit(messages.CSRD_FOREIGN_NOTES))
        .otherwise(F.lit(messages.INELIGIBLE_NOTES))
    )
    return _status(
        "CSRD_ESRS_E1", F.when(eu, met >= 2).otherwise(large_foreign), reason, notes
    )


def _ghg_protocol() -> Column:
    return _status(
        "GHG_PROTOCOL", F.lit(True),
        F.lit(messages.GHG_PROTOCOL_YES), F.lit(messages.GHG_PROTOCOL_NOTES),
    )


def eligibility(profiles: DataFrame) -> DataFrame:
    """One row per entity and framework with verdict, reason and deadline notes.

    Columns of ``profiles``: entity_id, annual_revenue_usd, does_business_in_california,
    eu_net_turnover_eur, balance_sheet_total_eur, employee_count, is_eu_parent.
    """
    return profiles.select(
        "entity_id", F.inline(F.array(_sb253(), _csrd(), _ghg_protocol()))
    ).withColumn("mandatory_scopes", F.array(F.lit(1), F.lit(2), F.lit(3)))


def gate_requests(requests: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) disclosure requests; an entity without a profile passes.

    ``requests`` has entity_id and framework among its columns.
    """
    verdicts = eligibility(profiles).select("entity_id", "framework", "is_eligible", "reason")
    judged = requests.join(verdicts, ["entity_id", "framework"], "left")
    passes = F.coalesce("is_eligible", F.lit(True))
    rejected = judged.where(~passes).select(
        *requests.columns,
        fill(messages.GATE_REJECTION, framework=F.col("framework"), reason=F.col("reason"))
        .alias("rejection"),
    )
    return judged.where(passes).select(*requests.columns), rejected

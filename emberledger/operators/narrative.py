"""Sustainability narratives checked against the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberledger import messages
from emberledger.constants import NARRATIVE_CLAIM_PATTERN, NARRATIVE_MAX_SUPPORTED_PCT
from emberledger.functions.text import fill, fixed_text, signed_fixed_text
from emberledger.operators.anomalies import TONNES, year_over_year, yearly_scopes


def ledger_context(ledger: DataFrame, comparisons: DataFrame | None = None) -> DataFrame:
    """Total and per-scope emissions per entity and year, beside those of the baseline: the year
    before, or what ``comparisons`` name (see ``anomalies.year_over_year``)."""

    compared = year_over_year(yearly_scopes(ledger), comparisons).where("current_rows > 0")

    def total(part: str) -> Column:
        return F.sum(f"{part}_tco2e").cast(TONNES)

    def of_scope(part: str, s: int) -> Column:
        value = F.when(F.col("scope") == s, F.col(f"{part}_scoped_tco2e"))
        return F.coalesce(F.sum(value), F.lit(0)).cast(TONNES)

    df = compared.groupBy("entity_id", "reporting_year", "baseline_year").agg(
        total("current").alias("total_tco2e"),
        *[of_scope("current", s).alias(f"scope{s}_tco2e") for s in (1, 2, 3)],
        total("prior").alias("base_total_tco2e"),
        *[of_scope("prior", s).alias(f"base_scope{s}_tco2e") for s in (1, 2, 3)],
    )
    return df.withColumn(
        "ledger_pct_change",
        F.when(
            F.col("base_total_tco2e") > 0,
            ((F.col("total_tco2e") - F.col("base_total_tco2e")).cast(TONNES)
             / F.col("base_total_tco2e") * 100).cast("decimal(28,10)"),
        ),
    )


def context_text() -> Column:
    """The figures of a context row in words; without a baseline, of the year alone."""

    def words(prefix: str, year: Column) -> dict[str, Column]:
        return {
            "year": year,
            "total": fixed_text(F.col(f"{prefix}total_tco2e"), 2),
            **{f"s{s}": fixed_text(F.col(f"{prefix}scope{s}_tco2e"), 2) for s in (1, 2, 3)},
        }

    year = F.col("reporting_year")
    return F.concat_ws(
        "\n",
        fill(messages.CONTEXT_CURRENT, **words("", year)),
        fill(messages.CONTEXT_BASELINE, **words("base_", F.col("baseline_year")),
             change=pct_text(F.col("ledger_pct_change"))),
    )


def pct_text(pct: Column) -> Column:
    return F.coalesce(F.concat(signed_fixed_text(pct, 2), F.lit("%")), F.lit("N/A"))


def check_narratives(narratives: DataFrame, context: DataFrame) -> DataFrame:
    """First percentage claim of each narrative, its verdict and what the ledger says.

    Columns of ``narratives``: narrative_id, entity_id, reporting_year, narrative, and
    baseline_year if the context holds more than one comparison of a year. A claim above 20 % is
    flagged; the change in the ledger stands beside it for the auditor.
    """
    keys = ["entity_id", "reporting_year"]
    base = ["baseline_year"] if "baseline_year" in narratives.columns else []
    ledger = context.select(*keys, *base, "ledger_pct_change").select(
        *[F.col(c).alias(f"_{c}") for c in [*keys, *base]], "ledger_pct_change")
    claim = F.regexp_extract("narrative", NARRATIVE_CLAIM_PATTERN, 1)
    value = F.regexp_extract("narrative", NARRATIVE_CLAIM_PATTERN, 2)
    found = narratives.select(
        "narrative_id", *keys, *base,
        F.nullif(claim, F.lit("")).alias("claim_text"),
        value.try_cast("double").alias("claimed_pct"),
    )
    too_good = F.col("claimed_pct") > NARRATIVE_MAX_SUPPORTED_PCT
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*keys, *base]]
    return found.join(ledger, same, "left").select(
        "narrative_id", *keys, *base, "claim_text", "claimed_pct",
        F.when(F.col("claim_text").isNotNull(),
               F.when(too_good, F.lit("POTENTIAL_GREENWASHING")).otherwise(F.lit("SUPPORTED")))
        .alias("verdict"),
        F.when(too_good, F.lit("FLAGGED")).otherwise(F.lit("CLEAN")).alias("overall_status"),
        pct_text(F.col("ledger_pct_change")).alias("actual_metric"),
        "ledger_pct_change",
    )


def narrative_flags(checked: DataFrame) -> DataFrame:
    """Anomaly flags of the narratives that were flagged."""
    return checked.where("overall_status = 'FLAGGED'").select(
        F.md5(F.concat_ws("|", "entity_id", F.col("reporting_year").cast("string"),
                          F.lit("NARRATIVE_INCONSISTENCY"),
                          F.col("narrative_id").cast("string"))).alias("flag_id"),
        "entity_id", F.col("reporting_year").cast("string").alias("reporting_period"),
        F.lit("NARRATIVE_INCONSISTENCY").alias("flag_type"),
        F.lit("CRITICAL").alias("severity"),
        F.lit(messages.NARRATIVE_TITLE).alias("title"),
        F.lit(messages.NARRATIVE_TEXT).alias("description"),
        F.lit("OPEN").alias("status"),
        F.col("narrative_id").cast("string").alias("subject_id"),
        F.col("claimed_pct").alias("metric"),
        F.to_json(F.struct("claim_text", "verdict", "claimed_pct", "actual_metric"))
        .alias("details_json"),
    )

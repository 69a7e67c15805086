"""The ledger (calculation with its activity) and selection by reporting period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberledger.operators.emissions import COMPUTED

LEDGER_COLUMNS = [
    "calculation_id", "activity_id", "factor_id", "factor_source", "source_document_id",
    "entity_id", "activity_type", "unit", "quantity", "scope", "ghg_category", "supplier_ref",
    "period_start", "period_end", "result_tco2e",
]


def ledger_of(computed: DataFrame, *extra: str) -> DataFrame:
    """Ledger rows straight from ``compute``: no join back to the activities is needed."""
    return computed.where(F.col("calc_status") == COMPUTED).select(*LEDGER_COLUMNS, *extra)


def join_ledger(
    calculations: DataFrame, activities: DataFrame, factors: DataFrame | None = None
) -> DataFrame:
    """Ledger from stored tables: calculation joined to its activity, and to its factor."""
    df = calculations.join(activities, "activity_id")
    if factors is not None:
        df = df.join(
            factors.select("factor_id", F.col("source").alias("factor_source")), "factor_id"
        )
    else:
        df = df.withColumn("factor_source", F.lit(None).cast("string"))
    return df.select(*LEDGER_COLUMNS)


def reported_years(start: Column, end: Column) -> Column:
    """Every year an activity is reported in when either end of it counts."""
    return F.array_distinct(F.array(F.year(start), F.year(end)))


def by_overlap_year(ledger: DataFrame) -> DataFrame:
    """Ledger with ``reporting_year``; an activity spanning new year appears in both years."""
    return ledger.withColumn(
        "reporting_year", F.explode(reported_years(F.col("period_start"), F.col("period_end")))
    )


def period_keys(start: Column, end: Column, mode: str) -> Column:
    """The periods, as text, that an activity is selected by.

    ``overlap_year``: the years of its start and of its end. ``start_year``: the year of its
    start; a request for a quarter ``Y-Qn`` counts as one for its year. ``quarter``: the year and
    the quarter of its start.
    """
    year = F.year(start).cast("string")
    if mode == "overlap_year":
        return F.array_compact(F.array_distinct(F.array(year, F.year(end).cast("string"))))
    if mode == "start_year":
        return F.array_compact(F.array(year))
    if mode == "quarter":
        return F.array_compact(F.array(
            year, F.concat(year, F.lit("-Q"), F.quarter(start).cast("string"))))
    raise ValueError(f"unknown period mode {mode!r}")


def request_key(period: Column, mode: str) -> Column:
    """The period key that a request asks for; null for a text that is none."""
    if mode != "start_year":
        return period
    return F.when(F.rlike(period, F.lit(r"^\d{4}(-Q[1-4])?$")), F.substring(period, 1, 4))


def answer_requests(
    ledger: DataFrame, requests: DataFrame, mode: str, fallback_all: bool
) -> DataFrame:
    """Ledger rows with the columns of the requests that they answer, and ``is_fallback``.

    Rows meet requests of their entity and period alone. With ``fallback_all`` the requests that
    no row answers, and only they, meet all rows of their entity.
    """
    wanted = requests.distinct().withColumn("_key", request_key(F.col("reporting_period"), mode))
    keyed = ledger.withColumn(
        "_key", F.explode(period_keys(F.col("period_start"), F.col("period_end"), mode)))
    hits = keyed.join(wanted, ["entity_id", "_key"]).drop("_key").withColumn(
        "is_fallback", F.lit(False))
    if not fallback_all:
        return hits
    known = keyed.select("entity_id", "_key").distinct()
    unanswered = wanted.join(known, ["entity_id", "_key"], "left_anti").drop("_key")
    return hits.unionByName(
        ledger.join(unanswered, "entity_id").withColumn("is_fallback", F.lit(True)))


def select_period(
    ledger: DataFrame, requests: DataFrame, mode: str = "start_year", fallback_all: bool = False
) -> DataFrame:
    """Ledger rows of each requested (entity_id, reporting_period), see ``period_keys``.

    With ``fallback_all`` a request that matches nothing gets every row of its entity.
    """
    wanted = requests.select("entity_id", "reporting_period")
    return answer_requests(ledger, wanted, mode, fallback_all)

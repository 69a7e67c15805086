"""Inventories: scope totals, hotspots, trends and the dashboard.

Everything here starts from :func:`inventory`, one partial-then-final aggregation of the
ledger to (entity, year, scope, category). What follows works on that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOTAL = "decimal(30,8)"
SCOPES = (1, 2, 3)


def scope_or_three(scope: Column) -> Column:
    return F.when(scope.isin(*SCOPES), scope).otherwise(F.lit(3))


def share_pct(part: Column, whole: Column) -> Column:
    """Percentage rounded to 2 decimals; 0 when there is nothing to share."""
    ratio = part.cast("decimal(26,8)") / F.when(whole > 0, whole.cast("decimal(26,8)"))
    return F.coalesce(F.bround(ratio * 100, 2), F.lit(0).cast("decimal(12,2)")).cast(
        "decimal(12,2)"
    )


def labelled(ledger: DataFrame) -> DataFrame:
    """Entity, start year, scope and category (dashboard labelling) of each result."""
    scope = scope_or_three(F.col("scope"))
    label = F.coalesce(
        F.when(F.col("ghg_category") != "", F.col("ghg_category")),
        F.concat(F.lit("Scope "), scope.cast("string"), F.lit(" Uncategorized")),
    )
    return ledger.select(
        "entity_id", F.year("period_start").alias("reporting_year"), scope.alias("scope"),
        label.alias("ghg_category"), "result_tco2e",
    )


def inventory(ledger: DataFrame) -> DataFrame:
    """Totals per entity, start year, scope and category."""
    return (
        labelled(ledger)
        .groupBy("entity_id", "reporting_year", "scope", "ghg_category")
        .agg(
            F.sum("result_tco2e").cast(TOTAL).alias("total_tco2e"),
            F.count(F.lit(1)).alias("activity_count"),
        )
    )


def _scope_sum(scope: int, value: str = "total_tco2e") -> Column:
    return F.coalesce(
        F.sum(F.when(F.col("scope") == scope, F.col(value))), F.lit(0)
    ).cast(TOTAL)


def scope_totals(inv: DataFrame) -> DataFrame:
    """Three rows per entity and year, zero-filled, with the share of each scope."""
    wide = inv.groupBy("entity_id", "reporting_year").agg(
        *[_scope_sum(s).alias(f"s{s}") for s in SCOPES],
        F.sum("total_tco2e").cast(TOTAL).alias("gross_tco2e"),
        F.sum("activity_count").alias("total_calculations"),
    )
    return wide.select(
        "entity_id", "reporting_year", "gross_tco2e", "total_calculations",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s).alias("scope"), F.col(f"s{s}").alias("total_tco2e"))
                    for s in SCOPES
                ]
            )
        ),
    ).withColumn("share_percentage", share_pct(F.col("total_tco2e"), F.col("gross_tco2e")))


def _categories(inv: DataFrame) -> DataFrame:
    """Totals per category whatever its scope, ranked within entity and year."""
    per_category = inv.groupBy("entity_id", "reporting_year", "ghg_category").agg(
        F.max("scope").alias("scope"),
        F.sum("total_tco2e").cast(TOTAL).alias("total_tco2e"),
        F.sum("activity_count").alias("activity_count"),
        *[_scope_sum(s).alias(f"s{s}") for s in SCOPES],
    )
    whole = Window.partitionBy("entity_id", "reporting_year")
    ranked = whole.orderBy(F.desc("total_tco2e"), "ghg_category")
    return per_category.select(
        "*",
        F.row_number().over(ranked).alias("hotspot_rank"),
        F.sum("total_tco2e").over(whole).cast(TOTAL).alias("gross_tco2e"),
    )


def hotspots(inv: DataFrame, top: int = 5) -> DataFrame:
    """The categories with the largest totals of each entity and year."""
    return (
        _categories(inv)
        .where(F.col("hotspot_rank") <= top)
        .select(
            "entity_id", "reporting_year", "hotspot_rank", "ghg_category", "scope",
            "total_tco2e", share_pct(F.col("total_tco2e"), F.col("gross_tco2e"))
            .alias("share_percentage"),
            "activity_count",
        )
    )


def yearly_trend(inv: DataFrame) -> DataFrame:
    """Scope 1, 2, 3 and total per entity and year."""
    return inv.groupBy("entity_id", "reporting_year").agg(
        *[_scope_sum(s).alias(f"scope{s}_tco2e") for s in SCOPES],
        F.sum("total_tco2e").cast(TOTAL).alias("total_tco2e"),
    )


def open_flag_counts(flags: DataFrame) -> DataFrame:
    """Open and open critical anomaly flags per entity, over all periods."""
    return flags.where("status = 'OPEN'").groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("open_anomalies_count"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_anomalies_count"),
    )


def dashboard(inv: DataFrame, flag_counts: DataFrame, top: int = 5) -> DataFrame:
    """One nested row per entity and year: totals, hotspots, the trend and open flags."""
    per_year = (
        _categories(inv)
        .groupBy("entity_id", "reporting_year")
        .agg(
            *[F.sum(f"s{s}").cast(TOTAL).alias(f"scope{s}_tco2e") for s in SCOPES],
            F.sum("total_tco2e").cast(TOTAL).alias("gross_tco2e"),
            F.sum("activity_count").alias("total_calculations"),
            F.array_sort(
                F.collect_list(
                    F.when(
                        F.col("hotspot_rank") <= top,
                        F.struct("hotspot_rank", "ghg_category", "scope", "total_tco2e",
                                 "activity_count"),
                    )
                )
            ).alias("top_hotspots"),
        )
        .withColumn(
            "scope_breakdown",
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("scope"), F.col(f"scope{s}_tco2e").alias("total_tco2e"),
                        share_pct(F.col(f"scope{s}_tco2e"), F.col("gross_tco2e"))
                        .alias("share_percentage"),
                    )
                    for s in SCOPES
                ]
            ),
        )
    )
    per_entity = Window.partitionBy("entity_id")
    point = F.struct(
        "reporting_year", "scope1_tco2e", "scope2_tco2e", "scope3_tco2e",
        F.col("gross_tco2e").alias("total_tco2e"),
    )
    return (
        per_year.withColumn(
            "historical_trends", F.array_sort(F.collect_list(point).over(per_entity))
        )
        .join(flag_counts, "entity_id", "left")
        .fillna(0, ["open_anomalies_count", "critical_anomalies_count"])
    )

"""Abatement scenarios: what levers would save, and at what cost per tonne."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberledger.constants import CAPEX_AMORTISATION, LEVERS
from emberledger.operators.bounds import fixed_table
from emberledger.operators.inventory import TOTAL

SCENARIO = ["scenario_id", "entity_id", "reporting_period"]
_TONNES = "decimal(28,8)"
_USD = "decimal(20,4)"


def lever_catalogue(spark) -> DataFrame:
    """The five standard levers with their default economics."""
    return fixed_table(
        spark, LEVERS,
        ["lever_id", "title", "target_scope", "keyword", "capex", "opex", "abatement"],
    ).select(
        "lever_id", "title", F.col("target_scope").cast("int").alias("target_scope"), "keyword",
        F.col("capex").cast(_USD).alias("default_capex_usd"),
        F.col("opex").cast(_USD).alias("default_annual_opex_delta_usd"),
        F.col("abatement").cast("decimal(4,2)").alias("abatement_factor"),
    )


def _activity_totals(ledger: DataFrame) -> DataFrame:
    """Everything a lever can look at, aggregated before any lever meets it."""
    return (
        ledger.select(
            "entity_id", F.year("period_start").alias("_year"),
            F.lower("activity_type").alias("_type"), F.lower("ghg_category").alias("_category"),
            F.col("scope").alias("_scope"), "result_tco2e",
        )
        .groupBy("entity_id", "_year", "_type", "_category", "_scope")
        .agg(F.sum("result_tco2e").cast(TOTAL).alias("_tco2e"))
    )


def simulate(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """Impact of every requested lever, ranked by cost per tonne within its scenario.

    Columns of ``requests``: scenario_id, entity_id, reporting_period, request_idx, lever_id,
    implementation_rate, custom_capex_usd, custom_annual_opex_delta_usd. Unknown levers are
    skipped. A lever touches what its keyword names in activity type or category; only if no
    activity type of the period contains the keyword, also everything of its scope. A period
    without rows falls back to all rows of the entity.
    """
    asked = requests.join(
        F.broadcast(lever_catalogue(requests.sparkSession)), "lever_id"
    ).withColumn(
        "_asked_year",
        F.when(F.rlike("reporting_period", F.lit(r"^\d{4}(-Q[1-4])?$")),
               F.substring("reporting_period", 1, 4).cast("int")),
    )
    keys = [
        *SCENARIO, "request_idx", "lever_id", "title", "target_scope",
        "implementation_rate", "custom_capex_usd", "custom_annual_opex_delta_usd",
        "default_capex_usd", "default_annual_opex_delta_usd", "abatement_factor",
    ]
    joined = asked.join(_activity_totals(ledger), "entity_id", "left")
    in_period = F.coalesce(F.col("_year") == F.col("_asked_year"), F.lit(False))
    in_type = F.coalesce(F.contains("_type", "keyword"), F.lit(False))
    by_keyword = in_type | F.coalesce(F.contains("_category", "keyword"), F.lit(False))
    by_scope = ~by_keyword & F.coalesce(F.col("_scope") == F.col("target_scope"), F.lit(False))

    def both(name: str, condition: Column) -> list[Column]:
        """The same sum over the period and over all rows (for the fallback)."""
        value = F.when(condition, F.col("_tco2e"))
        return [
            F.coalesce(F.sum(F.when(in_period, value)), F.lit(0)).cast(TOTAL).alias(name),
            F.coalesce(F.sum(value), F.lit(0)).cast(TOTAL).alias(f"all_{name}"),
        ]

    sums = joined.groupBy(*keys).agg(
        F.bool_or(in_period).alias("period_found"),
        F.coalesce(F.bool_or(in_period & in_type), F.lit(False)).alias("type_hit"),
        F.coalesce(F.bool_or(in_type), F.lit(False)).alias("all_type_hit"),
        *both("gross", F.lit(True)), *both("keyword_tco2e", by_keyword),
        *both("scope_tco2e", by_scope),
    )

    def chosen(name: str) -> Column:
        return F.when(F.col("period_found"), F.col(name)).otherwise(F.col(f"all_{name}"))

    baseline = chosen("keyword_tco2e") + F.when(
        ~chosen("type_hit"), chosen("scope_tco2e")
    ).otherwise(F.lit(0).cast(TOTAL))
    capex = F.coalesce("custom_capex_usd", "default_capex_usd").cast(_USD)
    opex = F.coalesce("custom_annual_opex_delta_usd", "default_annual_opex_delta_usd").cast(_USD)
    impact = (
        sums.withColumn("baseline_gross_tco2e", chosen("gross").cast(_TONNES))
        .withColumn("baseline_emissions_tco2e", baseline.cast(_TONNES))
        .withColumn(
            "reduction_tco2e",
            (F.col("baseline_emissions_tco2e").cast("decimal(24,8)")
             * (F.col("implementation_rate").cast("decimal(7,6)")
                * F.col("abatement_factor")).cast("decimal(9,8)")).cast("decimal(32,12)"),
        )
        .withColumn(
            "annualized_net_cost_usd",
            (capex * F.lit(CAPEX_AMORTISATION).cast("decimal(3,2)") + opex).cast("decimal(22,6)"),
        )
    )
    reduction = F.col("reduction_tco2e")
    cost_per_tonne = F.when(
        reduction > 0, F.bround(F.col("annualized_net_cost_usd") / reduction, 2)
    ).otherwise(F.lit(0)).cast("decimal(24,2)")
    percent = F.when(
        F.col("baseline_emissions_tco2e") > 0,
        F.bround(reduction / F.col("baseline_emissions_tco2e").cast("decimal(24,8)") * 100, 2),
    ).otherwise(F.lit(0)).cast("decimal(7,2)")
    ranked = Window.partitionBy(*SCENARIO).orderBy("mac_usd_per_tco2e", "request_idx")
    return (
        impact.withColumn("mac_usd_per_tco2e", cost_per_tonne)
        .withColumn("reduction_percent", percent)
        .withColumn(
            "simulated_emissions_tco2e",
            (F.col("baseline_emissions_tco2e") - reduction).cast("decimal(32,12)"),
        )
        .withColumn("roi_rank", F.row_number().over(ranked))
        .select(
            *SCENARIO, "request_idx", "lever_id", "title",
            F.col("target_scope").alias("scope"), "baseline_gross_tco2e",
            "baseline_emissions_tco2e", "simulated_emissions_tco2e", "reduction_tco2e",
            "reduction_percent", "annualized_net_cost_usd", "mac_usd_per_tco2e", "roi_rank",
        )
    )


def scenario_totals(impacts: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Sum of the levers per scenario, and whether the target reduction is met.

    Columns of ``targets``: the scenario key and target_reduction_percent.
    """
    totals = impacts.groupBy(*SCENARIO).agg(
        F.max("baseline_gross_tco2e").alias("baseline_gross_tco2e"),
        F.sum("reduction_tco2e").cast("decimal(32,12)").alias("total_reduction_tco2e"),
        F.sum("annualized_net_cost_usd").cast("decimal(24,6)").alias("net_annual_cost_usd"),
    )
    exact_pct = F.when(
        F.col("baseline_gross_tco2e") > 0,
        F.col("total_reduction_tco2e")
        / F.col("baseline_gross_tco2e").cast("decimal(24,8)") * 100,
    ).otherwise(F.lit(0).cast("decimal(10,2)"))
    totals = totals.withColumn("_pct", exact_pct.cast("decimal(28,12)"))
    if targets is None:
        totals = totals.withColumn("target_reduction_percent", F.lit(None).cast("decimal(7,4)"))
    else:
        totals = totals.join(targets, SCENARIO, "left")
    return totals.select(
        *SCENARIO, "baseline_gross_tco2e",
        (F.col("baseline_gross_tco2e") - F.col("total_reduction_tco2e"))
        .cast("decimal(32,12)").alias("simulated_gross_tco2e"),
        "total_reduction_tco2e",
        F.bround("_pct", 2).cast("decimal(9,2)").alias("total_reduction_percent"),
        "net_annual_cost_usd",
        (F.col("_pct") >= F.col("target_reduction_percent")).alias("target_met"),
    )

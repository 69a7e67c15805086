"""From matched activities to tonnes of CO2e."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberledger import messages
from emberledger.functions.text import bind, fill, plain_decimal_text
from emberledger.functions.units import factor_denominator, normalize_unit
from emberledger.operators.factors import FactorIndex, match_factors, with_reasons

COMPUTED = "computed"
PENDING_FACTOR = "pending_factor"
CALCULATION_ERROR = "calculation_error"


def exact_product(quantity: Column, multiplier: Column, scale: int, cut: int) -> Column:
    """Product of a decimal(20,6) and a decimal with ``scale`` decimals, none of them negative,
    as a decimal that rounds exactly to any place before its last; null where it is too large.

    The multiplier is taken apart into its integer, its first ``cut`` and its other decimals, so
    that no partial product exceeds 38 digits. Of the smallest one the digits after the last
    place are cut: whatever they are, they do not change a rounding (half up) further up.
    """
    whole = F.floor(multiplier).cast("decimal(11,0)")
    rest = (multiplier - whole).cast(f"decimal({scale},{scale})")
    first = F.floor(rest, F.lit(cut)).cast(f"decimal({cut},{cut})")
    # Counted in units of the last place of the first part, then brought back.
    other = ((rest - first).cast(f"decimal({scale},{scale})")
             * F.lit(10 ** cut).cast(f"decimal({cut + 1},0)")).cast(
        f"decimal({scale - cut},{scale - cut})")
    unit = F.lit(f"0.{'1'.zfill(cut)}").cast(f"decimal({cut},{cut})")
    small = F.floor(quantity * other, F.lit(6)).cast("decimal(20,6)") * unit
    part, both = f"decimal(35,{6 + cut})", f"decimal(36,{6 + cut})"
    large = (quantity * whole).try_cast(part) + (quantity * first).try_cast(part)
    return large + small.try_cast(both)


def tonnes(quantity: Column, multiplier: Column) -> Column:
    """Product rounded once (half up) to 8 decimals, exact for every quantity and multiplier;
    null where it does not fit decimal(20,8)."""
    # Nearly all multipliers have at most 12 decimals; with them one multiplication is exact.
    short = F.abs(multiplier).try_cast("decimal(17,12)")
    absolute = bind(
        F.struct(F.abs(quantity.cast("decimal(20,6)")).alias("q"), F.abs(multiplier).alias("m"),
                 short.alias("s")),
        lambda x: F.round(F.when(x["s"] == x["m"], (x["q"] * x["s"]).cast("decimal(38,18)"))
                          .otherwise(exact_product(x["q"], x["m"], 27, 13)), 8)
        .try_cast("decimal(20,8)"))
    return F.when((quantity < 0) == (multiplier < 0), absolute).otherwise(-absolute)


def attach_units(matched: DataFrame, index: FactorIndex) -> DataFrame:
    """Unit ratio and multiplier of the matched factor; null when the unit does not convert."""
    return matched.withColumn("_unit", normalize_unit(F.col("unit"))).join(
        index.multipliers,
        (F.col("factor_id") == F.col("m_factor_id")) & (F.col("_unit") == F.col("from_unit")),
        "left",
    ).drop("_unit", "m_factor_id", "from_unit")


def compute(activities: DataFrame, index: FactorIndex) -> DataFrame:
    """Match, convert and multiply every activity in one pass without a shuffle.

    Adds the factor columns, ``fallback_level, unit_ratio, numerator_ratio, result_tco2e,
    calculation_id`` and ``calc_status`` (computed, pending_factor or calculation_error).
    The id is a function of activity and factor, so a repeated run replaces its own rows.
    """
    df = attach_units(match_factors(activities, index), index)
    return df.withColumn("result_tco2e", tonnes(F.col("quantity"), F.col("multiplier"))).withColumn(
        "calc_status",
        F.when(F.col("factor_id").isNull(), PENDING_FACTOR)
        .when(F.col("result_tco2e").isNotNull(), COMPUTED)
        .otherwise(CALCULATION_ERROR),
    ).withColumn(
        "calculation_id",
        F.when(
            F.col("calc_status") == COMPUTED,
            F.md5(F.concat_ws("|", "activity_id", "factor_id")),
        ),
    )


def converted_quantity(df_quantity: Column, unit_ratio: Column) -> Column:
    """Quantity in the unit of the factor, to 15 decimals (exact for every listed ratio)."""
    absolute = bind(
        F.struct(F.abs(df_quantity.cast("decimal(20,6)")).alias("q"), unit_ratio.alias("r")),
        lambda x: F.round(exact_product(x["q"], x["r"], 30, 15), 15).try_cast("decimal(32,15)"))
    return F.when(df_quantity < 0, -absolute).otherwise(absolute)


def formula_text() -> Column:
    """Readable calculation over the columns of ``compute``."""
    q = plain_decimal_text(F.col("quantity"))
    converted = plain_decimal_text(converted_quantity(F.col("quantity"), F.col("unit_ratio")))
    numerator = F.col("numerator_ratio")
    return F.concat(
        F.concat_ws(
            " ",
            F.concat_ws(" ", q, "unit"),
            F.when(
                F.col("unit_ratio") != 1,
                F.concat(F.lit("[converted: "), converted, F.lit(" "), "denominator", F.lit("]")),
            ),
            F.concat(
                F.lit("* "), plain_decimal_text(F.col("factor_value")), F.lit(" "), "factor_unit"
            ),
            F.when(numerator == F.lit("0.001").cast("decimal(4,3)"), F.lit("/ 1000 [kg to t]"))
            .when(numerator == F.lit("0.000001").cast("decimal(7,6)"),
                  F.lit("/ 1000000 [g to t]"))
            .when(numerator != 1,
                  F.concat(F.lit("* "), plain_decimal_text(numerator), F.lit(" [to tCO2e]"))),
        ),
        F.lit(" = "), F.col("result_tco2e").cast("string"), F.lit(" tCO2e"),
    )


def calculations(computed: DataFrame, computed_by: str, computed_at: Column) -> DataFrame:
    """Rows of the calculation table."""
    return computed.where(F.col("calc_status") == COMPUTED).select(
        "calculation_id", "activity_id", "factor_id", formula_text().alias("formula_applied"),
        "result_tco2e", F.lit(computed_by).alias("computed_by"),
        computed_at.alias("computed_at"),
    )


def _unit_error() -> Column:
    """Why a matched activity was not calculated: units that do not convert, no quantity, or a
    result that the ledger's decimals cannot hold."""
    return (
        F.when(F.col("multiplier").isNull(),
               fill(messages.INCOMPATIBLE_UNITS, unit=F.col("unit"),
                    denominator=factor_denominator(F.col("factor_unit"))))
        .when(F.col("quantity").isNull(), F.lit(messages.NO_QUANTITY))
        .otherwise(F.lit(messages.RESULT_OVERFLOW))
    )


def unit_errors(computed: DataFrame) -> DataFrame:
    """Matched activities that were not calculated, with the reason."""
    return computed.where(F.col("calc_status") == CALCULATION_ERROR).withColumn(
        "error",
        _unit_error(),
    )


def calculation_audit(
    computed: DataFrame, index: FactorIndex, actor: str, event_ts: Column
) -> DataFrame:
    """One audit row per activity: what was calculated, or why it was not."""
    status = F.col("calc_status")
    action = (
        F.when(status == COMPUTED, F.lit("CALCULATE"))
        .when(status == PENDING_FACTOR, F.lit("CALCULATE_FAILED_MISSING_FACTOR"))
        .when(F.col("multiplier").isNull(), F.lit("CALCULATE_FAILED_INCOMPATIBLE_UNITS"))
        .otherwise(F.lit("CALCULATE_FAILED_OVERFLOW"))
    )
    done = F.struct(
        "calculation_id", F.col("factor_id").alias("emission_factor_id"), "factor_source",
        "factor_version", "fallback_level", formula_text().alias("formula_applied"),
        F.col("result_tco2e").cast("string").alias("result_tco2e"),
    )
    missing = F.struct(
        "reason", "activity_type", "geography",
        F.col("period_start").cast("string").alias("period_start"),
    )
    unfit = F.struct(
        _unit_error().alias("error"), F.col("unit").alias("activity_unit"), "factor_unit"
    )
    detail = (
        F.when(status == COMPUTED, F.to_json(done))
        .when(status == PENDING_FACTOR, F.to_json(missing))
        .otherwise(F.to_json(unfit))
    )
    return with_reasons(computed, index).select(
        F.lit("activity_data").alias("entity_type"), F.col("activity_id").alias("entity_id"),
        action.alias("action"), F.lit(actor).alias("actor"), event_ts.alias("event_ts"),
        detail.alias("detail"),
    )


def calculation_summary(computed: DataFrame, *keys: str) -> DataFrame:
    """Counts of computed, pending and failed activities per key (for instance per document)."""
    status = F.col("calc_status")
    return computed.groupBy(*keys).agg(
        F.count_if(status == COMPUTED).alias("computed_count"),
        F.count_if(status == PENDING_FACTOR).alias("pending_factor_count"),
        F.count_if(status == CALCULATION_ERROR).alias("error_count"),
    )


def latest_calculations(calcs: DataFrame) -> DataFrame:
    """The current calculation of each activity when a table holds several runs."""
    rest = [c for c in calcs.columns if c != "activity_id"]
    return (
        calcs.groupBy("activity_id")
        .agg(
            F.max_by(F.struct(*rest), F.struct("computed_at", "calculation_id")).alias("_latest")
        )
        .select("activity_id", "_latest.*")
        .select(*calcs.columns)
    )

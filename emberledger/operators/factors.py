"""Emission factors: loading, and matching by type, place and date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberledger import messages
from emberledger.functions.text import fill, strip
from emberledger.functions.units import (
    RATIO,
    convertible_pairs,
    factor_denominator,
    factor_numerator,
    normalize_unit,
    numerator_to_tonnes,
)
from emberledger.operators.bounds import fixed_table, settled

LOAD_KEY = ["source", "source_version", "activity_type", "geography"]
MULTIPLIER = "decimal(38,27)"


def new_factors(incoming: DataFrame, existing: DataFrame | None, order: Column) -> DataFrame:
    """Rows to insert so that loading the same file twice changes nothing.

    The first row of each (source, version, type, geography) in file order wins, and keys
    already in ``existing`` are left out.
    """
    columns = [c for c in incoming.columns if c not in LOAD_KEY]
    first = incoming.groupBy(*LOAD_KEY).agg(
        F.min_by(F.struct(*columns), order).alias("_first")
    )
    first = first.select(*LOAD_KEY, "_first.*").select(*incoming.columns)
    return first if existing is None else first.join(existing, LOAD_KEY, "left_anti")


def _type_key(c: Column) -> Column:
    return F.lower(strip(c))


def _geo_key(c: Column) -> Column:
    return F.upper(strip(c))


def factor_timeline(factors: DataFrame) -> DataFrame:
    """Which factor is in force for each (type, geography) at each date.

    Overlapping versions are resolved on the small factor table, newest publication first,
    into spans that do not overlap. Activities then find at most one span, so that matching
    needs neither a ranking nor a shuffle of the activities.
    """
    keyed = factors.select(
        _type_key(F.col("activity_type")).alias("f_type"),
        _geo_key(F.col("geography")).alias("f_geo"),
        "factor_id", "source", "source_version", "factor_value", "factor_unit",
        "published_date", "effective_from", "effective_to",
    )
    starts = keyed.select("f_type", "f_geo", F.col("effective_from").alias("span_from"))
    stops = keyed.where(F.col("effective_to").isNotNull()).select(
        "f_type", "f_geo", F.date_add("effective_to", 1).alias("span_from")
    )
    cuts = starts.union(stops).distinct()
    in_force = (
        cuts.alias("c")
        .join(
            keyed.alias("k"),
            (F.col("c.f_type") == F.col("k.f_type"))
            & (F.col("c.f_geo") == F.col("k.f_geo"))
            & (F.col("k.effective_from") <= F.col("c.span_from"))
            & (F.coalesce("k.effective_to", F.lit("9999-12-31").cast("date"))
               >= F.col("c.span_from")),
            "left",
        )
        .groupBy("c.f_type", "c.f_geo", "c.span_from")
        .agg(
            F.max_by(
                F.struct("factor_id", "source", "source_version", "factor_value", "factor_unit"),
                F.struct("published_date", "effective_from", "source", "source_version",
                         "factor_id"),
            ).alias("f")
        )
    )
    by_key = Window.partitionBy("f_type", "f_geo").orderBy("span_from")
    return (
        in_force.withColumn(
            "span_to",
            F.coalesce(
                F.date_sub(F.lead("span_from").over(by_key), 1),
                F.lit("9999-12-31").cast("date"),
            ),
        )
        .where(F.col("f.factor_id").isNotNull())
        .select("f_type", "f_geo", "span_from", "span_to", "f.*")
    )


def type_coverage(factors: DataFrame) -> DataFrame:
    """Spans in which a type has some active factor, wherever it applies (merged)."""
    spans = factors.select(
        _type_key(F.col("activity_type")).alias("t_type"),
        F.col("effective_from").alias("f"),
        F.coalesce("effective_to", F.lit("9999-12-30").cast("date")).alias("t"),
    ).where("f <= t")
    ordered = Window.partitionBy("t_type").orderBy("f", "t")
    reach = F.max("t").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.withColumn("opens", F.coalesce(F.col("f") > F.date_add(reach, 1), F.lit(True)))
        .withColumn("island", F.sum(F.col("opens").cast("int")).over(ordered))
        .groupBy("t_type", "island")
        .agg(F.min("f").alias("t_from"), F.max("t").alias("t_to"))
        .drop("island")
    )


def unit_conversions(spark) -> DataFrame:
    """The fixed table of convertible unit pairs (about a hundred rows)."""
    pairs = [(a, b, format(r, "f")) for a, b, r in convertible_pairs()]
    return fixed_table(spark, pairs, ["from_unit", "to_unit", "ratio_text"]).select(
        "from_unit", "to_unit", F.col("ratio_text").cast(RATIO).alias("unit_ratio")
    )


def factor_multipliers(factors: DataFrame) -> DataFrame:
    """Tonnes CO2e per unit of quantity, for every factor and every unit it can take.

    Unit ratio, factor value and numerator ratio are folded into one decimal here, on the
    dimension, which leaves one exact multiplication per activity. The ratio is taken apart
    after its ninth decimal, so that 25 decimals are right for factor values of any size.
    """
    units = factors.select(
        "factor_id", "factor_value",
        factor_denominator(F.col("factor_unit")).alias("denominator"),
        numerator_to_tonnes(factor_numerator(F.col("factor_unit"))).alias("numerator_ratio"),
    ).withColumn("to_unit", normalize_unit(F.col("denominator")))
    same = units.select(
        "*", F.col("to_unit").alias("from_unit"), F.lit("1").cast(RATIO).alias("unit_ratio")
    )
    pairs = unit_conversions(factors.sparkSession).where("from_unit <> to_unit")
    other = units.join(F.broadcast(pairs), "to_unit").select(*same.columns)
    share = F.col("numerator_ratio") * F.col("unit_ratio")
    high = F.floor(share, F.lit(9)).cast("decimal(15,9)")
    low = ((share - high).cast("decimal(32,32)") * F.lit(10 ** 9).cast("decimal(10,0)")).cast(
        "decimal(17,17)")
    value = F.col("factor_value").cast("decimal(20,8)")
    small = (value * low).cast("decimal(28,16)") * F.lit("0.000000001").cast("decimal(9,9)")
    return same.union(other).select(
        F.col("factor_id").alias("m_factor_id"), "from_unit", "denominator", "unit_ratio",
        "numerator_ratio",
        ((value * high).cast("decimal(37,25)") + small.cast("decimal(37,25)")).try_cast(
            MULTIPLIER).alias("multiplier"),
    )


@dataclass(frozen=True)
class FactorIndex:
    """A factor table prepared for matching; build once, use for any number of jobs."""

    timeline: DataFrame
    coverage: DataFrame
    multipliers: DataFrame

    @staticmethod
    def build(factors: DataFrame) -> FactorIndex:
        """The three tables, written to shared storage: their files tell the planner their bytes,
        by which it broadcasts them or shuffles, and no job derives them again."""
        return FactorIndex(
            settled(factor_timeline(factors), "factor-timeline"),
            settled(type_coverage(factors), "factor-coverage"),
            settled(factor_multipliers(factors), "factor-multipliers"),
        )


LEVELS = ("exact", "national_fallback", "global_fallback")


def placed(activities: DataFrame) -> DataFrame:
    """Add the keys of the lookups: ``_type`` and the place of each level, ``_geo0`` to ``_geo2``."""
    geo = F.col("_geo0")
    return activities.select(
        "*", _type_key(F.col("activity_type")).alias("_type"),
        _geo_key(F.col("geography")).alias("_geo0"),
    ).select(
        "*",
        F.when(F.contains(geo, F.lit("-")), strip(F.substring_index(geo, "-", 1))).alias("_geo1"),
        F.when(geo != "GLO", F.lit("GLO")).alias("_geo2"),
    )


def span_factor() -> Column:
    """The factor of a span of the timeline, under the names that matched activities get."""
    return F.struct(
        "factor_id", F.col("source").alias("factor_source"),
        F.col("source_version").alias("factor_version"), "factor_value", "factor_unit",
    )


def match_factors(activities: DataFrame, index: FactorIndex) -> DataFrame:
    """Attach the best factor: own geography, then the country of ``CC-RR``, then ``GLO``.

    Adds ``factor_id, factor_source, factor_version, factor_value, factor_unit`` (null when
    nothing fits) and ``fallback_level``. One row in, one row out.
    """
    df = placed(activities)
    for n in range(len(LEVELS)):
        span = index.timeline.select(
            F.col("f_type").alias(f"_t{n}"), F.col("f_geo").alias(f"_g{n}"),
            F.col("span_from").alias(f"_from{n}"), F.col("span_to").alias(f"_to{n}"),
            span_factor().alias(f"_f{n}"),
        )
        df = df.join(
            span,
            (F.col("_type") == F.col(f"_t{n}")) & (F.col(f"_geo{n}") == F.col(f"_g{n}"))
            & F.col("period_start").between(F.col(f"_from{n}"), F.col(f"_to{n}")),
            "left",
        )
    level = F
    for n, name in enumerate(LEVELS):
        level = level.when(F.col(f"_f{n}").isNotNull(), F.lit(name))
    return df.select(
        *activities.columns,
        F.coalesce(*[F.col(f"_f{n}") for n in range(len(LEVELS))]).alias("_factor"),
        level.otherwise(F.lit("none")).alias("fallback_level"),
    ).select(*activities.columns, "_factor.*", "fallback_level")


def with_reasons(matched: DataFrame, index: FactorIndex) -> DataFrame:
    """Add why an activity has no factor (null if it has one): none of its type was in force,
    or none for its place. ``has_active_factor`` tells the two apart."""
    reason = F.when(
        F.col("t_type").isNull(),
        fill(messages.NO_ACTIVE_FACTOR, activity_type=F.col("activity_type"),
             date=F.col("period_start")),
    ).otherwise(
        fill(messages.NO_FACTOR_FOR_PLACE, geography=F.col("geography"),
             activity_type=F.col("activity_type"))
    )
    return matched.join(
        index.coverage,
        (_type_key(F.col("activity_type")) == F.col("t_type"))
        & F.col("period_start").between(F.col("t_from"), F.col("t_to")),
        "left",
    ).select(
        *matched.columns, F.col("t_type").isNotNull().alias("has_active_factor"),
        F.when(F.col("factor_id").isNull(), reason).alias("reason"),
    )


def explain_unmatched(matched: DataFrame, index: FactorIndex) -> DataFrame:
    """Activities without a factor, with the reason."""
    return with_reasons(matched.where("factor_id is null"), index)

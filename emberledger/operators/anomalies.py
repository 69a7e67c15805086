"""Statistical checks of the ledger: yearly variance, intensity outliers, omitted scopes.

All checks cover every entity and year, against any chosen baseline years, in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberledger import messages
from emberledger.constants import (
    YOY_CRITICAL_PCT,
    YOY_DROP_PCT,
    YOY_SURGE_PCT,
    ZSCORE_CRITICAL,
    ZSCORE_CUTOFF,
)
from emberledger.functions.text import fill, fixed_text
from emberledger.operators.audit import audit_rows
from emberledger.operators.ledger import by_overlap_year

TONNES = "decimal(24,8)"
AMOUNT = "decimal(24,6)"
FLAG_COLUMNS = [
    "entity_id", "reporting_period", "flag_type", "severity", "title", "description", "status",
    "subject_id", "metric", "details_json",
]


def yearly_scopes(ledger: DataFrame) -> DataFrame:
    """Emissions, quantity and rows per entity, reporting year and scope.

    Rows without a scope count as scope 1; ``scoped_*`` leaves them out.
    """
    lines = by_overlap_year(ledger)
    named = F.col("scope").isNotNull()
    key = F.when(F.col("scope") != 0, F.col("scope")).otherwise(F.lit(1))
    return lines.groupBy("entity_id", "reporting_year", key.alias("scope")).agg(
        F.sum("result_tco2e").cast(TONNES).alias("tco2e"),
        F.sum("quantity").cast(AMOUNT).alias("quantity"),
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.when(named, F.col("result_tco2e"))), F.lit(0)).cast(TONNES)
        .alias("scoped_tco2e"),
        F.count_if(named).alias("scoped_rows"),
    )


_MEASURES = {
    "tco2e": TONNES, "quantity": AMOUNT, "n_rows": "bigint", "scoped_tco2e": TONNES,
    "scoped_rows": "bigint",
}


def year_over_year(yearly: DataFrame, comparisons: DataFrame | None = None) -> DataFrame:
    """The compared (entity, year, baseline year, scope) with the measures of both years.

    ``comparisons`` has (entity_id, reporting_year, baseline_year); without a baseline year the
    measures of the baseline are zero. Left out, every year is compared with the one before.
    Each yearly row plays a part in its own year and in each year that it is the baseline of,
    and one aggregation brings the parts together. ``current_rows`` and ``baseline_rows`` count
    the rows of all scopes.
    """
    if comparisons is None:
        year = F.col("reporting_year")
        played = yearly.select("entity_id", "scope", *_MEASURES, F.inline(F.array(
            F.struct(year.alias("reporting_year"), (year - 1).alias("baseline_year"),
                     F.lit(True).alias("is_current")),
            F.struct((year + 1).alias("reporting_year"), year.alias("baseline_year"),
                     F.lit(False).alias("is_current")))))
    else:
        asked = comparisons.select(
            "entity_id", F.col("reporting_year").cast("int").alias("reporting_year"),
            F.col("baseline_year").cast("int").alias("baseline_year")).distinct()
        roles = asked.select("*", F.inline(F.array(
            F.struct(F.col("reporting_year").alias("_year"), F.lit(True).alias("is_current")),
            F.struct(F.col("baseline_year").alias("_year"), F.lit(False).alias("is_current")))))
        played = yearly.withColumnRenamed("reporting_year", "_year").join(
            roles, ["entity_id", "_year"])

    def part(measure: str, dtype: str, current: bool) -> Column:
        mine = F.col("is_current") if current else ~F.col("is_current")
        return F.coalesce(F.sum(F.when(mine, F.col(measure))), F.lit(0)).cast(dtype).alias(
            ("current_" if current else "prior_") + measure
        )

    compared = played.groupBy("entity_id", "reporting_year", "baseline_year", "scope").agg(
        *[part(m, d, c) for m, d in _MEASURES.items() for c in (True, False)])
    whole = Window.partitionBy("entity_id", "reporting_year", "baseline_year")
    return compared.withColumn("current_rows", F.sum("current_n_rows").over(whole)).withColumn(
        "baseline_rows", F.sum("prior_n_rows").over(whole)
    )


def _change_pct(current: str, prior: str, dtype: str) -> Column:
    difference = (F.col(current) - F.col(prior)).cast(dtype)
    return (difference / F.when(F.col(prior) != 0, F.col(prior)) * 100).cast("decimal(28,10)")


def _details(*fields: Column | str) -> Column:
    return F.to_json(F.struct(*fields))


def _flag(flag_type: Column, severity: Column, title: Column, description: Column,
          subject: Column, metric: Column, details: Column) -> Column:
    return F.struct(
        flag_type.alias("flag_type"), severity.alias("severity"), title.alias("title"),
        description.alias("description"), F.lit("OPEN").alias("status"),
        subject.alias("subject_id"), metric.cast("double").alias("metric"),
        details.alias("details_json"),
    )


def _variance_flag(drop_pct: str, surge_pct: str) -> Column:
    """Sharp drop or surge that activity explains by less than half; null otherwise."""
    pct, act = F.col("pct_change"), F.col("activity_pct_change")

    def threshold(text: str) -> Column:
        return F.lit(text).cast("decimal(12,4)")

    drop = (pct <= -threshold(drop_pct)) & (act * 2 > pct)
    surge = ~(pct <= -threshold(drop_pct)) & (pct >= threshold(surge_pct)) & (act * 2 < pct)
    size = F.abs(pct)
    scope = F.col("scope").cast("string")
    words = {
        "size": fixed_text(size, 1), "scope": scope, "activity": fixed_text(act, 1),
        "prior": fixed_text(F.col("prior_tco2e"), 2),
        "current": fixed_text(F.col("current_tco2e"), 2),
    }
    comparable = (
        (F.col("prior_tco2e") > 0) & (F.col("current_rows") > 0) & (F.col("baseline_rows") > 0)
    )
    flag = _flag(
        F.when(drop, F.lit("YOY_DROP")).otherwise(F.lit("YOY_SPIKE")),
        F.when(drop & (pct <= -threshold(YOY_CRITICAL_PCT)), F.lit("CRITICAL"))
        .otherwise(F.lit("WARNING")),
        F.when(drop, fill(messages.DROP_TITLE, **words)).otherwise(
            fill(messages.SURGE_TITLE, **words)
        ),
        F.when(drop, fill(messages.DROP_TEXT, **words)).otherwise(
            fill(messages.SURGE_TEXT, **words)
        ),
        F.concat(F.lit("scope-"), scope), pct,
        _details(
            "scope", F.col("prior_tco2e").cast("string").alias("prior_tco2e"),
            F.col("current_tco2e").cast("string").alias("current_tco2e"),
            pct.cast("double").alias("pct_change"),
            act.cast("double").alias("activity_pct_change"),
            F.col("baseline_year").cast("string").alias("baseline_period"),
        ),
    )
    return F.when(comparable & (drop | surge), flag)


def _omission_flag() -> Column:
    """Scope with rows in the baseline and none in a year that has rows; null otherwise."""
    scope, year = F.col("scope").cast("string"), F.col("reporting_year")
    omitted = (
        F.col("scope").isin(1, 2, 3) & (F.col("prior_scoped_rows") > 0)
        & (F.col("current_scoped_rows") == 0) & (F.col("current_rows") > 0)
    )
    flag = _flag(
        F.lit("SCOPE_INCOMPLETENESS"), F.lit("CRITICAL"),
        fill(messages.OMISSION_TITLE, scope=scope),
        fill(messages.OMISSION_TEXT, scope=scope, baseline=F.col("baseline_year"), year=year,
             prior=fixed_text(F.col("prior_scoped_tco2e"), 2)),
        F.concat(F.lit("scope-"), scope), F.col("prior_scoped_tco2e"),
        _details(
            F.col("scope").alias("missing_scope"),
            F.col("prior_scoped_tco2e").cast("string").alias("prior_tco2e"),
            F.lit("0.0").alias("current_tco2e"),
            F.col("baseline_year").cast("string").alias("baseline_period"),
        ),
    )
    return F.when(omitted, flag)


def yoy_changes(compared: DataFrame) -> DataFrame:
    """Percentage change of emissions and of activity per scope."""
    return compared.withColumn(
        "pct_change", _change_pct("current_tco2e", "prior_tco2e", TONNES)
    ).withColumn(
        "activity_pct_change",
        F.coalesce(
            F.when(F.col("prior_quantity") > 0,
                   _change_pct("current_quantity", "prior_quantity", AMOUNT)),
            F.lit(0).cast("decimal(28,10)"),
        ),
    )


def _flag_rows(df: DataFrame, *flags: Column) -> DataFrame:
    return df.select(
        "entity_id", F.col("reporting_year").cast("string").alias("reporting_period"),
        F.inline(F.array_compact(F.array(*flags))),
    )


def yoy_flags(
    yearly: DataFrame, drop_pct: str = YOY_DROP_PCT, surge_pct: str = YOY_SURGE_PCT,
    comparisons: DataFrame | None = None,
) -> DataFrame:
    """Sharp drops and surges that activity does not explain (less than half of the change)."""
    return _flag_rows(
        yoy_changes(year_over_year(yearly, comparisons)), _variance_flag(drop_pct, surge_pct)
    )


def omission_flags(yearly: DataFrame, comparisons: DataFrame | None = None) -> DataFrame:
    """Scopes reported in the baseline and absent from a year that has rows."""
    return _flag_rows(year_over_year(yearly, comparisons), _omission_flag())


COHORT = ["entity_id", "reporting_year", "activity_type", "unit"]


def _with_intensity(ledger: DataFrame) -> DataFrame:
    return by_overlap_year(ledger).withColumn(
        "intensity",
        F.when(
            F.col("quantity") > 0,
            F.col("result_tco2e").cast("double") / F.col("quantity").cast("double"),
        ),
    )


def cohort_moments(ledger: DataFrame, *keys: str) -> DataFrame:
    """Count of rows, and count, mean and sum of squared deviations of the intensities, of each
    cohort; with ``keys`` in parts, which ``merged_cohorts`` puts together."""
    return _with_intensity(ledger).groupBy(*COHORT, *keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("intensity").alias("n"),
        F.coalesce(F.avg("intensity"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop("intensity") * F.count("intensity"), F.lit(0.0)).alias("m2"))


def merged_cohorts(parts: DataFrame) -> DataFrame:
    """Statistics of whole cohorts. Parts are merged two by two, which loses no digits to
    cancellation; a cohort has a part for each stored partition that it lies in."""
    def merge(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        apart = b["mean"] - a["mean"]
        share = F.when(n > 0, b["n"] / n).otherwise(F.lit(0.0))
        return F.struct(
            n.alias("n"), (a["mean"] + apart * share).alias("mean"),
            (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"))

    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"),
                     F.lit(0.0).alias("m2"))
    one = F.aggregate(F.array_sort(F.collect_list(F.struct("n", "mean", "m2"))), start, merge)
    whole = parts.groupBy(*COHORT).agg(F.sum("n_rows").alias("_rows"), one.alias("_all"))
    return whole.select(
        *COHORT, "_rows", F.col("_all.n").alias("cohort_size"),
        F.when(F.col("_all.n") > 0, F.col("_all.mean")).alias("cohort_mean"),
        F.when(F.col("_all.n") > 1, F.sqrt(F.col("_all.m2") / (F.col("_all.n") - 1)))
        .alias("cohort_stdev"))


def intensity_scores(
    ledger: DataFrame, zscore_cutoff: float = ZSCORE_CUTOFF, rel_stdev_floor: float = 0.0,
    cohorts: DataFrame | None = None,
) -> DataFrame:
    """Lines whose tCO2e per unit lies ``zscore_cutoff`` deviations or more from their cohort.

    Cohort statistics are aggregated first and joined back, so that a cohort of any size is
    never gathered in one task. ``rel_stdev_floor`` skips cohorts whose deviation is mere
    rounding noise relative to the mean (0 keeps every positive deviation). With the ``cohorts``
    of a kept table (see ``moment_store``) the lines are read once, else twice.
    """
    lines = _with_intensity(ledger)
    period = Window.partitionBy("entity_id", "reporting_year")
    if cohorts is None:
        cohorts = lines.groupBy(*COHORT).agg(
            F.count(F.lit(1)).alias("_rows"),
            F.count("intensity").alias("cohort_size"),
            F.avg("intensity").alias("cohort_mean"),
            F.stddev_samp("intensity").alias("cohort_stdev"),
        )
    cohorts = cohorts.withColumn("_period_rows", F.sum("_rows").over(period))
    floor = F.abs("cohort_mean") * F.lit(float(rel_stdev_floor))
    # The largest score that a cohort of n can hold is (n - 1) / sqrt(n): smaller ones need no
    # join back. The tolerance is for the rounding of the scores.
    reachable = (F.col("cohort_size") - 1) / F.sqrt("cohort_size") >= zscore_cutoff * (1 - 1e-9)
    usable = cohorts.where(
        "cohort_size >= 3 and cohort_stdev > 0 and _period_rows >= 3"
    ).where(reachable).where(F.col("cohort_stdev") > floor).drop("_rows", "_period_rows")
    return lines.where("intensity is not null").join(usable, COHORT).withColumn(
        "z_score", F.abs(F.col("intensity") - F.col("cohort_mean")) / F.col("cohort_stdev")
    ).where(F.col("z_score") >= zscore_cutoff)


def intensity_flags(
    ledger: DataFrame, zscore_cutoff: float = ZSCORE_CUTOFF, rel_stdev_floor: float = 0.0,
    cohorts: DataFrame | None = None,
) -> DataFrame:
    scored = intensity_scores(ledger, zscore_cutoff, rel_stdev_floor, cohorts)
    z = fixed_text(F.col("z_score"), 2)
    words = {
        "activity_type": F.col("activity_type"), "unit": F.col("unit"), "z": z,
        "intensity": fixed_text(F.col("intensity"), 6),
        # Rounded first, so that the text does not hang on the last bit of a float sum.
        "mean": fixed_text(F.round("cohort_mean", 12), 6),
    }
    return _flag_rows(
        scored,
        _flag(
            F.lit("INTENSITY_OUTLIER"),
            F.when(F.col("z_score") >= ZSCORE_CRITICAL, F.lit("CRITICAL"))
            .otherwise(F.lit("WARNING")),
            fill(messages.OUTLIER_TITLE, **words), fill(messages.OUTLIER_TEXT, **words),
            F.col("calculation_id"), F.col("z_score"),
            _details("calculation_id", "activity_id", "activity_type", "unit", "intensity",
                     "cohort_mean", "cohort_stdev", "z_score"),
        ),
    )


def anomaly_scan(
    ledger: DataFrame,
    yoy_threshold_pct: str = YOY_DROP_PCT,
    zscore_cutoff: float = ZSCORE_CUTOFF,
    rel_stdev_floor: float = 0.0,
    comparisons: DataFrame | None = None,
) -> DataFrame:
    """All flags of all entities and years: intensity, omission and yearly variance. With
    ``comparisons`` (see ``year_over_year``) only the years that they name are scanned."""
    yearly = yearly_scopes(ledger)
    outliers = intensity_flags(ledger, zscore_cutoff, rel_stdev_floor)
    if comparisons is not None:
        outliers = outliers.join(comparisons.select("entity_id", F.col("reporting_year").cast(
            "string").alias("reporting_period")).distinct(), ["entity_id", "reporting_period"])
    by_year = _flag_rows(
        yoy_changes(year_over_year(yearly, comparisons)),
        _omission_flag(), _variance_flag(yoy_threshold_pct, YOY_SURGE_PCT),
    )
    return outliers.select(*by_year.columns).unionByName(by_year).select(
        flag_id(), *FLAG_COLUMNS)


def flag_id() -> Column:
    """Identity of a flag: what it is about, so that a rescan yields the same ids."""
    return F.md5(
        F.concat_ws("|", "entity_id", "reporting_period", "flag_type", "subject_id")
    ).alias("flag_id")


def scan_audit(flags: DataFrame, scanned: DataFrame, event_ts: Column) -> DataFrame:
    """One audit row per scanned (entity_id, reporting_period, baseline_period) with its number
    of flags; a scan without ``baseline_period`` had none."""
    baseline = (F.col("baseline_period") if "baseline_period" in scanned.columns
                else F.lit(None).cast("string"))
    scanned = scanned.select("entity_id", "reporting_period", baseline.alias("baseline_period"))
    counts = flags.groupBy("entity_id", "reporting_period").agg(
        F.count(F.lit(1)).alias("_flags")
    )
    done = scanned.distinct().join(
        counts, ["entity_id", "reporting_period"], "left"
    )
    return audit_rows(
        done, "anomaly_scan", F.col("entity_id"), "ANOMALY_SCAN",
        F.lit("system:anomaly_detector"), event_ts,
        [F.col("reporting_period").alias("current_period"), "baseline_period",
         F.coalesce("_flags", F.lit(0)).alias("flags_generated")],
    )


def resolve_flags(flags: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply the latest valid decision to each flag.

    A decision is valid when it confirms or dismisses and explains itself in five characters
    or more. Columns of ``decisions``: flag_id, new_status, notes, actor, decided_at.
    """
    valid = F.col("new_status").isin("CONFIRMED", "DISMISSED") & (F.length("notes") >= 5)
    latest = (
        decisions.where(valid)
        .groupBy("flag_id")
        .agg(
            F.max_by(
                F.struct("new_status", "notes", "actor", "decided_at"),
                F.struct("decided_at", "actor", "notes"),
            ).alias("_d")
        )
    )
    kept = [
        c for c in flags.columns
        if c not in ("status", "resolution_notes", "resolved_by", "resolved_at")
    ]
    return flags.join(latest, "flag_id", "left").select(
        *kept,
        F.coalesce("_d.new_status", "status").alias("status"),
        F.col("_d.notes").alias("resolution_notes"),
        F.col("_d.actor").alias("resolved_by"),
        F.col("_d.decided_at").alias("resolved_at"),
    )


def resolution_audit(resolved: DataFrame) -> DataFrame:
    return audit_rows(
        resolved.where("resolved_by is not null"), "anomaly_flag", F.col("flag_id"),
        "RESOLVE_ANOMALY", F.col("resolved_by"), F.col("resolved_at"),
        ["status", F.col("resolution_notes").alias("notes")],
    )

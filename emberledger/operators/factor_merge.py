"""Factor matching for factor tables that no executor can hold, and what a new one changes.

``match_by_merge`` sorts activities and the starts of factor spans together and takes, for each
activity, the last start before it. No factor is broadcast; keys that many activities share are
dealt to several groups, each with its own copy of the key's spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberledger.operators.bounds import settled
from emberledger.operators.emissions import compute
from emberledger.operators.factors import LEVELS, FactorIndex, placed, span_factor
from emberledger.sources.snapshots import Snapshot

#: Activities of one type and place that are sorted together, about. A key with more is dealt.
HOT_ROWS = 1_000_000
_END = "9999-12-31"


def match_by_merge(
    activities: DataFrame, index: FactorIndex, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``match_factors`` by sorting: the same columns and rows.

    ``activities`` is read twice, first to count its types and places, and is sorted once for each
    of the three levels; store it before. ``activity_id`` deals the activities of a hot key. Each
    hot key stands for more than ``hot_rows`` activities, which bounds their list, the only thing
    that is broadcast.
    """
    df = placed(activities)
    counts = settled(df.groupBy("_type", *[f"_geo{n}" for n in range(len(LEVELS))]).count(),
                     "factor-keys")
    spans = index.timeline.select(
        F.col("f_type").alias("_kt"), F.col("f_geo").alias("_kg"), F.col("span_from").alias("_at"),
        F.struct("span_to", span_factor().alias("factor")).alias("_span"), F.lit(0).alias("_side"))
    empty = spans.schema["_span"].dataType["factor"].dataType
    df = df.withColumns({"_factor": F.lit(None).cast(empty), "_level": F.lit(None).cast("string")})
    for n, level in enumerate(LEVELS):
        hot = counts.groupBy(F.col("_type").alias("_ht"), F.col(f"_geo{n}").alias("_hg")).agg(
            F.ceil(F.sum("count") / hot_rows).cast("int").alias("_copies")).where(
            "_hg is not null and _copies > 1")
        df = _merge(df, spans, F.broadcast(hot), f"_geo{n}", level)
    return df.select(*activities.columns, "_factor.*",
                     F.coalesce("_level", F.lit("none")).alias("fallback_level"))


def _merge(df: DataFrame, spans: DataFrame, hot: DataFrame, geo: str, level: str) -> DataFrame:
    """Fills ``_factor`` and ``_level`` of the activities that a factor of the level fits."""
    # Activities that are done, or have no such place, are spread: nothing is looked up for them.
    # So are those of hot keys, over the copies of their spans.
    spread, asks = F.xxhash64("activity_id", "period_start"), F.col("_factor").isNull()
    rows = df.join(hot, (F.col("_type") == F.col("_ht")) & (F.col(geo) == F.col("_hg")), "left")
    looked_up = asks & F.col(geo).isNotNull() & F.col("_type").isNotNull()
    rows = rows.select(
        *df.columns, F.when(looked_up, F.col("_type")).alias("_kt"),
        F.when(looked_up, F.col(geo)).alias("_kg"),
        F.when(~looked_up, spread).when(F.col("_copies").isNotNull(), F.pmod(spread, "_copies"))
        .otherwise(F.lit(0).cast("bigint")).alias("_salt"),
        F.col("period_start").alias("_at"), F.lit(1).alias("_side"))
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_copies", F.lit(1)).cast("bigint") - 1)
    marks = spans.join(hot, (F.col("_kt") == F.col("_ht")) & (F.col("_kg") == F.col("_hg")), "left")
    marks = marks.select(*spans.columns, F.explode(copies).alias("_salt"))
    merged = rows.unionByName(marks, allowMissingColumns=True)
    before = Window.partitionBy("_kt", "_kg", "_salt").orderBy("_at", "_side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    last = F.last("_span", ignorenulls=True).over(before)
    found = merged.withColumn("_last", last).where("_side = 1").withColumn(
        "_fits", (F.col("_at") <= F.col("_last.span_to")) & F.col("_kt").isNotNull())
    return found.withColumns({
        "_factor": F.when(F.col("_fits"), F.col("_last.factor")).otherwise(F.col("_factor")),
        "_level": F.when(F.col("_fits"), F.lit(level)).otherwise(F.col("_level")),
    }).select(*df.columns)


def changed_spans(old: FactorIndex, new: FactorIndex) -> DataFrame:
    """(f_type, f_geo, changed_from, changed_to): when another factor is in force than before, or
    one with another value or unit, or none. Spans of a key do not overlap."""
    def events(index: FactorIndex, side: str) -> DataFrame:
        starts = index.timeline.select("f_type", "f_geo", F.col("span_from").alias("at"),
                                       F.lit(True).alias("opens"), span_factor().alias("factor"))
        stops = index.timeline.where(F.col("span_to") < F.lit(_END).cast("date")).select(
            "f_type", "f_geo", F.date_add("span_to", 1).alias("at"), F.lit(False).alias("opens"),
            F.lit(None).cast(starts.schema["factor"].dataType).alias("factor"))
        # Where one span follows another at once, the start counts.
        return starts.union(stops).groupBy("f_type", "f_geo", "at").agg(
            F.max_by(F.struct("opens", "factor"), "opens").alias(side))

    ordered = Window.partitionBy("f_type", "f_geo").orderBy("at")
    both = events(old, "old").join(events(new, "new"), ["f_type", "f_geo", "at"], "full")
    return both.select(
        "f_type", "f_geo", F.col("at").alias("changed_from"),
        F.coalesce(F.date_sub(F.lead("at").over(ordered), 1), F.lit(_END).cast("date"))
        .alias("changed_to"),
        *[F.last(side, ignorenulls=True).over(ordered)["factor"].alias(side)
          for side in ("old", "new")],
    ).where(~F.col("old").eqNullSafe(F.col("new"))).drop("old", "new")


def affected(activities: DataFrame, changes: DataFrame) -> DataFrame:
    """Activities for which one of the three levels has changed at their date, once each."""
    df = placed(activities)
    for n in range(len(LEVELS)):
        span = changes.select(*[F.col(c).alias(f"_{c}{n}") for c in changes.columns])
        df = df.join(
            span, (F.col("_type") == F.col(f"_f_type{n}")) & (F.col(f"_geo{n}") == F.col(
                f"_f_geo{n}")) & F.col("period_start").between(
                F.col(f"_changed_from{n}"), F.col(f"_changed_to{n}")), "left")
    hit = F.coalesce(*[F.col(f"_f_type{n}") for n in range(len(LEVELS))]).isNotNull()
    return df.where(hit).select(*activities.columns)


def recalculated(stored: Snapshot, old: FactorIndex, new: FactorIndex) -> DataFrame:
    """``compute`` with the new factors, for those stored activities that they touch.

    The table is one of activities in folders by the year of their start (``ledger_store``); the
    folders of years without a change are not read. What is left out keeps its calculation.
    """
    changes = settled(changed_spans(old, new), "factor-changes")
    # As many rows as pairs of years, however many factors have changed.
    years = changes.select(F.year("changed_from").alias("a"), F.year("changed_to").alias("b"))
    reach = [(r.a, r.b) for r in years.distinct().collect()]
    rows = stored.rows(lambda p: p[0].isdigit() and any(a <= int(p[0]) <= b for a, b in reach))
    return compute(affected(rows, changes), new)

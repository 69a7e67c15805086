"""Totals over a stream of calculations in which recalculations take the earlier ones back.

The current calculation of each activity is kept in files beside the checkpoint. A newer one comes
out as two signed rows: what it takes back from the totals that the earlier one stood in, and what
it adds to its own. Replays and late arrivals of older runs change nothing. The differences of a
micro-batch are summed by group before they are kept, so what is stored of them grows with batches
and groups.

Each micro-batch writes the activities that it changed, and looks its own up in what earlier ones
wrote, with joins: no row of it passes through Python. Every ``FOLD`` batches all of that is folded
into one row for each activity, so it grows with activities, not with runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberledger.operators.emissions import COMPUTED
from emberledger.operators.inventory import TOTAL, scope_or_three
from emberledger.session import checkpoint_root
from emberledger.streaming.ingest import upsert_available

#: Batches whose changes are kept apart before they are folded into one row for each activity.
FOLD = 16

_PLACE = ["entity_id", "reporting_year", "scope"]
_ORDER = ["computed_at", "calculation_id"]
_VALUE = "struct<entity_id string, reporting_year int, scope int, result_tco2e decimal(20,8)>"
_RUN = f"struct<computed_at timestamp, calculation_id string, value {_VALUE}>"
_KEPT = f"activity_id string, run {_RUN}, back {_VALUE}"


def runs(calculations: DataFrame) -> DataFrame:
    """(activity_id, run) of calculations with activity_id, calculation_id, computed_at, entity_id,
    period_start, scope and result_tco2e. Rows without a result, such as those with another
    ``calc_status``, or without an activity, time or id are left out."""
    rows = calculations.where(F.col("calc_status") == COMPUTED) \
        if "calc_status" in calculations.columns else calculations
    rows = rows.select(
        "activity_id", *_ORDER, "entity_id", F.year("period_start").alias("reporting_year"),
        scope_or_three(F.col("scope")).cast("int").alias("scope"),
        F.col("result_tco2e").cast("decimal(20,8)").alias("result_tco2e"),
    ).dropna(subset=["activity_id", *_ORDER, "reporting_year", "result_tco2e"])
    value = F.struct(*_PLACE, "result_tco2e").alias("value")
    return rows.select("activity_id", F.struct(*_ORDER, value).cast(_RUN).alias("run"))


def _newest(rows: DataFrame) -> DataFrame:
    """The latest run of each activity by time, then by id."""
    return rows.groupBy("activity_id").agg(F.max("run").alias("run"))


def changes(arrived: DataFrame, held: DataFrame | None) -> DataFrame:
    """(activity_id, run, back): the activities of which a newer run has arrived than those held,
    with that run and the value that it takes back (null for the first of an activity)."""
    newest = _newest(arrived)
    if held is None:
        return newest.select("*", F.lit(None).cast(_VALUE).alias("back"))
    known = _newest(held.select("activity_id", "run").join(
        newest.select("activity_id"), "activity_id", "left_semi"))
    joined = newest.join(known.withColumnRenamed("run", "known"), "activity_id", "left")

    def order(run: str):
        return F.struct(*[F.col(f"{run}.{c}") for c in _ORDER])

    return joined.where(F.col("known").isNull() | (order("run") > order("known"))).select(
        "activity_id", "run", F.col("known.value").alias("back"))


def differences(changed: DataFrame) -> DataFrame:
    """(entity_id, reporting_year, scope, difference_tco2e, difference_count): by how much
    ``changes`` move the totals of each group."""
    def signed(value: str, sign: int):
        return F.struct(
            *[F.col(f"{value}.{c}").alias(c) for c in _PLACE],
            (F.col(f"{value}.result_tco2e") * sign).cast(TOTAL).alias("difference_tco2e"),
            F.lit(sign).alias("difference_count"))

    back = F.when(F.col("back").isNotNull(), signed("back", -1))
    return changed.select(F.inline(F.array_compact(F.array(signed("run.value", 1), back)))).groupBy(
        *_PLACE).agg(
        F.sum("difference_tco2e").cast(TOTAL).alias("difference_tco2e"),
        F.sum("difference_count").alias("difference_count"))


class _Kept:
    """The runs held by a stream: ``changed/batch=n`` has what batch n changed, ``folded/batch=n``
    one row for each activity as batch n left it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self, kind: str) -> list[int]:
        found = self._files().globStatus(self._at(f"{kind}/batch=*")) or ()
        return sorted(int(s.getPath().getName().partition("=")[2]) for s in found)

    def read(self, *folders: str) -> DataFrame:
        return self.spark.read.schema(_KEPT).parquet(*[f"{self.path}/{f}" for f in folders])

    def before(self, batch_id: int) -> tuple[list[str], int]:
        """The folders of the runs held before a batch, and how many batches are not folded."""
        base = max((n for n in self._batches("folded") if n < batch_id), default=None)
        since = [n for n in self._batches("changed")
                 if n < batch_id and (base is None or n > base)]
        folded = [] if base is None else [f"folded/batch={base}"]
        return folded + [f"changed/batch={n}" for n in since], len(since)

    def fold(self, batch_id: int, folders: list[str]) -> None:
        """One row for each activity after a batch. What the batch began with stays, as it may be
        handed over again; what was folded before that goes."""
        _newest(self.read(*folders, f"changed/batch={batch_id}")).select(
            "*", F.lit(None).cast(_VALUE).alias("back")).write.mode("overwrite").parquet(
            f"{self.path}/folded/batch={batch_id}")
        base = max((n for n in self._batches("folded") if n < batch_id), default=-1)
        gone = [f"folded/batch={n}" for n in self._batches("folded") if n < base] + [
            f"changed/batch={n}" for n in self._batches("changed") if n <= base]
        for folder in gone:
            self._files().delete(self._at(folder), True)


def keep_differences(calculations: DataFrame, path: str, name: str) -> StreamingQuery:
    """Everything that has arrived, as differences by group under ``path``; then stops. A batch
    that is handed over again after a failure overwrites its own folders."""
    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        kept = _Kept(spark, f"{checkpoint_root(spark)}/{name}-current")
        folders, unfolded = kept.before(batch_id)
        own = f"changed/batch={batch_id}"
        changes(rows, kept.read(*folders) if folders else None).write.mode("overwrite").parquet(
            f"{kept.path}/{own}")
        differences(kept.read(own)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if unfolded + 1 >= FOLD:
            kept.fold(batch_id, folders)

    return upsert_available(runs(calculations), name, write, "append")


def net_scope_totals(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, reporting_year, scope, total_tco2e, activity_count): the totals of the latest
    calculation of each activity, from the differences of all batches. Groups that have lost all
    of their activities are left out."""
    kept = spark.read.parquet(path)
    return kept.groupBy(*_PLACE).agg(
        F.sum("difference_tco2e").cast(TOTAL).alias("total_tco2e"),
        F.sum("difference_count").alias("activity_count")).where("activity_count > 0")

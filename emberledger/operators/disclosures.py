"""Disclosures: the scope-category hierarchy, its line items and citations.

The calculation ids of a disclosure are kept as rows (``disclosure_line``), never as one
array per disclosure: a single entity-year may hold a third of the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberledger.constants import FRAMEWORK_TITLES
from emberledger.operators.audit import audit_rows
from emberledger.operators.inventory import SCOPES, TOTAL, scope_or_three
from emberledger.operators.ledger import answer_requests

REQUEST = ["entity_id", "framework", "reporting_period"]


def disclosure_category(category: Column) -> Column:
    return F.coalesce(F.when(category != "", category), F.lit("Uncategorized"))


def disclosure_id() -> Column:
    return F.md5(F.concat_ws("|", *REQUEST)).alias("disclosure_id")


def labelled(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("scope", scope_or_three(F.col("scope"))).withColumn(
        "ghg_category", disclosure_category(F.col("ghg_category"))
    ).withColumn("reporting_year", F.year("period_start"))


def rollup(ledger: DataFrame) -> DataFrame:
    """Totals and item counts per entity-year at three levels: all, scope, scope and category.

    The rollup runs over the aggregate by category, so the ledger itself is expanded by none
    of the grouping sets. ``level``: 0 entity-year, 1 scope, 2 category.
    """
    base = (
        labelled(ledger)
        .groupBy("entity_id", "reporting_year", "scope", "ghg_category")
        .agg(F.sum("result_tco2e").cast(TOTAL).alias("t"), F.count(F.lit(1)).alias("n"))
    )
    keys = ["entity_id", "reporting_year", "scope", "ghg_category"]
    sets = [keys[:2], keys[:3], keys]
    rolled = base.groupingSets(
        [[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]
    ).agg(
        F.sum("t").cast(TOTAL).alias("total_tco2e"),
        F.sum("n").alias("line_item_count"),
        (F.lit(2) - F.grouping("scope") - F.grouping("ghg_category")).cast("int").alias("level"),
    )
    whole = F.max(F.when(F.col("level") == 0, F.col("total_tco2e"))).over(
        Window.partitionBy("entity_id", "reporting_year")
    )
    ratio = F.col("total_tco2e").cast("decimal(26,8)") / F.when(whole > 0, whole).cast(
        "decimal(26,8)"
    )
    return rolled.withColumn(
        "proportion_pct", F.coalesce(F.bround(ratio * 100, 1), F.lit(0)).cast("decimal(6,1)")
    )


def citations(ledger: DataFrame, cited: int = 3) -> DataFrame:
    """Citation text per category: the first ids, shortened, and how many more there are.

    The ranking keeps ``cited`` rows per group on every task before the shuffle, so the size
    of a group does not matter.
    """
    keys = ["entity_id", "reporting_year", "scope", "ghg_category"]
    lines = labelled(ledger).select(*keys, "calculation_id")
    by_id = Window.partitionBy(*keys).orderBy("calculation_id")
    firsts = (
        lines.withColumn("_rn", F.row_number().over(by_id))
        .where(F.col("_rn") <= cited)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("calculation_id")).alias("_ids"))
    )
    counts = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("line_item_count"))
    shortened = F.array_join(
        F.transform("_ids", lambda i: F.concat(F.substring(i, 1, 8), F.lit("..."))), ", "
    )
    more = F.col("line_item_count") - cited
    # Null-safe, as a plain join would have Catalyst test the keys for null, and for that
    # compute them a second time wherever they are expressions.
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return counts.alias("c").join(firsts.alias("f"), same).select(
        *[F.col(f"c.{k}") for k in keys], "line_item_count",
        F.concat(
            shortened,
            F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)")))
            .otherwise(F.lit("")),
        ).alias("citation_text"),
    )


def requested_lines(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """The line items of each requested disclosure, one row per calculation.

    A period selects the start year of the activities; a quarter selects its whole year. A
    request that matches nothing falls back to all rows of the entity.
    """
    rows = answer_requests(labelled(ledger), requests.select(*REQUEST), "start_year", True)
    return rows.select(disclosure_id(), *REQUEST, "scope", "ghg_category", "calculation_id",
                       "result_tco2e")


def disclosure_rows(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """The disclosure table: one row per accepted request with its totals."""
    def scope_sum(s: int) -> Column:
        return F.coalesce(
            F.sum(F.when(F.col("scope") == s, F.col("result_tco2e"))), F.lit(0)
        ).cast(TOTAL)

    totals = lines.groupBy("disclosure_id").agg(
        F.sum("result_tco2e").cast(TOTAL).alias("total_tco2e"),
        *[scope_sum(s).alias(f"scope_{s}_tco2e") for s in SCOPES],
        F.count(F.lit(1)).alias("line_item_count"),
    )
    title = F
    for framework, text in FRAMEWORK_TITLES.items():
        title = title.when(F.col("framework") == framework, F.lit(text))
    zero = F.lit(0).cast(TOTAL)
    return (
        requests.select(*REQUEST).distinct().withColumn("disclosure_id", disclosure_id())
        .join(totals, "disclosure_id", "left")
        .select(
            "disclosure_id", *REQUEST, F.lit("draft").alias("status"),
            F.concat(
                F.lit("disclosures/"), "entity_id", F.lit("/"), "framework", F.lit("_"),
                "reporting_period", F.lit(".pdf"),
            ).alias("generated_document_ref"),
            title.alias("framework_title"),
            F.coalesce("total_tco2e", zero).alias("total_tco2e"),
            *[F.coalesce(f"scope_{s}_tco2e", zero).alias(f"scope_{s}_tco2e") for s in SCOPES],
            F.coalesce("line_item_count", F.lit(0)).alias("line_item_count"),
        )
    )


def disclosure_audit(disclosures: DataFrame, event_ts: Column) -> DataFrame:
    return audit_rows(
        disclosures, "disclosure", F.col("disclosure_id"), "GENERATE_DISCLOSURE",
        F.lit("disclosure_service"), event_ts,
        ["framework", "reporting_period",
         *[F.col(c).cast("string").alias(c) for c in
           ("total_tco2e", "scope_1_tco2e", "scope_2_tco2e", "scope_3_tco2e")],
         "line_item_count", "generated_document_ref"],
    )


def explode_refs(disclosures: DataFrame) -> DataFrame:
    """``disclosure_line`` rows of disclosures that carry their ids as an array."""
    return disclosures.select(
        "disclosure_id", F.explode(F.array_distinct("line_item_refs")).alias("calculation_id")
    )


def totals_from_lines(lines: DataFrame, calculations: DataFrame) -> DataFrame:
    """Totals per disclosure recomputed from its line items (calculations carry scope)."""
    joined = lines.select("disclosure_id", "calculation_id").join(
        calculations.select("calculation_id", scope_or_three(F.col("scope")).alias("scope"),
                            "result_tco2e"),
        "calculation_id",
    )
    return joined.groupBy("disclosure_id").agg(
        F.sum("result_tco2e").cast(TOTAL).alias("total_tco2e"),
        *[
            F.coalesce(
                F.sum(F.when(F.col("scope") == s, F.col("result_tco2e"))), F.lit(0)
            ).cast(TOTAL).alias(f"scope_{s}_tco2e")
            for s in SCOPES
        ],
        F.count(F.lit(1)).alias("line_item_count"),
    )

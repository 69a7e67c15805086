"""Scope classification by ordered keyword rules, review overrides and their audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberledger import messages
from emberledger.constants import (
    CONFIDENCE_THRESHOLD,
    DEFAULT_SCOPE_RULE,
    SCOPE_RULES,
    TAXONOMY,
)
from emberledger.functions.text import fill
from emberledger.operators.audit import audit_rows
from emberledger.operators.bounds import fixed_table

CLASSIFIED = "classified"
PENDING_REVIEW = "pending_review"
OPEN_STATUSES = ("pending", "pending_review")

_OUTCOMES = [rule[1:] for rule in SCOPE_RULES] + [DEFAULT_SCOPE_RULE]


def taxonomy(spark) -> DataFrame:
    """The fixed (scope, category) table, with the position of each category in its scope."""
    return fixed_table(
        spark,
        [(s, c, n) for s, cats in TAXONOMY.items() for n, c in enumerate(cats, 1)],
        ["scope", "ghg_category", "position"],
    )


def is_valid_scope(scope: Column) -> Column:
    return F.coalesce(scope.isin(*TAXONOMY), F.lit(False))


def is_valid_category(category: Column) -> Column:
    return F.coalesce(
        category.isin(*[c for cats in TAXONOMY.values() for c in cats]), F.lit(False)
    )


def is_valid_pair(scope: Column, category: Column) -> Column:
    verdict = F.lit(False)
    for s, cats in TAXONOMY.items():
        verdict = F.when(scope == s, category.isin(*cats)).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def rule_number() -> Column:
    """Index of the first rule of which some keyword occurs in the text of an activity.

    The keywords of a rule are one constant array that ``exists`` walks through; spelled out
    as single tests they would make a generated method too long for the JIT compiler. The
    text is bound to a lambda variable, so that it is built once per row even where Catalyst
    copies the rule into a filter.
    """
    text = (
        "lower(replace(concat_ws(' ', coalesce(activity_type, ''), coalesce(unit, ''), "
        "coalesce(raw_line_ref, '')), '_', ' '))"
    )
    tests = " ".join(
        f"WHEN exists(array({', '.join(map(repr, keywords))}), k -> contains(t, k)) THEN {n}"
        for n, (keywords, *_rest) in enumerate(SCOPE_RULES)
    )
    return F.expr(
        f"transform(array({text}), t -> CASE {tests} ELSE {len(SCOPE_RULES)} END)[0]"
    )


def _outcome(rule: Column, position: int, of: type) -> Column:
    return F.get(F.lit([of(o[position]) for o in _OUTCOMES]), rule)


def classify(activities: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Set scope, category, confidence, reasoning and status of every given activity."""
    kept = [
        c for c in activities.columns
        if c not in ("scope", "ghg_category", "classification_confidence", "reasoning", "status")
    ]
    rule = F.col("_rule")
    return (
        activities.select(*kept, rule_number().alias("_rule"))
        .select(
            *kept,
            _outcome(rule, 0, int).alias("scope"),
            _outcome(rule, 1, str).alias("ghg_category"),
            _outcome(rule, 2, float).alias("classification_confidence"),
            _outcome(rule, 3, str).alias("reasoning"),
        )
        .withColumn("status", gate(F.col("classification_confidence"), threshold))
    )


def gate(confidence: Column, threshold: float = CONFIDENCE_THRESHOLD) -> Column:
    return F.when(confidence >= threshold, F.lit(CLASSIFIED)).otherwise(F.lit(PENDING_REVIEW))


def pending_activities(
    activities: DataFrame, entity_id: str | None = None, document_id: str | None = None
) -> DataFrame:
    """Activities still to be classified."""
    df = activities.where(F.col("status").isin(*OPEN_STATUSES))
    if entity_id is not None:
        df = df.where(F.col("entity_id") == entity_id)
    if document_id is not None:
        df = df.where(F.col("source_document_id") == document_id)
    return df


def normalize_result(results: DataFrame) -> DataFrame:
    """Clamp confidence to [0, 1]; a category foreign to its scope becomes the first of it."""
    first = F.lit(None).cast("string")
    for s, cats in TAXONOMY.items():
        first = F.when(F.col("scope") == s, F.lit(cats[0])).otherwise(first)
    return results.withColumn(
        "classification_confidence",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("classification_confidence"))),
    ).withColumn(
        "ghg_category",
        F.when(is_valid_pair(F.col("scope"), F.col("ghg_category")), F.col("ghg_category"))
        .otherwise(F.coalesce(first, F.col("ghg_category"))),
    )


def taxonomy_violations(activities: DataFrame) -> DataFrame:
    """Rows whose scope and category are not a pair of the taxonomy."""
    return activities.where(
        ~is_valid_pair(F.col("scope"), F.col("ghg_category"))
    ).withColumn("valid_scope", is_valid_scope(F.col("scope"))).withColumn(
        "valid_category", is_valid_category(F.col("ghg_category"))
    )


def classification_audit(classified: DataFrame, event_ts: Column) -> DataFrame:
    return audit_rows(
        classified, "ActivityData", F.col("activity_id"), "CLASSIFY",
        F.lit("system:scope_classifier"), event_ts,
        ["scope", "ghg_category", F.col("classification_confidence").alias("confidence"),
         "status", "reasoning"],
    )


def classification_summary(classified: DataFrame, *keys: str) -> DataFrame:
    return classified.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(F.col("status") == CLASSIFIED).alias("classified_count"),
        F.count_if(F.col("status") == PENDING_REVIEW).alias("pending_review_count"),
        F.count_if(F.col("classification_confidence") < CONFIDENCE_THRESHOLD)
        .alias("low_confidence_count"),
    )


def split_decisions(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) review decisions.

    Usable: a valid scope/category pair, and the latest one of its activity by
    (decided_at, reviewer_id).
    """
    valid = is_valid_pair(F.col("scope"), F.col("ghg_category"))
    rest = [c for c in decisions.columns if c != "activity_id"]
    latest = (
        decisions.where(valid)
        .groupBy("activity_id")
        .agg(F.max_by(F.struct(*rest), F.struct("decided_at", "reviewer_id")).alias("_d"))
        .select("activity_id", "_d.*")
        .select(*decisions.columns)
    )
    rejected = decisions.where(~valid).withColumn(
        "error",
        fill(messages.INVALID_CATEGORY, category=F.coalesce("ghg_category", F.lit("")),
             scope=F.coalesce(F.col("scope").cast("string"), F.lit(""))),
    )
    return latest, rejected


def apply_reviews(classified: DataFrame, decisions: DataFrame) -> DataFrame:
    """Override classifications by review decisions, keeping the previous values beside them."""
    usable, _rejected = split_decisions(decisions)
    d = usable.select(
        F.col("activity_id").alias("_id"), F.col("scope").alias("_scope"),
        F.col("ghg_category").alias("_category"), "reviewer_id", "decided_at", "notes",
    )
    reviewed = F.col("_id").isNotNull()
    same = [
        c for c in classified.columns
        if c not in ("scope", "ghg_category", "classification_confidence", "status")
    ]
    return classified.join(d, F.col("activity_id") == F.col("_id"), "left").select(
        *same,
        F.coalesce("_scope", "scope").alias("scope"),
        F.coalesce("_category", "ghg_category").alias("ghg_category"),
        F.when(reviewed, F.lit(1.0)).otherwise(F.col("classification_confidence"))
        .alias("classification_confidence"),
        F.when(reviewed, F.lit(CLASSIFIED)).otherwise(F.col("status")).alias("status"),
        reviewed.alias("reviewed"),
        F.when(reviewed, F.col("scope")).alias("old_scope"),
        F.when(reviewed, F.col("ghg_category")).alias("old_ghg_category"),
        F.when(reviewed, F.col("status")).alias("old_status"),
        "reviewer_id", "decided_at", "notes",
    )


def review_audit(reviewed: DataFrame) -> DataFrame:
    return audit_rows(
        reviewed.where("reviewed"), "ActivityData", F.col("activity_id"), "CLASSIFY_OVERRIDE",
        F.concat(F.lit("user:"), F.col("reviewer_id")), F.col("decided_at"),
        ["old_scope", F.col("scope").alias("new_scope"), "old_ghg_category",
         F.col("ghg_category").alias("new_ghg_category"), "old_status",
         F.lit(CLASSIFIED).alias("new_status"), F.coalesce("notes", F.lit("")).alias("notes")],
    )


def benchmark(predicted: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Accuracy and confusion by labelled scope, from one join and one aggregation."""
    counts = predicted.join(expected, key).groupBy("expected_scope", "scope").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ghg_category") == F.col("expected_category")).alias("same_category"))
    return counts.groupBy("expected_scope").agg(
        F.sum("n").alias("items"),
        (F.coalesce(F.sum(F.when(F.col("scope") == F.col("expected_scope"), F.col("n"))),
                    F.lit(0)) / F.sum("n")).alias("scope_accuracy"),
        (F.sum("same_category") / F.sum("n")).alias("category_accuracy"),
        *[F.coalesce(F.sum(F.when(F.col("scope") == s, F.col("n"))), F.lit(0))
          .alias(f"predicted_scope_{s}") for s in TAXONOMY])


def classifier_accuracy(predicted: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Scope and category accuracy against labels ``(key, expected_scope, expected_category)``."""
    joined = predicted.join(expected, key)
    return joined.groupBy(F.col("expected_scope")).agg(
        F.count(F.lit(1)).alias("items"),
        F.avg((F.col("scope") == F.col("expected_scope")).cast("int")).alias("scope_accuracy"),
        F.avg((F.col("ghg_category") == F.col("expected_category")).cast("int"))
        .alias("category_accuracy"),
    )


def confusion_matrix(predicted: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Labelled scope by predicted scope."""
    joined = predicted.join(expected, key)
    return joined.groupBy("expected_scope").agg(
        *[
            F.count_if(F.col("scope") == s).alias(f"predicted_scope_{s}")
            for s in TAXONOMY
        ]
    )

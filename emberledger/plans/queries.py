"""Registered queries: every operator of the library over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberledger import schemas
from emberledger.constants import HEADER_SYNONYMS
from emberledger.functions import dates, numbers, tokens, units
from emberledger.operators import (
    anomalies,
    audit,
    bills,
    classification,
    cleansing,
    disclosures,
    eligibility,
    emissions,
    factor_merge,
    factors,
    inventory,
    ledger,
    lineage,
    narrative,
    privacy,
    scenario,
    suppliers,
)
from emberledger.operators.bounds import settled
from emberledger.plans.testbed import Testbed, flat, line_id
from emberledger.session import checkpoint_root
from emberledger.sources import cube_store, documents, ledger_store, moment_store, trace_store
from emberledger.streaming import ingest, retraction

_QUERIES: dict[str, Callable[[Testbed], DataFrame]] = {}

# Deviations below this share of the mean are rounding noise of the 8-decimal results.
STDEV_FLOOR = 1e-3


def _query(fn: Callable[[Testbed], DataFrame]) -> Callable[[Testbed], DataFrame]:
    _QUERIES[fn.__name__] = fn
    return fn


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: flat(fn(Testbed(spark, sf_dir)))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


# -- sources ---------------------------------------------------------------------------


@_query
def q_factor_load(t: Testbed) -> DataFrame:
    """Factor rows offered by every supplier's country and part type, loaded once."""
    offers = t.table("part").select(
        F.lit("CATALOGUE").alias("source"), F.col("p_brand").alias("source_version"),
        F.lower("p_type").alias("activity_type"),
        F.concat(F.lit("SIZE-"), (F.col("p_size") % 3).cast("string")).alias("geography"),
        F.col("p_retailprice").cast("decimal(20,8)").alias("factor_value"),
        F.col("p_partkey").alias("file_order"),
    )
    known = t.table("part").where("p_retailprice < 950").select(
        F.lit("CATALOGUE").alias("source"), F.col("p_brand").alias("source_version"),
        F.lit("economy").alias("activity_type"), F.lit("SIZE-0").alias("geography"),
    ).distinct()
    return factors.new_factors(offers, known, F.col("file_order"))


@_query
def q_document_registry(t: Testbed) -> DataFrame:
    docs = t.table("documents").select(
        "doc_id", "text", F.col("source").alias("entity"),
        F.concat(
            F.lit("../in/"), F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"),
            F.when(F.col("doc_id") % 4 == 0, F.lit(".PDF"))
            .when(F.col("doc_id") % 4 == 1, F.lit(".csv"))
            .when(F.col("doc_id") % 4 == 2, F.lit(".xlsx")).otherwise(F.lit(".txt")),
        ).alias("filename"),
    )
    registered_docs = documents.register(
        docs, F.col("entity"), F.col("filename"), F.col("text")
    )
    return documents.first_copies(registered_docs).drop("document_id")


# -- cleansing -------------------------------------------------------------------------


@_query
def q_header_mapping(t: Testbed) -> DataFrame:
    """Each customer's export has its own header row, in one of many spellings."""
    n = F.col("c_custkey")

    def pick(target: str):
        options = F.array(*[F.lit(s) for s in HEADER_SYNONYMS[target]])
        name = F.element_at(options, (n % len(HEADER_SYNONYMS[target]) + 1).cast("int"))
        return (
            F.when(n % 3 == 0, F.initcap(name))
            .when(n % 3 == 1, F.replace(F.upper(name), F.lit(" "), F.lit("_")))
            .otherwise(F.concat(F.lit("  "), name, F.lit(" ")))
        )

    headers = t.table("customer").select(
        F.col("c_custkey").alias("file_id"),
        F.posexplode(
            F.array(
                *[pick(x) for x in HEADER_SYNONYMS if x != "unit"],
                F.when(n % 5 == 0, F.lit("Comment")).otherwise(pick("unit")),
            )
        ).alias("pos", "header"),
    )
    resolved = cleansing.resolve_headers(headers)
    return resolved.join(cleansing.missing_fields(headers, resolved), "file_id")


def _typed_quantity(t: Testbed) -> DataFrame:
    """Line item prices as people would type them."""
    price = F.col("l_extendedprice").cast("decimal(14,2)")
    plain, grouped = price.cast("string"), F.format_number(price, 2)
    k = F.col("l_linenumber")
    text = (
        F.when(k == 1, plain).when(k == 2, F.concat(F.lit("$"), grouped))
        .when(k == 3, F.concat(F.lit("("), grouped, F.lit(")")))
        .when(k == 4, F.concat(F.lit("€ "), grouped))
        .when(k == 5, F.concat(F.lit("-"), plain))
        .when(k == 6, F.concat(F.lit(" usd "), grouped, F.lit(" ")))
        .otherwise(F.concat(F.lit("approx. "), plain))
    )
    return t.table("lineitem").select(_line_id(), text.alias("raw_quantity"), *_raw_dates())


def _line_id():
    return line_id().alias("line_id")


def _raw_dates():
    d = F.col("l_shipdate")
    k = F.col("l_orderkey") % 8
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 1, F.date_format(d, "MM/dd/yyyy"))
        .when(k == 2, F.date_format(d, "MMM d, yyyy"))
        .when(k == 3, F.date_format(d, "d MMMM yyyy"))
        .when(k == 4, F.date_format(d, "yyyy/M/d"))
        .when(k == 5, F.datediff(d.cast("date"), F.lit("1899-12-30").cast("date")).cast("string"))
        .when(k == 6, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T00:00:00Z")))
        .otherwise(F.concat(F.lit("week "), F.date_format(d, "D")))
    )
    return [text.alias("raw_date")]


@_query
def q_clean_quantity(t: Testbed) -> DataFrame:
    return _typed_quantity(t).select(
        "line_id", "raw_quantity",
        numbers.parse_quantity(F.col("raw_quantity")).alias("quantity"),
    )


@_query
def q_clean_date(t: Testbed) -> DataFrame:
    return _typed_quantity(t).select(
        "line_id", "raw_date", dates.parse_date(F.col("raw_date")).alias("clean_date")
    )


@_query
def q_spelled_dates(t: Testbed) -> DataFrame:
    """Dates with month names, compact ones with a time, two-digit years."""
    d = F.col("l_shipdate")
    spelled = F.element_at(F.array(
        F.date_format(d, "dd-MMM-yy"), F.date_format(d, "dd/MMM/yyyy"),
        F.date_format(d, "MMM d, yy"), F.concat(F.date_format(d, "yyyyMMdd"), F.lit("T1000")),
        F.date_format(d, "yyyy MMM d"), F.concat(F.date_format(d, "EEE, d MMM yyyy"),
                                                 F.lit(" 10:00:00 GMT")),
        F.date_format(d, "MMM yyyy")), (F.col("l_linenumber") % 7 + 1).cast("int"))
    return t.table("lineitem").select(
        _line_id(), spelled.alias("raw_date"), dates.parse_date(spelled).alias("clean_date"))


@_query
def q_exports(t: Testbed) -> DataFrame:
    """Line items written as exports to shared storage and streamed in, file by file: suppliers
    with quotes and line breaks in their names, rows that differ in their supplier only."""
    run = f"{checkpoint_root(t.spark)}/exports-{uuid.uuid4().hex}"
    lines = t.table("lineitem").select(
        F.lit("electricity_purchase").alias("Fuel"), F.lit("10").alias("Quantity"),
        F.lit("kWh").alias("Unit"), F.lit("US").alias("Country"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date"),
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(
            F.lit('Firm "'), F.col("l_suppkey").cast("string"), F.lit('"\nand sons')))
        .otherwise(F.concat(F.lit("Firm "), F.col("l_suppkey").cast("string"))).alias("Supplier"))
    lines.repartition(4, "Date").write.option("header", True).option("escape", '"').csv(f"{run}/in")
    ingest.ingest_exports(
        t.spark, f"{run}/in", f"exports-{uuid.uuid4().hex}",
        lambda rows, _batch: rows.write.mode("append").parquet(f"{run}/out"),
        files_per_batch=2).awaitTermination()
    rows = t.spark.read.parquet(f"{run}/out")
    return rows.groupBy("period_start", "supplier_ref").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("activity_id").alias("n_ids"),
        F.sum(F.size("row_errors")).cast("bigint").alias("n_errors"))


@_query
def q_activity_validate(t: Testbed) -> DataFrame:
    """Line items as raw text rows with gaps, typed and validated."""
    flag = F.col("l_returnflag")
    raw = t.table("lineitem").select(
        _line_id(),
        F.when(F.col("l_tax") > 0.075, F.lit("  ")).otherwise(F.lit(" electricity_purchase "))
        .alias("activity_type"),
        F.when(F.col("l_linenumber") == 7, F.lit("n/a"))
        .otherwise(F.col("l_quantity").cast("decimal(10,1)").cast("string")).alias("quantity"),
        F.when(F.col("l_discount") > 0.095, F.lit("")).otherwise(F.lit("kWh")).alias("unit"),
        F.when(flag == "A", F.lit("GB")).alias("geography"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("period_start"),
        F.when(flag == "N", F.lit("soon")).when(flag == "R", F.lit("")).otherwise(
            F.date_format("l_shipdate", "MM/dd/yyyy")).alias("period_end"),
        F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("supplier_ref"),
        F.lit(None).cast("string").alias("raw_line_ref"),
    )
    built = cleansing.build_activities(raw, row_number=F.split("line_id", "-")[1])
    return built.withColumn("row_errors", F.array_join("row_errors", "; "))


@_query
def q_tokenize_supplier(t: Testbed) -> DataFrame:
    return t.table("supplier").select(
        "s_suppkey",
        tokens.tokenize_supplier(
            F.when(F.col("s_suppkey") % 10 == 0, F.lit("  "))
            .when(F.col("s_suppkey") % 10 == 1, F.lit(" TOKEN_SUPP_ABC "))
            .otherwise(F.concat(F.lit("  "), F.upper("s_name"), F.lit("  Müller   Co ")))
        ).alias("token"),
    )


@_query
def q_tokenize_account(t: Testbed) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return t.table("customer").select(
        "c_custkey",
        tokens.tokenize_account(
            F.when(F.col("c_custkey") % 10 == 0, F.lit(" -- "))
            .when(F.col("c_custkey") % 10 == 1, F.lit(".:;!?"))
            .otherwise(F.concat(F.lit(" acct - "), key, F.lit("-"), F.col("c_nationkey").cast("string")))
        ).alias("token"),
    )


# -- privacy and bills -----------------------------------------------------------------


def _redaction_text(t: Testbed) -> DataFrame:
    n = F.col("doc_id").cast("string")
    return t.table("documents").select(
        "doc_id",
        F.concat(
            F.col("text"), F.lit("\nPaid to REGIONAL  FUEL Depot and Regional Fuel. Account Number: 98"),
            n, F.lit("-1104, ref ACCT-77-"), n, F.lit(". Meter No: MTR-55"), n,
            F.lit(". Tax ID: 12-34"), n, F.lit(". Again 98"), n, F.lit("-1104 and 98"), n,
            F.lit("-11040 kWh."),
        ).alias("body"),
    )


NEW_FACTORS = ("EL-US-2", "GA-US-1")
REDACTED_NAMES = ("Regional Fuel", "Regional Fuel Depot")


@_query
def q_redact_text(t: Testbed) -> DataFrame:
    done = privacy.redact(_redaction_text(t), "body", REDACTED_NAMES)
    return done.select("doc_id", "redacted_text")


@_query
def q_token_map(t: Testbed) -> DataFrame:
    return privacy.token_map(privacy.redact(_redaction_text(t), "body", REDACTED_NAMES))


@_query
def q_redact_names(t: Testbed) -> DataFrame:
    """A list of 120 names: one without letters, ten that stand within another one only."""
    names = ["&&", *[f"Depot {n:03d}" for n in range(109)], *[f"Depot {n:03d} North"
                                                               for n in range(10)]]
    n = F.col("doc_id") % 10
    body = F.concat(F.lit("From DEPOT 00"), n.cast("string"), F.lit("  north && to depot 1"),
                    F.lpad(n.cast("string"), 2, "0"), F.lit("."))
    docs = t.table("documents").select("doc_id", body.alias("body"))
    done = privacy.redact(docs, "body", names)
    return done.select(
        "doc_id", "redacted_text",
        F.array_join(F.array_sort(F.transform("redactions", lambda r: r["raw_value"])), "|")
        .alias("names"))


@_query
def q_redact_dictionary(t: Testbed) -> DataFrame:
    """Redaction against the supplier table as dictionary: each text names three suppliers."""
    names = t.table("supplier").select(F.col("s_name").alias("name"))
    n_suppliers = F.col("doc_id")
    mention = F.concat(
        F.lit(" Supplier#"), F.lpad((n_suppliers % 97).cast("string"), 9, "0"),
        F.lit(", supplier#"), F.lpad((n_suppliers % 31).cast("string"), 9, "0"),
        F.lit(" and SUPPLIER#"), F.lpad((n_suppliers % 13).cast("string"), 9, "0"), F.lit("."),
    )
    docs = t.table("documents").select("doc_id", F.concat("text", mention).alias("body"))
    done = privacy.redact(docs, "body", names)
    return done.select(
        "doc_id", F.size("redactions").cast("bigint").alias("n_found"),
        F.regexp_count("redacted_text", F.lit("TOKEN_SUPP_")).alias("n_tokens"),
        F.rlike("redacted_text", F.lit(r"(?i)supplier#\d{9}\b")).alias("leaks"),
    )


@_query
def q_bill_lines(t: Testbed) -> DataFrame:
    return bills.bill_lines(bills.bill_header(t.bills(), t.as_of))


@_query
def q_provider_detect(t: Testbed) -> DataFrame:
    text = F.array_join("pages", "\n")
    return t.bills().select(
        "doc_id", bills.detect_provider_name(text).alias("provider"),
        bills.detect_provider(text).alias("supplier_ref"),
    )


@_query
def q_geo_detect(t: Testbed) -> DataFrame:
    return t.bills().select(
        "doc_id", bills.detect_geography(F.array_join("pages", "\n")).alias("geography")
    )


# -- classification --------------------------------------------------------------------


@_query
def q_classify(t: Testbed) -> DataFrame:
    return t.classified().select(
        "activity_id", "activity_type", "scope", "ghg_category", "classification_confidence",
        "status",
    )


@_query
def q_classify_summary(t: Testbed) -> DataFrame:
    return classification.classification_summary(t.classified(), "entity_id")


@_query
def q_classify_audit(t: Testbed) -> DataFrame:
    rows = classification.classification_audit(t.classified(), F.col("created_at"))
    return rows.select(
        "entity_type", "entity_id", "action", "actor", "event_ts",
        F.get_json_object("detail", "$.scope").cast("bigint").alias("scope"),
        F.get_json_object("detail", "$.ghg_category").alias("ghg_category"),
        F.get_json_object("detail", "$.status").alias("status"),
        F.get_json_object("detail", "$.reasoning").alias("reasoning"),
    )


def _foreign_results(t: Testbed) -> DataFrame:
    """Classifier answers with confidences out of range and categories of other scopes."""
    return t.table("lineitem").select(
        _line_id(), F.col("l_linenumber").alias("scope"),
        F.when(F.col("l_returnflag") == "A", F.lit("business_travel"))
        .when(F.col("l_returnflag") == "N", F.lit("purchased_steam"))
        .otherwise(F.lit("unknown_category")).alias("ghg_category"),
        (F.col("l_discount") * 30 - 1).alias("classification_confidence"),
    )


@_query
def q_classification_normalize(t: Testbed) -> DataFrame:
    return classification.normalize_result(_foreign_results(t))


@_query
def q_taxonomy_violations(t: Testbed) -> DataFrame:
    return classification.taxonomy_violations(_foreign_results(t)).drop("classification_confidence")


@_query
def q_review_apply(t: Testbed) -> DataFrame:
    done = classification.apply_reviews(t.classified(), t.review_decisions())
    return done.select(
        "activity_id", "scope", "ghg_category", "classification_confidence", "status",
        "reviewed", "old_scope", "old_ghg_category", "old_status", "reviewer_id",
    )


@_query
def q_review_rejected(t: Testbed) -> DataFrame:
    _usable, rejected = classification.split_decisions(t.review_decisions())
    return rejected.select("activity_id", "reviewer_id", "error")


@_query
def q_review_queue(t: Testbed) -> DataFrame:
    """The page after the first fifty of the review queue."""
    queue = audit.review_queue(t.classified())
    return audit.page(
        queue.select("activity_id", "entity_id", "activity_type", "classification_confidence",
                     "created_at"),
        [F.desc("created_at"), F.asc("activity_id")], limit=50, offset=50,
    )


def _labels(t: Testbed) -> DataFrame:
    """Expected scope of each line item by its part type."""
    parts = t.table("part").select("p_partkey", "p_type")
    expected = {"ECONOMY": 2, "LARGE": 1, "MEDIUM": 1}
    scope = F
    for part, s in expected.items():
        scope = scope.when(F.col("p_type") == part, s)
    category = (
        F.when(F.col("p_type") == "ECONOMY", "purchased_electricity")
        .when(F.col("p_type") == "LARGE", "stationary_combustion")
        .when(F.col("p_type") == "MEDIUM", "mobile_combustion")
        .when(F.col("p_type") == "PROMO", "business_travel")
        .when(F.col("p_type") == "SMALL", "upstream_transportation_distribution")
        .otherwise("purchased_goods_services")
    )
    return t.table("lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        _line_id().alias("activity_id"), scope.otherwise(3).alias("expected_scope"),
        category.alias("expected_category"),
    )


@_query
def q_classify_accuracy(t: Testbed) -> DataFrame:
    predicted, expected = t.classified(), _labels(t)
    return classification.benchmark(predicted, expected, "activity_id").withColumns(
        {c: F.round(c, 6) for c in ("scope_accuracy", "category_accuracy")}
    )


# -- factors and emissions -------------------------------------------------------------


@_query
def q_factor_match(t: Testbed) -> DataFrame:
    return factors.match_factors(t.activities(), t.index()).select(
        "activity_id", "factor_id", "factor_source", "factor_version", "fallback_level"
    )


def _hot_place(activities: DataFrame) -> DataFrame:
    """The activities with nine of ten in one place."""
    return activities.withColumn("geography", F.when(
        F.col("quantity") <= 45, F.lit("US-CA")).otherwise(F.col("geography")))


@_query
def q_factor_match_merged(t: Testbed) -> DataFrame:
    """Matching by sorting, with nine of ten activities in one place."""
    acts = settled(_hot_place(t.activities()), "hot-activities")
    return factor_merge.match_by_merge(acts, t.index(), hot_rows=20_000).select(
        "activity_id", "factor_id", "factor_source", "factor_version", "fallback_level")


@_query
def q_recalculated(t: Testbed) -> DataFrame:
    """What the calculations of a stored table become when two factors arrive: one that follows
    an earlier version and one for a type that had none."""
    path = f"{checkpoint_root(t.spark)}/recalculated-{uuid.uuid4()}"
    before = factors.FactorIndex.build(t.factors().where(~F.col("factor_id").isin(*NEW_FACTORS)))
    ledger_store.append(t.classified(), path)
    stored = ledger_store.ledger_table(t.spark, path).snapshot()
    return factor_merge.recalculated(stored, before, t.index()).where(
        F.col("factor_id").isin(*NEW_FACTORS)).select(
        "activity_id", "factor_id", "calc_status", "result_tco2e")


@_query
def q_pending_factor(t: Testbed) -> DataFrame:
    matched = factors.match_factors(t.activities(), t.index())
    return factors.explain_unmatched(matched, t.index()).select(
        "activity_id", "activity_type", "geography", "period_start", "has_active_factor", "reason"
    )


@_query
def q_unit_convert(t: Testbed) -> DataFrame:
    """Every quantity in the unit of its factor."""
    done = t.computed().where("calc_status = 'computed'")
    return done.select(
        "activity_id", "unit", "denominator", F.round("unit_ratio", 12).alias("unit_ratio"),
        emissions.converted_quantity(F.col("quantity"), F.col("unit_ratio"))
        .cast("decimal(24,9)").alias("converted_quantity"),
    )


@_query
def q_unit_errors(t: Testbed) -> DataFrame:
    return emissions.unit_errors(t.computed()).select("activity_id", "unit", "factor_id", "error")


@_query
def q_factor_unit_parse(t: Testbed) -> DataFrame:
    """Factor units spelled out of part attributes."""
    size = F.col("p_size") % 8
    text = (
        F.when(size == 0, F.concat(F.lit("kgCO2e/"), "p_type"))
        .when(size == 1, F.concat(F.lit(" g_CO2e / "), "p_type"))
        .when(size == 2, F.concat(F.lit("tCO2e/"), "p_type"))
        .when(size == 3, F.concat(F.lit("lb CO2e/"), "p_type"))
        .when(size == 4, F.concat(F.lit("MtCO2e/"), "p_type"))
        .when(size == 5, F.lit("kgCO2e"))
        .when(size == 6, F.concat(F.lit("kg/"), "p_type", F.lit("/year")))
        .otherwise(F.concat(F.lit("tonne-CO2e/"), "p_type"))
    )
    return t.table("part").withColumn("factor_unit", text).select(
        "p_partkey", "factor_unit",
        units.factor_numerator(F.col("factor_unit")).alias("numerator"),
        units.factor_denominator(F.col("factor_unit")).alias("denominator"),
        units.normalize_unit(F.col("factor_unit")).alias("normalized"),
        units.numerator_to_tonnes(units.factor_numerator(F.col("factor_unit")))
        .alias("numerator_ratio"),
    )


@_query
def q_emissions(t: Testbed) -> DataFrame:
    return t.computed().where("calc_status = 'computed'").select(
        "calculation_id", "activity_id", "factor_id", "scope", "ghg_category", "result_tco2e"
    )


@_query
def q_emissions_range(t: Testbed) -> DataFrame:
    """Line items counted in billions and in fractions: from a millionth to 9 x 10^13 units, with
    the outcome of results that the ledger cannot hold."""
    scale = F.element_at(F.array(*[F.lit(x).cast("decimal(13,0)") for x in (
        1, 1000000000, 1800000000000)]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    acts = t.table("lineitem").select(
        _line_id().alias("activity_id"), F.lit("freight_road").alias("activity_type"),
        (F.col("l_quantity").cast("decimal(5,2)") * scale).cast("decimal(20,6)").alias("quantity"),
        F.when(F.col("l_linenumber") == 7, F.lit("kWh")).otherwise(F.lit("tonne.km")).alias("unit"),
        F.lit("GB").alias("geography"), F.col("l_shipdate").cast("date").alias("period_start"))
    facts = t.factors().where("factor_id = 'FR-GB-1'").withColumn(
        "effective_from", F.lit("1990-01-01").cast("date")).withColumn(
        "factor_value", F.lit("123.45678901").cast("decimal(20,8)"))
    done = emissions.compute(acts, factors.FactorIndex.build(facts))
    errors = emissions.unit_errors(done).select("activity_id", "error")
    return done.join(errors, "activity_id", "left").select(
        "activity_id", "calc_status", F.col("result_tco2e").cast("string").alias("result_text"),
        F.substring("error", 1, 14).alias("reason"))


@_query
def q_formula(t: Testbed) -> DataFrame:
    return emissions.calculations(t.computed(), "calc_engine_v1", F.col("created_at")).select(
        "activity_id", "formula_applied"
    )


@_query
def q_calc_status(t: Testbed) -> DataFrame:
    return t.computed().select("activity_id", "fallback_level", "calc_status")


@_query
def q_calc_summary(t: Testbed) -> DataFrame:
    return emissions.calculation_summary(t.computed(), "source_document_id")


@_query
def q_calc_audit(t: Testbed) -> DataFrame:
    rows = emissions.calculation_audit(t.computed(), t.index(), "api_batch", F.col("created_at"))

    return rows.select(
        "entity_type", "entity_id", "action", "actor", "event_ts",
        F.json_tuple("detail", "emission_factor_id", "fallback_level", "result_tco2e", "reason",
                     "error").alias(
            "emission_factor_id", "fallback_level", "result_tco2e", "reason", "error"),
    )


@_query
def q_latest_calculation(t: Testbed) -> DataFrame:
    """Two runs of the calculations, the later one under the shifted date of the activity."""
    runs = emissions.calculations(t.computed(), "run", F.col("created_at"))
    again = F.struct(*[{
        "calculation_id": F.md5(F.concat("calculation_id", F.lit("|2"))),
        "computed_at": F.col("computed_at") + F.expr("INTERVAL 1 DAY"),
        "computed_by": F.lit("rerun"),
    }.get(c, F.col(c)).alias(c) for c in runs.columns])
    # Both rows of a calculation come from one pass over it.
    both = runs.select(F.inline(F.array(F.struct(*runs.columns), again)))
    return emissions.latest_calculations(both).select(
        "activity_id", "calculation_id", "computed_by", "computed_at"
    )


# -- inventory -------------------------------------------------------------------------


@_query
def q_scope_totals(t: Testbed) -> DataFrame:
    return inventory.scope_totals(inventory.inventory(t.ledger()))


@_query
def q_hotspots(t: Testbed) -> DataFrame:
    return inventory.hotspots(inventory.inventory(t.ledger()))


@_query
def q_trend(t: Testbed) -> DataFrame:
    return inventory.yearly_trend(inventory.inventory(t.ledger()))


@_query
def q_hotspots_kept(t: Testbed) -> DataFrame:
    """Hotspots from the kept inventory, which follows the stored ledger by differences: results
    of returned items were too high and a year late until replaced, and rows of an entity that
    does not exist were there until deleted."""
    root = f"{checkpoint_root(t.spark)}/hotspots-kept-{uuid.uuid4()}"
    right = settled(t.ledger("return_flag"), "ledger")
    back = F.col("return_flag") == "R"
    ledger_store.append(right.where(~back).unionByName(_recalculated(right)), f"{root}/ledger")
    ledger_store.append(right.where(back).withColumns({
        "entity_id": F.lit("GHOST"),
        "calculation_id": F.concat(F.lit("ghost-"), "calculation_id")}), f"{root}/ledger")
    table = ledger_store.ledger_table(t.spark, f"{root}/ledger")
    cube_store.refresh(t.spark, table.snapshot(), f"{root}/cube")
    ledger_store.replace_rows(t.spark, right.where(back), f"{root}/ledger", "calculation_id")
    base = table.snapshot()
    ghosts = base.rows().where("entity_id = 'GHOST'")
    held = table.partitions_of(ghosts)
    table.commit(base, base.rows(held.__contains__).where("entity_id <> 'GHOST'"), held)
    cube_store.refresh(t.spark, table.snapshot(), f"{root}/cube")
    return inventory.hotspots(cube_store.kept_inventory(t.spark, f"{root}/cube"))


def _flags(t: Testbed) -> DataFrame:
    return anomalies.anomaly_scan(t.stored_tampered(), rel_stdev_floor=STDEV_FLOOR)


@_query
def q_open_flags(t: Testbed) -> DataFrame:
    return inventory.open_flag_counts(_flags(t))


@_query
def q_dashboard(t: Testbed) -> DataFrame:
    """Flat view of the dashboard rows: first hotspot, number of trend points, open flags."""
    board = inventory.dashboard(
        inventory.inventory(t.stored_tampered()), inventory.open_flag_counts(_flags(t))
    )
    return board.select(
        "entity_id", "reporting_year", "gross_tco2e", "scope1_tco2e", "scope2_tco2e",
        "scope3_tco2e", "total_calculations",
        F.size("top_hotspots").alias("hotspot_count"),
        F.get("top_hotspots", F.lit(0))["ghg_category"].alias("top_category"),
        F.get("top_hotspots", F.lit(0))["total_tco2e"].alias("top_category_tco2e"),
        F.get("scope_breakdown", F.lit(2))["share_percentage"].alias("scope3_share"),
        F.size("historical_trends").alias("trend_points"),
        F.element_at("historical_trends", -1)["total_tco2e"].alias("latest_total_tco2e"),
        "open_anomalies_count", "critical_anomalies_count",
    )


@_query
def q_period_filter(t: Testbed) -> DataFrame:
    """What three period spellings select per entity, in all modes, with and without fallback."""
    rows = settled(t.ledger().select(
        "entity_id", "period_start", "period_end", "result_tco2e"), "period-ledger")
    entities = t.table("customer").select(F.col("c_mktsegment").alias("entity_id")).distinct()
    requests = entities.select(
        "entity_id",
        F.explode(F.array(F.lit("1998"), F.lit("1999-Q2"), F.lit("2050"))).alias("reporting_period"),
    )
    out = None
    for mode, fallback in (
        ("overlap_year", False), ("start_year", False), ("start_year", True), ("quarter", False),
    ):
        part = (
            ledger.select_period(rows, requests, mode, fallback)
            .groupBy("entity_id", "reporting_period", "is_fallback")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("result_tco2e").alias("tco2e"))
            .withColumn("mode", F.lit(mode)).withColumn("fallback_all", F.lit(fallback))
        )
        out = part if out is None else out.unionByName(part)
    return out


# -- disclosures -----------------------------------------------------------------------


@_query
def q_disclosure_rollup(t: Testbed) -> DataFrame:
    return disclosures.rollup(t.ledger())


@_query
def q_citations(t: Testbed) -> DataFrame:
    return disclosures.citations(t.ledger())


@_query
def q_eligibility(t: Testbed) -> DataFrame:
    return eligibility.eligibility(t.profiles()).drop("mandatory_scopes")


def _company_requests(t: Testbed) -> DataFrame:
    """Every other company by balance asks for all frameworks; some have no profile."""
    return t.table("customer").select(
        F.when(F.col("c_acctbal") < 0, F.concat(F.lit("No profile "), "c_name"))
        .otherwise(F.col("c_name")).alias("entity_id"),
        F.explode(F.array(*[F.lit(f) for f in ("CA_SB253", "CSRD_ESRS_E1", "GHG_PROTOCOL")]))
        .alias("framework"),
        F.lit("1999").alias("reporting_period"),
    )


@_query
def q_disclosure_gate(t: Testbed) -> DataFrame:
    accepted, rejected = eligibility.gate_requests(_company_requests(t), t.profiles())
    return accepted.withColumn("rejection", F.lit(None).cast("string")).unionByName(rejected)


def _reported(t: Testbed) -> DataFrame:
    """The columns of the ledger that disclosures are made of, settled once for all passes."""
    return settled(t.ledger().select(
        "calculation_id", "entity_id", "period_start", "scope", "ghg_category", "result_tco2e"),
        "reported-ledger")


@_query
def q_disclosures(t: Testbed) -> DataFrame:
    """All frameworks for every segment and year; segments are profiled as one company each."""
    requests = settled(t.activities().select(
        "entity_id", F.explode(F.array(F.lit("CA_SB253"), F.lit("GHG_PROTOCOL"))).alias("framework"),
        F.year("period_start").cast("string").alias("reporting_period"),
    ).distinct(), "requests")
    balance = F.sum(F.abs(F.col("c_acctbal").cast("decimal(14,2)")))
    profiles = t.table("customer").groupBy(F.col("c_mktsegment").alias("entity_id")).agg(
        (balance * 1000).cast("decimal(20,2)").alias("annual_revenue_usd"),
        (F.count_if(F.col("c_nationkey") == 0) % 2 == 0).alias("does_business_in_california"),
        balance.cast("decimal(20,2)").alias("eu_net_turnover_eur"),
        balance.cast("decimal(20,2)").alias("balance_sheet_total_eur"),
        F.count(F.lit(1)).cast("int").alias("employee_count"),
        F.lit(False).alias("is_eu_parent"),
    )
    accepted, _rejected = eligibility.gate_requests(requests, profiles)
    lines = disclosures.requested_lines(_reported(t), accepted)
    return disclosures.disclosure_rows(lines, accepted)


@_query
def q_disclosure_links(t: Testbed) -> DataFrame:
    requests = t.disclosure_requests()
    lines = t.disclosure_lines()
    table = disclosures.disclosure_rows(
        disclosures.requested_lines(t.ledger(), requests), requests
    )
    return lineage.linked_disclosures(lines, table).select(
        "calculation_id", "disclosure_id", "framework", "reporting_period", "status"
    )


@_query
def q_disclosure_totals(t: Testbed) -> DataFrame:
    return disclosures.totals_from_lines(t.disclosure_lines(), t.ledger())


# -- lineage ---------------------------------------------------------------------------


def _stored(t: Testbed, *extra: str) -> DataFrame:
    """Activities with their calculations, settled once for all tables that are made of them."""
    return settled(t.computed().select(
        "calculation_id", "activity_id", "factor_id", "result_tco2e", "calc_status", "entity_id",
        "activity_type", "quantity", "unit", "geography", "period_start", "raw_line_ref",
        "source_document_id", *extra), "stored", by="activity_id")


@_query
def q_trace(t: Testbed) -> DataFrame:
    """Calculations with everything they rest on and the audit events about it. Activities are
    classified from what is stored of them: with reasons and categories in them, the rows to be
    dealt are sorted on disk."""
    computed = _stored(t, "created_at")
    calcs = computed.where("calc_status = 'computed'").select(
        "calculation_id", "activity_id", "factor_id", "result_tco2e"
    )
    traced = lineage.trace(calcs, computed, t.factors(), t.documents())
    log = t.audit_log().select("entity_id", "action", "actor", "event_ts").unionByName(
        classification.classification_audit(classification.classify(computed), F.col("created_at"))
        .select("entity_id", "action", "actor", "event_ts")
    )
    facts = [
        "result_tco2e", "activity_type", "quantity", "unit", "factor_source", "factor_value",
        "filename", "document_status",
    ]
    return lineage.trace_events(traced, log, facts).drop("subject_id")


@_query
def q_trace_whole(t: Testbed) -> DataFrame:
    """How much every traced calculation rests on: its subjects' events and its disclosures,
    for calculations without either as well; the disclosure with the least id by name."""
    stored = _stored(t, "scope", "ghg_category", "line_status")
    ledger_rows = stored.where("calc_status = 'computed'")
    calcs = ledger_rows.select("calculation_id", "activity_id", "factor_id", "result_tco2e")
    traced = lineage.trace(calcs, stored, t.factors(), t.documents())
    requests = settled(t.disclosure_requests(stored), "requests")
    table = disclosures.disclosure_rows(
        disclosures.requested_lines(ledger_rows, requests), requests)
    return lineage.trace_summary(
        traced, t.audit_log(),
        lineage.linked_disclosures(t.disclosure_lines(ledger_rows), table))


@_query
def q_trace_indexed(t: Testbed) -> DataFrame:
    """``q_trace_whole`` from the kept index of traces. Returned items were indexed without their
    document and citations first and were put right after; the log came in two commits."""
    path = f"{checkpoint_root(t.spark)}/traces-{uuid.uuid4()}"
    stored = _stored(t, "scope", "ghg_category", "line_status", "return_flag")
    ledger_rows = stored.where("calc_status = 'computed'")
    calcs = ledger_rows.select(
        "calculation_id", "activity_id", "factor_id", "result_tco2e", "return_flag")
    traced = settled(lineage.trace(calcs, stored, t.factors(), t.documents()), "traced")
    requests = settled(t.disclosure_requests(stored), "requests")
    table = disclosures.disclosure_rows(
        disclosures.requested_lines(ledger_rows, requests), requests)
    linked = settled(
        lineage.linked_disclosures(t.disclosure_lines(ledger_rows), table), "linked")
    back, bought = F.col("return_flag") == "R", F.col("action") == "PURCHASE"
    returned = traced.where(back).select("calculation_id")
    unknown = {c: F.when(~back, F.col(c)) for c in ("source_document_id", "filename",
                                                    "document_status")}
    trace_store.append(t.spark, path, trace_store.entries(
        traced.withColumns(unknown), t.audit_log().where(bought),
        linked.join(returned, "calculation_id", "left_anti")))
    trace_store.append(t.spark, path, trace_store.entries(log=t.audit_log().where(~bought)))
    trace_store.replace(t.spark, path, returned, trace_store.entries(
        traced.where(back), linked=linked.join(returned, "calculation_id", "left_semi")))
    return trace_store.summary(trace_store.trace_table(t.spark, path).snapshot())


@_query
def q_stored_ledger(t: Testbed) -> DataFrame:
    """The ledger joined from its stored tables: calculation, activity and factor."""
    computed = t.computed()
    calcs = emissions.calculations(computed, "calc_engine_v1", F.col("created_at"))
    rows = ledger.join_ledger(calcs, t.classified(), t.factors())
    return rows.select("calculation_id", "activity_id", "factor_id", "factor_source", "entity_id",
                       "scope", "ghg_category", "result_tco2e")


@_query
def q_pending_activities(t: Testbed) -> DataFrame:
    """Activities that wait for a review."""
    return classification.pending_activities(t.classified()).select(
        "activity_id", "entity_id", "status")


@_query
def q_calc_deletable(t: Testbed) -> DataFrame:
    return lineage.calculation_deletable(
        t.ledger().select("calculation_id"), t.disclosure_lines()
    )


@_query
def q_factor_deletable(t: Testbed) -> DataFrame:
    return lineage.factor_deletable(t.factors().select("factor_id"), t.ledger())


@_query
def q_guarded_delete(t: Testbed) -> DataFrame:
    """Deletion asked for all calculations of returned items, and for one id that is not there."""
    rows = settled(t.ledger("return_flag", "line_status").select(
        "calculation_id", "entity_id", "period_start", "return_flag", "line_status"), "ledger")
    verdicts = lineage.calculation_deletable(
        rows.select("calculation_id"), t.disclosure_lines(rows))
    asked = rows.where("return_flag = 'R'").select("calculation_id").unionByName(
        rows.select(F.concat(F.lit("missing-"), "entity_id").alias("calculation_id")).distinct()
    )
    _remaining, outcome = lineage.guarded_delete(rows, "calculation_id", asked, verdicts)
    return outcome


@_query
def q_audit_query(t: Testbed) -> DataFrame:
    """Second page of the purchases in the audit log."""
    log = audit.list_audit_log(t.audit_log(), entity_type="source_document", action="PURCHASE")
    return audit.page(
        log.select("entity_id", "action", "actor", "event_ts", "detail", "event_id"),
        [F.desc("event_ts"), F.desc("event_id")], limit=100, offset=100,
    )


@_query
def q_document_detail(t: Testbed) -> DataFrame:
    detail = audit.document_detail(t.documents(), t.classified())
    return detail.select(
        "document_id", "entity_id", "filename", "status", "activity_id", "raw_line_ref",
        "activity_type", "quantity", "unit", "activity_status",
    )


# -- anomalies and narratives ----------------------------------------------------------


@_query
def q_yoy(t: Testbed) -> DataFrame:
    flags = anomalies.yoy_flags(anomalies.yearly_scopes(t.tampered()))
    return flags.drop("details_json").withColumn("metric", F.round("metric", 6))


@_query
def q_intensity_outliers(t: Testbed) -> DataFrame:
    rows = settled(t.tampered().select(
        "calculation_id", "activity_id", "entity_id", "activity_type", "unit", "quantity",
        "period_start", "period_end", "result_tco2e"), "ledger")
    return _outlier_rows(anomalies.intensity_scores(rows, rel_stdev_floor=STDEV_FLOOR))


def _outlier_rows(scored: DataFrame) -> DataFrame:
    return scored.select(
        "calculation_id", "activity_id", "entity_id", "reporting_year", "activity_type", "unit",
        "cohort_size", F.round("intensity", 9).alias("intensity"),
        F.round(F.round("cohort_mean", 12), 9).alias("cohort_mean"), F.round("z_score", 6).alias("z_score"),
    )


@_query
def q_intensity_kept(t: Testbed) -> DataFrame:
    """Outliers of a stored ledger by kept statistics, which follow a correction of two years:
    their results stood ten times too high when the statistics were first worked out."""
    root = f"{checkpoint_root(t.spark)}/intensity-kept-{uuid.uuid4()}"
    right, wrong = t.stored_tampered(), F.year("period_start").isin(1995, 1996)
    ledger_store.append(right.withColumn("result_tco2e", F.when(
        wrong, F.col("result_tco2e") * 10).otherwise(F.col("result_tco2e")).cast(schemas.TCO2E)),
        f"{root}/ledger")
    table = ledger_store.ledger_table(t.spark, f"{root}/ledger")
    moment_store.refresh(t.spark, table.snapshot(), f"{root}/moments")
    ledger_store.replace_rows(t.spark, right.where(wrong), f"{root}/ledger", "calculation_id")
    moment_store.refresh(t.spark, table.snapshot(), f"{root}/moments")
    return _outlier_rows(anomalies.intensity_scores(
        ledger_store.scan(t.spark, f"{root}/ledger"), rel_stdev_floor=STDEV_FLOOR,
        cohorts=moment_store.cohorts(t.spark, f"{root}/moments")))


@_query
def q_scope_omission(t: Testbed) -> DataFrame:
    return anomalies.omission_flags(anomalies.yearly_scopes(t.tampered())).drop("details_json")


@_query
def q_anomaly_scan(t: Testbed) -> DataFrame:
    return _flags(t).drop("details_json").withColumn("metric", F.round("metric", 6))


@_query
def q_anomaly_list(t: Testbed) -> DataFrame:
    """Open critical flags, most recent period first."""
    flags = audit.list_anomalies(_flags(t), status="OPEN", severity="CRITICAL")
    return audit.page(
        flags.select("flag_id", "entity_id", "reporting_period", "flag_type", "title"),
        [F.desc("reporting_period"), F.asc("flag_id")], limit=50,
    )


@_query
def q_flag_resolution(t: Testbed) -> DataFrame:
    """Auditors decide on the flags of the 1990s, sometimes without giving a reason."""
    flags = _flags(t)
    decisions = flags.where("reporting_period < '2000'").select(
        "flag_id",
        F.when(F.col("severity") == "CRITICAL", F.lit("CONFIRMED")).otherwise(F.lit("DISMISSED"))
        .alias("new_status"),
        F.when(F.col("flag_type") == "YOY_SPIKE", F.lit("ok"))
        .otherwise(F.concat(F.lit("reviewed "), "subject_id")).alias("notes"),
        F.concat(F.lit("auditor of "), "entity_id").alias("actor"),
        F.lit("2025-02-01 00:00:00").cast("timestamp").alias("decided_at"),
    )
    return anomalies.resolve_flags(flags, decisions).select(
        "flag_id", "flag_type", "severity", "status", "resolution_notes", "resolved_by"
    )


@_query
def q_ledger_context(t: Testbed) -> DataFrame:
    context = narrative.ledger_context(t.tampered())
    return context.select(
        "*", narrative.context_text().alias("data_context")
    ).drop("baseline_year").withColumn("ledger_pct_change", F.round(F.col("ledger_pct_change").cast("double"), 6))


def _chosen_baselines(t: Testbed) -> DataFrame:
    """Two years in three have a baseline of their own, neither of them the year before."""
    year = F.col("reporting_year")
    return t.stored_tampered().select("entity_id", F.year("period_start").alias("reporting_year")).distinct(
    ).withColumn("baseline_year", F.when(year % 3 == 1, year - 2).when(year % 3 == 2, F.lit(1995)))


@_query
def q_yoy_chosen(t: Testbed) -> DataFrame:
    """Variance and omission against chosen baselines, with their details."""
    yearly = anomalies.yearly_scopes(t.stored_tampered())
    chosen = _chosen_baselines(t)
    flags = anomalies.yoy_flags(yearly, comparisons=chosen).unionByName(
        anomalies.omission_flags(yearly, chosen))
    return flags.select(
        "entity_id", "reporting_period", "flag_type", "subject_id", "severity", "description",
        F.get_json_object("details_json", "$.baseline_period").alias("baseline_period"),
        F.get_json_object("details_json", "$.prior_tco2e").cast("double").alias("prior_tco2e"),
        F.get_json_object("details_json", "$.current_tco2e").cast("double").alias("current_tco2e"),
    )


@_query
def q_scan_audit(t: Testbed) -> DataFrame:
    """Audit rows of scans against chosen baselines or none."""
    chosen = _chosen_baselines(t)
    flags = anomalies.anomaly_scan(
        t.stored_tampered(), rel_stdev_floor=STDEV_FLOOR, comparisons=chosen)
    scanned = chosen.select("entity_id", F.col("reporting_year").cast("string").alias(
        "reporting_period"), F.col("baseline_year").cast("string").alias("baseline_period"))
    audit_log = anomalies.scan_audit(flags, scanned, F.lit("2025-01-01 00:00:00").cast("timestamp"))
    return audit_log.select(
        "entity_type", "entity_id", "action", "actor",
        *[F.get_json_object("detail", f"$.{c}").alias(c)
          for c in ("current_period", "baseline_period")],
        F.get_json_object("detail", "$.flags_generated").cast("bigint").alias("flags_generated"))


@_query
def q_context_chosen(t: Testbed) -> DataFrame:
    context = narrative.ledger_context(t.stored_tampered(), _chosen_baselines(t))
    return context.select("entity_id", "reporting_year", "baseline_year",
                          narrative.context_text().alias("data_context"))


@_query
def q_narrative_flags(t: Testbed) -> DataFrame:
    """Flags of the narratives that claim too much; every third narrative claims nothing."""
    told = t.narratives().withColumn("narrative", F.when(
        F.col("narrative_id") % 3 == 0, F.lit("We kept our promises.")).otherwise(
        F.col("narrative")))
    context = narrative.ledger_context(t.tampered())
    checked = narrative.check_narratives(told, context)
    flags = narrative.narrative_flags(checked).select(
        "subject_id", "entity_id", "reporting_period", "flag_type", "severity", "status", "metric")
    clean = checked.where("overall_status = 'CLEAN'").select(
        F.col("narrative_id").cast("string").alias("subject_id"), "entity_id",
        F.col("reporting_year").cast("string").alias("reporting_period"),
        F.coalesce("verdict", F.lit("NO_CLAIM")).alias("flag_type"), F.lit("NONE").alias("severity"),
        F.lit("CLEAN").alias("status"), F.col("claimed_pct").alias("metric"))
    return flags.unionByName(clean)


@_query
def q_narrative_claims(t: Testbed) -> DataFrame:
    checked = narrative.check_narratives(
        t.narratives(), narrative.ledger_context(t.tampered())
    )
    return checked.drop("ledger_pct_change")


# -- streaming -------------------------------------------------------------------------


@_query
def q_stream_scope_totals(t: Testbed) -> DataFrame:
    """Scope totals kept up to date by a stream of line items, as its last batch left them."""
    out = f"{checkpoint_root(t.spark)}/stream-totals-{uuid.uuid4()}"
    computed = ingest.calculated(t.activities(t.line_stream()), t.index())
    totals = ingest.running_scope_totals(computed)

    def keep(rows: DataFrame, _batch: int) -> None:
        rows.write.mode("overwrite").parquet(out)

    ingest.upsert_available(totals, f"state-{uuid.uuid4()}", keep, "complete").awaitTermination()
    return t.spark.read.parquet(out)


def _recalculated(rows: DataFrame) -> DataFrame:
    """Calculations of returned items done again: twice the result, and a year later."""
    return rows.where("return_flag = 'R'").withColumns({
        "result_tco2e": (F.col("result_tco2e") * 2).cast("decimal(20,8)"),
        "period_start": F.add_months("period_start", 12)})


@_query
def q_stream_net_totals(t: Testbed) -> DataFrame:
    """Scope totals after a stream of calculations, of which those of returned items come again
    with new results, and those of accepted items arrive twice."""
    folder = f"{checkpoint_root(t.spark)}/net-totals-{uuid.uuid4()}"
    runs = t.computed().select(
        "activity_id", "calculation_id", F.col("created_at").alias("computed_at"), "entity_id",
        "period_start", "scope", "result_tco2e", "calc_status", "return_flag")
    runs.write.parquet(f"{folder}/runs")
    first = t.spark.read.parquet(f"{folder}/runs")
    again = _recalculated(first).withColumns({
        "calculation_id": F.md5(F.concat("calculation_id", F.lit("|2"))),
        "computed_at": F.col("computed_at") + F.expr("INTERVAL 1 DAY")})
    arrivals = (first, again.unionByName(first.where("return_flag = 'A'")))
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = t.spark.readStream.schema(first.schema).parquet(f"{folder}/in")
        retraction.keep_differences(stream, f"{folder}/out", folder.rsplit("/", 1)[1]
                                    ).awaitTermination()
    return retraction.net_scope_totals(t.spark, f"{folder}/out")


@_query
def q_ledger_versions(t: Testbed) -> DataFrame:
    """Yearly totals of a stored ledger before and after the results of returned items were
    replaced, each from its own version."""
    path = f"{checkpoint_root(t.spark)}/ledger-versions-{uuid.uuid4()}"
    ledger_store.append(t.ledger("return_flag"), path)
    stored = ledger_store.scan(t.spark, path, version=1)
    ledger_store.replace_rows(
        t.spark, _recalculated(stored).drop(*ledger_store.PARTITIONS), path, "activity_id")
    versions = [ledger_store.scan(t.spark, path, version=v).withColumn("version", F.lit(v))
                for v in (1, 2)]
    return versions[0].union(versions[1]).groupBy(
        "version", "entity_id", F.year("period_start").alias("reporting_year")).agg(
        F.sum("result_tco2e").cast(inventory.TOTAL).alias("total_tco2e"),
        F.count("*").alias("activity_count"))


# -- scenarios and suppliers -----------------------------------------------------------


def _scenarios(t: Testbed) -> DataFrame:
    """Two scenarios per nation's companies: each segment, years in and out of the data."""
    levers = (
        "SOLAR_PPA_GRID_ELEC", "HEAT_PUMP_RETROFIT", "BUSINESS_TRAVEL_MODAL_SHIFT",
        "SUPPLY_CHAIN_ENGAGEMENT", "EV_FLEET_TRANSITION", "NO_SUCH_LEVER",
    )
    n = F.col("c_nationkey")
    base = t.table("customer").groupBy("c_mktsegment", "c_nationkey").agg(
        F.max("c_acctbal").alias("richest")
    )
    return base.select(
        F.concat(F.lit("sc-"), n.cast("string")).alias("scenario_id"),
        F.col("c_mktsegment").alias("entity_id"),
        F.when(n % 5 == 4, F.lit("2050")).when(n % 5 == 3, F.lit("1999-Q3"))
        .otherwise((n % 5 + 1996).cast("string")).alias("reporting_period"),
        F.posexplode(F.array(*[F.lit(x) for x in levers])).alias("request_idx", "lever_id"),
        n.alias("_n"), "richest",
    ).select(
        "scenario_id", "entity_id", "reporting_period", "request_idx", "lever_id",
        ((F.col("_n") % 4 + 1) * F.lit(0.25)).cast("decimal(7,6)").alias("implementation_rate"),
        F.when(F.col("request_idx") == 1, F.col("richest").cast("decimal(20,4)"))
        .alias("custom_capex_usd"),
        F.when(F.col("request_idx") == 2, F.lit(500).cast("decimal(20,4)"))
        .alias("custom_annual_opex_delta_usd"),
    )


@_query
def q_macc(t: Testbed) -> DataFrame:
    return scenario.simulate(t.ledger(), _scenarios(t))


@_query
def q_scenario_total(t: Testbed) -> DataFrame:
    impacts = scenario.simulate(t.ledger(), _scenarios(t))
    targets = impacts.select(*scenario.SCENARIO).distinct().withColumn(
        "target_reduction_percent", F.lit(20).cast("decimal(7,4)")
    )
    return scenario.scenario_totals(impacts, targets)


@_query
def q_supplier_gaps(t: Testbed) -> DataFrame:
    return suppliers.supplier_gaps(t.ledger())


@_query
def q_outreach_drafts(t: Testbed) -> DataFrame:
    gaps = suppliers.supplier_gaps(t.ledger())
    requests = gaps.select(
        *suppliers.GAP,
        F.when(F.col("line_item_count") > 1, F.concat(F.lit("Supplier "), "supplier_ref"))
        .alias("supplier_name"),
        F.when(F.col("activity_type") == "freight_road", F.lit("REDUCTION_PLEDGE"))
        .when(F.col("reporting_period") < "1998", F.lit("ACTIVITY_DATA_VERIFICATION"))
        .otherwise(F.lit("PRIMARY_EMISSION_FACTOR")).alias("template_type"),
        F.when(F.col("line_item_count") > 3, F.concat(F.lit("Urgent: "), "supplier_ref"))
        .alias("custom_subject"),
        F.lit(None).cast("string").alias("custom_body"),
    )
    return suppliers.outreach_drafts(requests).drop("supplier_email", "contact_name")


@_query
def q_outreach_audit(t: Testbed) -> DataFrame:
    """Every outreach of a supplier's main gap is drafted to a recipient, sent, and answered by
    some; each step leaves its audit row."""
    gaps = suppliers.supplier_gaps(t.ledger())
    drafts = suppliers.outreach_drafts(gaps.select(
        *suppliers.GAP, F.lit(None).cast("string").alias("supplier_name"),
        F.concat(F.lit("esg@"), F.lower("supplier_ref"), F.lit(".example")).alias("supplier_email"),
        F.concat(F.lit("Desk of "), "entity_id").alias("contact_name"),
        F.lit("REDUCTION_PLEDGE").alias("template_type"),
        F.lit(None).cast("string").alias("custom_subject"),
        F.lit(None).cast("string").alias("custom_body")))
    steps = F.filter(
        F.array(F.lit("CREATE"), F.lit("SEND"),
                F.when(F.col("entity_id") == "BUILDING", F.lit("RESPOND"))),
        lambda x: x.isNotNull())
    answered = F.col("action") == "RESPOND"
    actions = drafts.select("outreach_id", F.posexplode(steps).alias("nth", "action")).select(
        "outreach_id", "action",
        F.expr("timestamp'2025-03-01 08:00:00' + make_interval(0, 0, 0, nth)").alias("action_ts"),
        F.when(answered, F.lit("0.25")).alias("primary_factor_value"),
        F.when(answered, F.lit("kgCO2e/kg")).alias("primary_factor_unit"),
        F.when(answered, F.lit("100")).alias("verified_quantity"),
        F.when(answered, F.lit("audited")).alias("response_notes"))
    log = suppliers.outreach_audit(actions, drafts)
    return log.join(drafts.select(F.col("outreach_id").alias("entity_id"), "contact_name"),
                    "entity_id")


@_query
def q_outreach_state(t: Testbed) -> DataFrame:
    return suppliers.outreach_state(t.outreach_actions())

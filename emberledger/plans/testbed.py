"""A carbon ledger derived from the TPC-H-like test tables.

Line items become activities, customers' market segments the reporting entities, part types
the activity types, suppliers the places. Nothing is generated: every row comes from a row of
the given tables, so all work grows with them.
"""

from __future__ import annotations

from functools import cached_property
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberledger import schemas
from emberledger.constants import KNOWN_UTILITIES
from emberledger.functions.tokens import tokenize_supplier
from emberledger.operators.classification import classify
from emberledger.operators.bounds import fixed_table, settled
from emberledger.operators.emissions import compute
from emberledger.operators.factors import FactorIndex
from emberledger.operators.ledger import ledger_of

# id | source | version | type | geography | unit | value | factor unit | published | from | to
_FACTORS = """
EL-CA-1 | EPA_GHG_Hub | 1995 | electricity_purchase | US-CA | kWh | 0.2154 | kgCO2e/kWh | 1994-12-01 | 1995-01-01 | 1998-12-31
EL-CA-2 | EPA_GHG_Hub | 1999 | electricity_purchase | US-CA | kWh | 0.1982 | kgCO2e/kWh | 1999-01-01 | 1999-01-01 |
EL-US-1 | EPA_GHG_Hub | 1996 | electricity_purchase | US | kWh | 0.3859 | kgCO2e/kWh | 1996-01-01 | 1996-01-01 |
EL-US-2 | EPA_GHG_Hub | 1998 | electricity_purchase | US | kWh | 0.3712 | kgCO2e/kWh | 1998-06-01 | 1998-03-01 | 2000-06-30
EL-GB-1 | DEFRA | 1996 | electricity_purchase | GB | kWh | 0.20493 | kgCO2e/kWh | 1996-06-01 | 1996-01-01 |
NG-US-1 | EPA_GHG_Hub | 1995 | natural_gas_combustion | US | MMBtu | 53.06 | kgCO2e/MMBtu | 1995-01-01 | 1995-01-01 |
GA-US-1 | EPA_GHG_Hub | 1995 | mobile_combustion_gasoline | US | gallons | 8.78 | kgCO2e/gallon | 1995-01-01 | 1995-01-01 | 2000-12-31
AI-GL-1 | DEFRA | 1995 | business_travel_air | GLO | passenger.km | 0.158 | kgCO2e/passenger.km | 1995-06-01 | 1995-01-01 |
FR-GB-1 | DEFRA | 1995 | freight_road | GB | tonne.km | 0.10421 | kgCO2e/tonne.km | 1995-06-01 | 1995-01-01 |
RF-GL-1 | EPA_GHG_Hub | 1995 | refrigerant_leakage_r410a | GLO | kg | 2088 | kgCO2e/kg | 1995-01-01 | 1995-01-01 |
"""
FACTORS = [
    tuple(p.strip() or None for p in ln.split("|")) for ln in _FACTORS.split("\n") if ln
]

# Part type -> activity type, and its units by line number modulo 3.
ACTIVITY_OF_PART = {
    "ECONOMY": ("electricity_purchase", ("kWh", "MWh", "kWh")),
    "LARGE": ("natural_gas_combustion", ("MMBtu", "therms", "ccf")),
    "MEDIUM": ("mobile_combustion_gasoline", ("gallons", "liters", "gal")),
    "PROMO": ("business_travel_air", ("passenger.km", "passenger.miles", "p.km")),
    "SMALL": ("freight_road", ("tonne.km", "ton.miles", "tonne.km")),
    "STANDARD": ("office_supplies", ("USD", "USD", "USD")),
}
PLACES = ("US-CA", "US-TX", "GB", "US", "FR")

_INDEXES: WeakKeyDictionary[SparkSession, FactorIndex] = WeakKeyDictionary()


def flat(df: DataFrame) -> DataFrame:
    """Plain types for comparison: text, bigint, double and boolean."""
    out = []
    for field in df.schema.fields:
        kind, c = field.dataType.typeName(), F.col(field.name)
        if kind in ("decimal", "float"):
            c = c.cast("double")
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        elif kind == "date":
            c = c.cast("string")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(field.name))
    return df.select(*out)


def line_id() -> Column:
    """Identity of a line item: its keys and its date are unique together."""
    return F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.date_format("l_shipdate", "yyyyMMdd"),
    )


class Testbed:
    """Ledger tables over one directory of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def factors(self) -> DataFrame:
        columns = [c.split()[0] for c in schemas.EMISSION_FACTOR.split(", ")]
        return fixed_table(self.spark, FACTORS, columns).select(
            "factor_id", "source", "source_version", "activity_type", "geography", "unit",
            F.col("factor_value").cast(schemas.FACTOR_VALUE).alias("factor_value"),
            "factor_unit",
            *[F.col(c).cast("date").alias(c)
              for c in ("published_date", "effective_from", "effective_to")],
        )

    def index(self) -> FactorIndex:
        """Built once per session, as a service over a factor table would."""
        if self.spark not in _INDEXES:
            _INDEXES[self.spark] = FactorIndex.build(self.factors())
        return _INDEXES[self.spark]

    def line_stream(self) -> DataFrame:
        """The line items as a stream of arriving files."""
        schema = self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet").schema
        files = self.spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet")
        return files.parquet(self.sf_dir)

    def activities(self, lines: DataFrame | None = None) -> DataFrame:
        lines = self.table("lineitem") if lines is None else lines
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        customers = self.table("customer").select("c_custkey", "c_mktsegment")
        parts = self.table("part").select("p_partkey", "p_type")
        suppliers = self.table("supplier").select(
            "s_suppkey", "s_nationkey", tokenize_supplier(F.col("s_name")).alias("supplier_ref")
        )
        kind, unit = F, F
        third = F.col("l_linenumber") % 3
        for part, (activity, units) in ACTIVITY_OF_PART.items():
            kind = kind.when(F.col("p_type") == part, F.lit(activity))
            unit = unit.when(
                F.col("p_type") == part,
                F.when(third == 0, units[0]).when(third == 1, units[1]).otherwise(units[2]),
            )
        place = F
        for n, name in enumerate(PLACES):
            place = place.when(F.col("s_nationkey") % len(PLACES) == n, F.lit(name))
        start = F.col("l_shipdate").cast("date")
        # Orders meet their customers first: they are fewer and narrower than their line items.
        placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        return (
            lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                line_id().alias("activity_id"),
                F.concat(F.lit("doc-"), F.col("o_custkey").cast("string"))
                .alias("source_document_id"),
                F.concat(F.lit("L-"), F.col("l_linenumber").cast("string")).alias("raw_line_ref"),
                F.col("c_mktsegment").alias("entity_id"),
                kind.alias("activity_type"),
                F.col("l_quantity").cast(schemas.QUANTITY).alias("quantity"),
                F.when(F.col("l_linenumber") == 7, F.lit("kg")).otherwise(unit).alias("unit"),
                place.alias("geography"),
                start.alias("period_start"),
                F.date_add(start, 29).alias("period_end"),
                "supplier_ref",
                F.col("l_shipdate").cast("timestamp").alias("created_at"),
                F.col("l_returnflag").alias("return_flag"),
                F.col("l_linestatus").alias("line_status"),
                "l_discount", "l_tax", "l_linenumber",
            )
        )

    def classified(self) -> DataFrame:
        return classify(self.activities())

    def computed(self) -> DataFrame:
        return compute(self.classified(), self.index())

    def ledger(self, *extra: str) -> DataFrame:
        return ledger_of(self.computed(), *extra)

    def stored_tampered(self) -> DataFrame:
        """The tampered ledger as the table that reports of several passes read: settled once."""
        return self._stored_tampered

    @cached_property
    def _stored_tampered(self) -> DataFrame:
        return settled(self.tampered(), "ledger")

    def tampered(self) -> DataFrame:
        """Ledger with planted anomalies: a drop, a surge, an omission and outliers."""
        year, end = F.year("period_start"), F.year("period_end")
        rows = self.ledger("l_discount", "l_tax", "l_linenumber").where(
            ~((F.col("entity_id") == "FURNITURE")
              & (F.col("activity_type") == "natural_gas_combustion")  # all of its scope 1
              & ((year == 1999) | (end == 1999)))
        )

        def where(entity: str, y: int, scope: int) -> Column:
            return (F.col("entity_id") == entity) & (year == y) & (F.col("scope") == scope)

        times = (
            F.when(where("BUILDING", 1998, 3), F.lit("0.2"))
            .when(where("MACHINERY", 1997, 2), F.lit("4.0"))
            .when((F.col("l_discount") >= 0.095) & (F.col("l_tax") >= 0.075)
                  & (F.col("l_linenumber") == 1), F.lit("40.0"))
            .otherwise(F.lit("1.0"))
            .cast("decimal(3,1)")
        )
        return rows.withColumn(
            "result_tco2e", (F.col("result_tco2e") * times).cast(schemas.TCO2E)
        ).drop("l_discount", "l_tax", "l_linenumber")

    def documents(self) -> DataFrame:
        """Source documents: one export per customer, in the segment of the customer."""
        return self.table("customer").select(
            F.concat(F.lit("doc-"), F.col("c_custkey").cast("string")).alias("document_id"),
            F.col("c_mktsegment").alias("entity_id"),
            F.concat(F.lower("c_name"), F.lit(".csv")).alias("filename"),
            F.when(F.col("c_acctbal") < 0, F.lit("failed")).otherwise(F.lit("completed"))
            .alias("status"),
        )

    def audit_log(self) -> DataFrame:
        """Events about documents: event n concerns the document of customer n."""
        return self.table("events").select(
            F.lit("source_document").alias("entity_type"),
            F.concat(F.lit("doc-"), F.col("event_id").cast("string")).alias("entity_id"),
            F.upper("event_type").alias("action"),
            F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor"),
            F.col("ts").cast("timestamp").alias("event_ts"),
            F.col("props").alias("detail"),
            "event_id",
        )

    def review_decisions(self) -> DataFrame:
        """Decisions on returned line items: gasoline is mobile combustion; the decision for
        office supplies names a category of another scope and is therefore invalid."""
        return self.activities().where("return_flag = 'A'").where(
            F.col("activity_type").isin("mobile_combustion_gasoline", "office_supplies")
        ).select(
            "activity_id",
            F.when(F.col("activity_type") == "office_supplies", 3).otherwise(1).alias("scope"),
            F.lit("mobile_combustion").alias("ghg_category"),
            F.concat(F.lit("rev-"), F.substring("supplier_ref", 12, 4)).alias("reviewer_id"),
            F.col("created_at").alias("decided_at"),
            F.concat(F.lit("line "), "raw_line_ref").alias("notes"),
        )

    def disclosure_requests(self, activities: DataFrame | None = None) -> DataFrame:
        """The GHG Protocol inventory of every entity and year with final line items."""
        rows = self.activities() if activities is None else activities
        return (
            rows.where("line_status = 'F'")
            .select("entity_id", F.lit("GHG_PROTOCOL").alias("framework"),
                    F.year("period_start").cast("string").alias("reporting_period"))
            .distinct()
        )

    def disclosure_lines(self, ledger: DataFrame | None = None) -> DataFrame:
        """Final line items are cited by the disclosure of their entity and year."""
        rows = self.ledger("line_status") if ledger is None else ledger
        return rows.where("line_status = 'F'").select(
            F.md5(
                F.concat_ws("|", "entity_id", F.lit("GHG_PROTOCOL"),
                            F.year("period_start").cast("string"))
            ).alias("disclosure_id"),
            "calculation_id",
        )

    def profiles(self) -> DataFrame:
        """Customers as companies."""
        balance = F.col("c_acctbal").cast("decimal(14,2)")
        return self.table("customer").select(
            F.col("c_name").alias("entity_id"),
            (F.abs(balance) * 200000).cast("decimal(20,2)").alias("annual_revenue_usd"),
            (F.col("c_nationkey") % 3 == 0).alias("does_business_in_california"),
            (F.abs(balance) * 30000).cast("decimal(20,2)").alias("eu_net_turnover_eur"),
            (F.abs(balance) * 5000).cast("decimal(20,2)").alias("balance_sheet_total_eur"),
            (F.col("c_custkey") % 500).cast("int").alias("employee_count"),
            (F.col("c_nationkey") % 2 == 0).alias("is_eu_parent"),
        )

    def bills(self) -> DataFrame:
        """Bills: a first page of typical bill lines, then the whole text of a document."""
        n = F.col("doc_id")
        names = F.array(*[F.lit(u) for u in KNOWN_UTILITIES])
        month = F.lpad((n % 12 + 1).cast("string"), 2, "0")
        lines = F.concat_ws(
            "\n",
            F.when(
                n % 7 == 0,
                F.concat(F.lit("Supplier: Regional Fuel Depot "), n.cast("string")),
            ).otherwise(F.element_at(names, (n % len(KNOWN_UTILITIES) + 1).cast("int"))),
            F.concat(F.lit("Account Number: 98"), n.cast("string"), F.lit("-1104")),
            F.when(n % 4 == 0, F.concat(F.lit("Billing Period: 2025-"), month, F.lit("-01 to 2025-"),
                                        month, F.lit("-28")))
            .when(n % 4 == 1, F.concat(F.lit("Service Dates: "), month, F.lit("/01/2025 - "), month,
                                       F.lit("/28/2025")))
            .when(n % 4 == 2, F.concat(F.lit("Invoice Date: 2025-"), month, F.lit("-15")))
            .otherwise(F.lit("Charges of the current cycle")),
            F.when(n % 3 == 0, F.lit("1 Main Street, Oakland, CA 94607"))
            .when(n % 3 == 1, F.concat(F.lit("Region: US-TX")))
            .otherwise(F.lit("Oxford Street")),
            F.concat(F.lit("Total Electricity Usage: 1,"), F.lpad((n % 1000).cast("string"), 3, "0"),
                     F.lit(".50 kWh @ $0.15 / kWh = $217.58")),
            F.concat(F.lit("Usage (therms): "), (n % 90 + 5).cast("string"), F.lit(".25")),
            F.concat(F.lit("Diesel: "), (n % 50 + 1).cast("string"), F.lit(" gallons and "),
                     (n % 70 + 2).cast("string"), F.lit(" tonne.km")),
            F.lit("Total Amount Due: $1,250.00"),
        )
        return self.table("documents").select(
            "doc_id", F.array(lines, F.col("text")).alias("pages")
        )

    def narratives(self) -> DataFrame:
        """Whole documents followed by a claim, as reports of the segments."""
        segments = F.array(
            *[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]
        )
        n = F.col("doc_id")
        return self.table("documents").select(
            n.alias("narrative_id"),
            F.element_at(segments, (n % 5 + 1).cast("int")).alias("entity_id"),
            (n % 6 + 1996).cast("int").alias("reporting_year"),
            F.concat(
                F.col("text"), F.lit("\nIn the past year we achieved a "),
                (n % 60).cast("string"), F.lit("% reduction of our footprint."),
            ).alias("narrative"),
        )

    def outreach_actions(self) -> DataFrame:
        """Events as outreach actions on the campaign of their user."""
        kind = F.col("event_type")
        action = (
            F.when(kind == "purchase", F.lit("RESPOND"))
            .when(kind.isin("click", "view"), F.lit("SEND"))
            .otherwise(F.lit("CREATE"))
        )
        return self.table("events").select(
            F.concat(F.lit("out-"), F.col("user_id").cast("string")).alias("outreach_id"),
            action.alias("action"), F.col("ts").alias("action_ts"),
            F.col("event_id").alias("action_id"),
            F.col("value").cast("decimal(20,8)").alias("primary_factor_value"),
            F.lit("kgCO2e/kg").alias("primary_factor_unit"),
            F.get_json_object("props", "$.k").cast("decimal(20,6)").alias("verified_quantity"),
            F.col("props").alias("response_notes"),
        )

    @cached_property
    def as_of(self) -> Column:
        return F.lit("2025-12-31").cast("date")

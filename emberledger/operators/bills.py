"""Activity rows from the text of utility bills.

Input is a table of documents with ``pages array<string>`` (the text of each page).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberledger.constants import (
    ACCOUNT_LABEL_PATTERN,
    ACCOUNT_STANDALONE_PATTERN,
    BARE_PERIOD_PATTERN,
    BILL_UNIT_PATTERN,
    BILL_UNITS,
    DEFAULT_GEOGRAPHY,
    HEADER_SUPPLIER_PATTERN,
    KNOWN_UTILITIES,
    LABELLED_PERIOD_PATTERN,
    QTY_THEN_UNIT_PATTERN,
    REGION_LABEL_PATTERN,
    SINGLE_DATE_PATTERN,
    STATE_ZIP_PATTERN,
    UNIT_THEN_QTY_PATTERN,
    US_STATES,
)
from emberledger.functions.dates import parse_date
from emberledger.functions.patterns import any_of
from emberledger.functions.text import bind, strip
from emberledger.functions.tokens import tokenize_account, tokenize_supplier

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def detect_provider_name(text: Column, custom: Sequence[str] = ()) -> Column:
    """Longest known provider named anywhere in the text, else the one a header line names.

    The lookahead lets names be found at every word, also inside one another, so that the
    choice is by length alone. Null when there is neither.
    """
    ordered = sorted([*custom, *sorted(KNOWN_UTILITIES, key=len, reverse=True)],
                     key=len, reverse=True)
    lowered = [n.lower() for n in ordered]
    hits = F.regexp_extract_all(text, F.lit(rf"(?i)\b(?=({any_of(ordered)})\b)"), F.lit(1))
    names = F.array(*[F.lit(n) for n in lowered])
    ranked = F.transform(
        F.array_distinct(hits),
        lambda h: F.struct(
            F.length(h).alias("size"), (-F.array_position(names, F.lower(h))).alias("place"),
            h.alias("name"),
        ),
    )
    header = strip(F.regexp_extract(text, HEADER_SUPPLIER_PATTERN, 1))
    return F.coalesce(F.array_max(ranked)["name"], F.nullif(header, F.lit("")))


def detect_provider(text: Column, custom: Sequence[str] = ()) -> Column:
    return tokenize_supplier(detect_provider_name(text, custom))


def detect_account(text: Column) -> Column:
    """First labelled identifier, else first prefixed one, as a token; null without either."""
    raw = F.coalesce(
        F.nullif(F.regexp_extract(text, ACCOUNT_LABEL_PATTERN, 2), F.lit("")),
        F.nullif(F.regexp_extract(text, ACCOUNT_STANDALONE_PATTERN, 0), F.lit("")),
    )
    return F.when(raw.isNotNull(), tokenize_account(raw))


def detect_geography(text: Column, default: str = DEFAULT_GEOGRAPHY) -> Column:
    """Labelled region of up to 16 characters, else the state before a zip code."""
    region = F.upper(F.regexp_extract(text, REGION_LABEL_PATTERN, 1))
    fits = (region != "") & (
        region.isin(*US_STATES) | F.startswith(region, F.lit("US-")) | (F.length(region) <= 16)
    )
    state = F.regexp_extract(text, STATE_ZIP_PATTERN, 1)
    return (
        F.when(fits, region).when(state.isin(*US_STATES), state).otherwise(F.lit(default))
    )


def _range(text: Column, pattern: str, pivot_year: int) -> Column:
    found = F.struct(
        parse_date(F.regexp_extract(text, pattern, 1), pivot_year).alias("start"),
        parse_date(F.regexp_extract(text, pattern, 2), pivot_year).alias("end"),
    )
    return bind(found, lambda r: F.when(r["start"].isNotNull() & r["end"].isNotNull(), r))


def detect_period(text: Column, as_of: Column, pivot_year: int = 2025) -> Column:
    """Labelled period, else a single labelled date, else any range, else ``as_of``."""
    def day(d: Column) -> Column:
        return F.when(d.isNotNull(), F.struct(d.alias("start"), d.alias("end")))

    return F.coalesce(
        _range(text, LABELLED_PERIOD_PATTERN, pivot_year),
        bind(parse_date(F.regexp_extract(text, SINGLE_DATE_PATTERN, 1), pivot_year), day),
        _range(text, BARE_PERIOD_PATTERN, pivot_year),
        F.struct(as_of.alias("start"), as_of.alias("end")),
    )


def detect_line_period(line: Column, pivot_year: int = 2025) -> Column:
    """Period named on the line itself; null if there is none or it cannot be read."""
    return F.when(
        F.rlike(line, F.lit(LABELLED_PERIOD_PATTERN)),
        _range(line, LABELLED_PERIOD_PATTERN, pivot_year),
    ).otherwise(_range(line, BARE_PERIOD_PATTERN, pivot_year))


def _readings(text: Column, pattern: str, quantity_group: int, unit_group: int) -> Column:
    def groups(g: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(g))

    return F.zip_with(
        groups(quantity_group), groups(unit_group),
        lambda q, u: F.struct(
            F.replace(q, F.lit(","), F.lit("")).try_cast("decimal(20,6)").alias("quantity"),
            F.lower(strip(u)).alias("spelling"),
        ),
    )


def consumption_readings(line: Column) -> Column:
    """Readings of a line: ``<qty> <unit>`` first, then ``<unit>: <qty>`` in what is left.

    What the first pattern matched is blotted out with a control character before the second
    one runs, which keeps their matches from overlapping.
    """
    rest = F.regexp_replace(line, QTY_THEN_UNIT_PATTERN, "\u0001")
    return F.concat(
        _readings(line, QTY_THEN_UNIT_PATTERN, 1, 2), _readings(rest, UNIT_THEN_QTY_PATTERN, 2, 1)
    )


def bill_units() -> tuple[Column, Column]:
    """(canonical unit, activity type) maps by spelling."""
    def as_map(position: int) -> Column:
        return F.create_map(*[F.lit(x) for row in BILL_UNITS for x in (row[0], row[position])])

    return as_map(1), as_map(2)


def bill_header(
    bills: DataFrame,
    as_of: Column,
    default_geography: str = DEFAULT_GEOGRAPHY,
    known_suppliers: Sequence[str] = (),
    pivot_year: int = 2025,
) -> DataFrame:
    """Provider, account, period and place of each bill, from the text of all its pages."""
    text = F.array_join("pages", "\n")
    return bills.withColumn("_full", text).withColumns(
        {
            "supplier_ref": detect_provider(F.col("_full"), known_suppliers),
            "account_ref": detect_account(F.col("_full")),
            "geography": detect_geography(F.col("_full"), default_geography),
            "_period": detect_period(F.col("_full"), as_of, pivot_year),
        }
    ).drop("_full")


def bill_lines(headed: DataFrame, key: str = "doc_id", pivot_year: int = 2025) -> DataFrame:
    """Activity rows of bills that went through :func:`bill_header`."""
    pages = headed.select(
        key, "supplier_ref", "account_ref", "geography", "_period",
        F.posexplode("pages").alias("_page", "_text"),
    )
    lines = pages.select(
        "*", F.posexplode(F.split("_text", LINE_BREAK, -1)).alias("_line", "_raw")
    ).drop("_text").withColumn("_raw", strip(F.col("_raw")))
    # Every reading has a digit and a unit: most lines of a text are passed over for less.
    lines = lines.where(F.rlike("_raw", F.lit(r"\d"))).where(
        F.rlike("_raw", F.lit(rf"(?i)(?:{BILL_UNIT_PATTERN})")))
    unit_of, activity_of = bill_units()
    found = lines.select(
        "*", F.posexplode(consumption_readings(F.col("_raw"))).alias("_n", "_r")
    ).where(F.col("_r.quantity").isNotNull() & unit_of[F.col("_r.spelling")].isNotNull())
    own = detect_line_period(F.col("_raw"), pivot_year)
    return found.withColumn("_own", own).select(
        key,
        F.concat(F.lit("page:"), (F.col("_page") + 1).cast("string"), F.lit(",line:"),
                 (F.col("_line") + 1).cast("string")).alias("raw_line_ref"),
        (F.col("_n") + 1).alias("reading_no"),
        activity_of[F.col("_r.spelling")].alias("activity_type"),
        F.col("_r.quantity").alias("quantity"),
        unit_of[F.col("_r.spelling")].alias("unit"),
        "geography",
        F.coalesce("_own.start", "_period.start").alias("period_start"),
        F.coalesce("_own.end", "_period.end").alias("period_end"),
        "supplier_ref", "account_ref",
    )

"""Spark schemas of the ledger tables."""

from __future__ import annotations

from pyspark.sql import types as T

QUANTITY = T.DecimalType(20, 6)
FACTOR_VALUE = T.DecimalType(20, 8)
TCO2E = T.DecimalType(20, 8)


# DDL texts: every reader and createDataFrame accepts them as they are.
SOURCE_DOCUMENT = (
    "id string, entity_id string, filename string, file_type string, file_size_bytes bigint, "
    "file_hash_sha256 string, storage_path string, status string, error_message string, "
    "column_mapping map<string,string>, rows_created bigint, created_at timestamp, "
    "processed_at timestamp"
)
ACTIVITY = (
    "activity_id string, source_document_id string, raw_line_ref string, entity_id string, "
    "activity_type string, quantity decimal(20,6), unit string, geography string, "
    "period_start date, period_end date, supplier_ref string, scope int, ghg_category string, "
    "classification_confidence double, status string, created_at timestamp"
)
EMISSION_FACTOR = (
    "factor_id string, source string, source_version string, activity_type string, "
    "geography string, unit string, factor_value decimal(20,8), factor_unit string, "
    "published_date date, effective_from date, effective_to date"
)
CALCULATION = (
    "calculation_id string, activity_id string, factor_id string, formula_applied string, "
    "result_tco2e decimal(20,8), computed_by string, computed_at timestamp"
)
DISCLOSURE = (
    "disclosure_id string, entity_id string, framework string, reporting_period string, "
    "status string, generated_document_ref string, line_item_refs array<string>"
)
AUDIT_LOG = (
    "entity_type string, entity_id string, action string, actor string, event_ts timestamp, "
    "detail string"
)
ANOMALY_FLAG = (
    "flag_id string, entity_id string, reporting_period string, flag_type string, "
    "severity string, title string, description string, status string, details_json string, "
    "resolution_notes string, resolved_by string, resolved_at timestamp"
)
SUPPLIER_OUTREACH = (
    "outreach_id string, entity_id string, supplier_ref string, supplier_name string, "
    "supplier_email string, contact_name string, activity_type string, "
    "reporting_period string, status string, template_type string, subject string, "
    "body string, response_data_json string, sent_at timestamp, responded_at timestamp"
)
# Factor files keep numbers as text so that no decimal digit is lost on the way in.
FACTOR_FILE = (
    "source string, source_version string, activity_type string, geography string, "
    "unit string, factor_value string, factor_unit string, published_date string, "
    "effective_from string, effective_to string"
)

"""Fixed schemas: target tables, rules, issues, manifest, enums.

The ten delivery tables bind positionally, so the column order below *is*
the file layout.  Each column carries its SQL type so the typed load can
check width, numeric shape and timestamps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TRACKING_COLUMNS = ("batch_id", "row_number", "loaded_at")

# Status, severity and issue-type vocabularies.
MANIFEST_STATUSES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED", "CANCELLED", "DUPLICATE")
SEVERITIES = ("INFO", "WARNING", "ERROR", "CRITICAL")
ISSUE_TYPES = (
    "EXCESS_TABS", "INSUFFICIENT_TABS", "CONTROL_CHARACTERS", "NON_LATIN_CHARACTERS",
    "CONSECUTIVE_REPLACED_CHARS", "DATA_TRANSFORMATION", "EMPTY_REQUIRED_FIELD",
    "DATA_TYPE_MISMATCH", "LENGTH_VIOLATION", "ENCODING_ERROR", "OTHER",
)
QUALITY_STATUSES = ("CLEAN", "CORRECTED", "WITH_WARNINGS", "WITH_ERRORS", "REJECTED")


@dataclass(frozen=True)
class Col:
    """One target column: name, SQL kind, width/scale, NOT NULL."""
    name: str
    kind: str            # varchar | text | numeric | numeric38 | ts0
    width: int | None = None
    required: bool = False

    @property
    def spark_type(self) -> T.DataType:
        if self.kind in ("varchar", "text"):
            return T.StringType()
        if self.kind == "numeric":
            return T.DecimalType(38, 10)
        if self.kind == "numeric38":
            return T.DecimalType(38, 0)
        if self.kind == "ts0":
            return T.TimestampNTZType()
        raise ValueError(self.kind)


def _v(name, n, req=False):
    return Col(name, "varchar", n, req)


def _ts(name):
    return Col(name, "ts0")


def _num(name):
    return Col(name, "numeric")


# The ten target table layouts (data columns, in file order).
TABLES: dict[str, tuple[Col, ...]] = {
    "pm1": (
        _v("block_num", 5, True), _v("property_id_num", 4, True), _v("registration_system_code", 1),
        _v("property_type_code", 1), _ts("last_update_date"), _v("interest_code", 6),
        _v("qualifier_code", 6), _v("origin_code", 1), _v("status_code", 1), _v("parent_block", 5),
        _v("parent_property_id", 4), _num("parent_count"), _v("child_from_block", 5),
        _v("child_from_property", 4), _v("child_to_block", 5), _v("child_to_property", 4),
        _v("polaris_restriction_ind", 1),
    ),
    "pm2": (
        _v("block_num", 5, True), _v("property_id_num", 4, True), _v("lro_num", 2, True),
        _v("instrument_num", 10, True), _v("rule_out_ind", 1), Col("seq_id", "numeric38"),
    ),
    "pm3": (
        _v("block_num", 5, True), _v("property_id_num", 4, True), _v("alt_party_id_code", 6),
        _v("alt_party_name", 128), _v("owner_capacity_code", 6), _v("ownership_share_desc", 12),
        _v("owner_name", 128), _ts("alt_party_b_day"),
    ),
    "pm4": (
        _v("block_num", 5, True), _v("property_id_num", 4, True), _v("parent_block_num", 5, True),
        _v("parent_property_id_num", 4, True),
    ),
    "pm5": (
        _v("block_num", 5, True), _v("property_id_num", 4, True), Col("thumbnail_desc", "text"),
    ),
    "pm6": (
        _v("block_num", 5, True), _v("property_id_num", 4, True), _v("comment_desc", 255),
    ),
    "pm7": (
        _v("block_num", 5, True), _v("property_id_num", 4, True), _v("assessment_num", 15),
        _v("municipality_name", 24), _v("postal_region_name", 26), _num("street_num"),
        _v("street_suffix", 6), _v("street_name", 34), _v("unit_num", 6), _v("unit_type_code", 6),
    ),
    "im1": (
        _v("lro_num", 2, True), _v("instrument_num", 10, True), _ts("registration_date"),
        _v("interest_code", 6), _v("qualifier_code", 6), _v("ref_charge_instr_num", 10),
        _v("ref_assignment_instr_num", 10), _num("consideration_amt"), _ts("last_update_date"),
        _v("instrument_selection_code", 1), _v("instrument_sub_type_code", 8),
        _v("origin_ind_code", 1), _v("instrument_registration_stage", 1),
    ),
    "im2": (
        _v("lro_num", 2, True), _v("instrument_num", 10, True), _v("to_from_ind", 1),
        _ts("party_b_day"), _v("qualifier_code", 6), _v("qualifier_name", 128),
        _v("capacity_code", 6), _v("im_share", 12), _v("name", 128),
    ),
    "im3": (
        _v("lro_num", 2, True), _v("instrument_num", 10, True), _v("comment_desc", 255),
    ),
}


def table_columns(table: str) -> tuple[Col, ...]:
    """Ordered data columns of a registered table (error if unknown)."""
    key = (table or "").lower()
    if key not in TABLES:
        raise KeyError(f"Table not found: {table}")
    return TABLES[key]


def table_schema(table: str, with_tracking: bool = True) -> T.StructType:
    """Spark schema of a target table, tracking columns appended."""
    fields = [T.StructField(c.name, c.spark_type, not c.required) for c in table_columns(table)]
    if with_tracking:
        fields += [
            T.StructField("batch_id", T.StringType(), True),
            T.StructField("row_number", T.LongType(), True),
            T.StructField("loaded_at", T.TimestampNTZType(), True),
        ]
    return T.StructType(fields)


# Seeded validation rules.
# (pattern, table, expected tabs, validation, auto-fix, reject, control, non-latin,
#  collapse, transform on, transformer name, description)
RULE_SEEDS = (
    ("PM1", "pm1", 16, True, True, False, False, False, False, False, None,
     "PM1 files should have 16 tabs per row (17 columns)"),
    ("PM2", "pm2", 4, True, True, False, False, False, False, False, None,
     "PM2 files should have 4 tabs per row (5 columns)"),
    ("PM3", "pm3", 6, True, True, False, True, True, True, False, None,
     "PM3 files should have 6 tabs per row (7 columns)"),
    ("PM4", "pm4", 3, True, True, False, False, False, False, False, None,
     "PM4 files should have 3 tabs per row (4 columns)"),
    ("PM5", "pm5", 2, True, True, False, True, True, True, False, None,
     "PM5 files should have 2 tabs per row (3 columns)"),
    ("PM6", "pm6", 2, True, True, False, True, True, True, False, None,
     "PM6 files should have 2 tabs per row (3 columns)"),
    ("PM7", "pm7", 9, True, True, False, False, False, False, False, None,
     "PM7 files should have 9 tabs per row (10 columns)"),
    ("IM1", "im1", 12, True, True, False, False, False, False, False, None,
     "IM1 files should have 12 tabs per row (13 columns)"),
    ("IM2", "im2", 8, True, True, False, True, True, True, True, "im2",
     "IM2 files should have 8 tabs per row (9 columns) - includes date transformation"),
    ("IM3", "im3", 2, True, True, False, True, True, True, False, None,
     "IM3 files should have 2 tabs per row (3 columns)"),
)

RULE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("file_pattern", T.StringType(), False),
    T.StructField("table_name", T.StringType(), True),
    T.StructField("expected_tab_count", T.IntegerType(), False),
    T.StructField("validation_enabled", T.BooleanType(), False),
    T.StructField("auto_fix_enabled", T.BooleanType(), False),
    T.StructField("reject_on_violation", T.BooleanType(), False),
    T.StructField("replace_control_chars", T.BooleanType(), False),
    T.StructField("replace_non_latin_chars", T.BooleanType(), False),
    T.StructField("collapse_consecutive_replaced", T.BooleanType(), False),
    T.StructField("enable_data_transformation", T.BooleanType(), False),
    T.StructField("transformer_class_name", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("updated_at", T.TimestampNTZType(), True),
    T.StructField("created_by", T.StringType(), True),
])

ISSUE_COLUMNS = (
    "batch_id", "file_name", "line_number", "issue_seq", "issue_type", "severity",
    "expected_value", "actual_value", "description", "auto_fixed", "fix_description",
    "original_line", "corrected_line",
)

MANIFEST_COLUMNS = (
    "batch_id", "parent_batch_id", "file_name", "file_path", "file_size_bytes",
    "file_checksum", "content_type", "table_name", "status", "total_records",
    "processed_records", "failed_records", "corrected_records", "warning_count",
    "error_count", "data_quality_status", "started_at", "completed_at",
    "processing_duration_ms", "error_message", "error_details", "created_at",
    "updated_at", "created_by",
)

# The ten routed tables an archive load may target.
KNOWN_TABLES = tuple(TABLES)

"""Table schemas and the fixed values the operators must share with the
original service (thresholds, TTLs, defaults)."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the original service's settings)
# ---------------------------------------------------------------------------
ERROR_SEVERITY_MIN = 17            # "error" means SeverityNumber >= 17
UNKNOWN_SERVICE = "unknown"        # service.name default
SERVICE_NAME_KEY = "service.name"
BODY_TYPE_STRING = "string"
TRACE_ID_HEX_LEN = 32
SPAN_ID_HEX_LEN = 16
DEFAULT_PAGE_LIMIT = 100
ORDER_FIELDS = ("Timestamp", "ServiceName")   # exact, case-sensitive names
DEFAULT_ORDER_FIELD = "Timestamp"

LOGS_TTL_DAYS = 30
METRICS_1S_TTL = "1 hour"
METRICS_1M_TTL = "1 day"
QUEUE_SAMPLES_TTL = "1 hour"

INGESTION_WINDOW_SECONDS = 60
ERROR_RATE_WINDOW_MINUTES = 5
TOP_ERRORS_WINDOW_HOURS = 1
TOP_ERRORS_LIMIT = 5
LOG_RATE_CURRENT_SECONDS = 5
LOG_RATE_BASELINE_SECONDS = 60
QUEUE_DEPTH_MINUTES = 15

MAX_DELIVER = 10
MISSING_METADATA_DELAY_SECONDS = 30

LIVE_BUFFER_SIZE = 300
LIVE_VIEW_ROWS = 15

# raw queue: 12 h / 50 GB, dead-letter queue: 24 h / 10 GB
RAW_QUEUE_MAX_AGE = "12 hours"
RAW_QUEUE_MAX_BYTES = 50 * 1000 ** 3
DLQ_MAX_AGE = "24 hours"
DLQ_MAX_BYTES = 10 * 1000 ** 3

# envelope admission
ACCEPTED_CONTENT_TYPES = ("application/x-protobuf", "application/json")
ACCEPTED_ENCODINGS = ("", "identity", "zstd", "gzip")
# worker side: encodings passed through unchanged
PASSTHROUGH_ENCODINGS = ("", "none", "identity")

# severity bands by number (inclusive)
SEVERITY_BANDS = (
    ("DEBUG", 5, 8),
    ("INFO", 9, 12),
    ("WARNING", 13, 16),
    ("ERROR", 17, 20),
    ("FATAL", 21, 24),
)

# normalised severity names (lower-case text without trailing digits)
SEVERITY_NORMALISE = {
    "trace": "trace",
    "debug": "debug",
    "info": "info",
    "warning": "warn",
    "warn": "warn",
    "error": "error",
    "fatal": "fatal",
}
SEVERITY_FALLBACK = "info"

# storage card: texts, and from how many days on the disk is not yet urgent
RUNWAY_STABLE = "Stable"
RUNWAY_DAYS = " days at current rate"
RUNWAY_ACTION = " days — action needed"
RUNWAY_WARNING_DAYS = 30

# error-rate card levels (percent)
ERROR_LEVEL_NORMAL_BELOW = 1.0
ERROR_LEVEL_ELEVATED_BELOW = 5.0

# default threshold bands: (min, colour, label)
DEFAULT_THRESHOLDS = (
    (80, "#ef5350", "Critical"),
    (60, "#ffa726", "High"),
    (40, "#fbc02d", "Medium"),
    (20, "#42a5f5", "Low"),
    (0, "#607d8b", "Minimal"),
)
DEFAULT_BAND_COLOUR = "#607d8b"
MAX_THRESHOLD_BANDS = 7
HEX_COLOUR_PATTERN = r"^#[0-9a-fA-F]{6}$"

# compression magic bytes (hex)
ZSTD_MAGIC_HEX = "28B52FFD"
GZIP_MAGIC_HEX = "1F8B"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
STR_ARRAY = T.ArrayType(T.StringType())

LOGS_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("ts_nanos", T.LongType()),
    T.StructField("observed_ts", T.TimestampType()),
    T.StructField("observed_ts_nanos", T.LongType()),
    T.StructField("inserted_at", T.TimestampType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("span_id", T.StringType()),
    T.StructField("severity_text", T.StringType()),
    T.StructField("severity_number", T.IntegerType()),
    T.StructField("service_name", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("body_type", T.StringType()),
    T.StructField("scope_name", T.StringType()),
    T.StructField("scope_version", T.StringType()),
    T.StructField("log_attr_keys", STR_ARRAY),
    T.StructField("log_attr_values", STR_ARRAY),
    T.StructField("res_attr_keys", STR_ARRAY),
    T.StructField("res_attr_values", STR_ARRAY),
    T.StructField("log_date", T.DateType()),
])

LOG_COLUMNS = [f.name for f in LOGS_SCHEMA.fields]

METRICS_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("service_name", T.StringType()),
    T.StructField("logs_count", T.LongType()),
    T.StructField("errors_count", T.LongType()),
])

REGISTRY_SCHEMA = T.StructType([
    T.StructField("service_name", T.StringType()),
    T.StructField("first_seen", T.TimestampType()),
    T.StructField("last_seen", T.TimestampType()),
])

QUEUE_SAMPLE_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("consumer_name", T.StringType()),
    T.StructField("stream_name", T.StringType()),
    T.StructField("num_ack_pending", T.LongType()),
    T.StructField("num_redelivered", T.LongType()),
    T.StructField("num_pending", T.LongType()),
])

ENVELOPE_SCHEMA = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("content_encoding", T.StringType()),
    T.StructField("num_delivered", T.IntegerType()),
    T.StructField("received_at", T.TimestampType()),
])

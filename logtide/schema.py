"""Schemas and fixed look-up values shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Severity order and accepted spellings of each level.
LEVEL_SEVERITY = {
    "UNKNOWN": 0,
    "DEBUG": 10,
    "INFO": 20,
    "WARNING": 30,
    "ERROR": 40,
    "CRITICAL": 50,
}
LEVEL_SPELLINGS = {
    "DEBUG": ("DEBUG", "TRACE", "VERBOSE"),
    "INFO": ("INFO", "INFORMATION", "NOTICE"),
    "WARNING": ("WARN", "WARNING"),
    "ERROR": ("ERROR", "ERR"),
    "CRITICAL": ("CRITICAL", "CRIT", "FATAL", "EMERGENCY"),
}
# The collector maps these and keeps every other level as it is.
COLLECTOR_LEVELS = {
    "WARN": "WARNING",
    "ERR": "ERROR",
    "CRIT": "CRITICAL",
    "FATAL": "CRITICAL",
    "TRACE": "DEBUG",
}
LEVEL_SCAN_ORDER = ("CRITICAL", "FATAL", "ERROR", "WARNING", "WARN", "INFO", "DEBUG", "TRACE")
COLLECTOR_RESERVED = (
    "@timestamp", "timestamp", "time", "Time",
    "message", "msg", "log",
    "level", "severity", "log_level", "lvl",
    "logger", "logger_name", "source",
    "trace_id", "traceId", "trace",
    "span_id", "spanId",
    "error", "exception", "stack_trace",
    "source_file",
    "hostname", "environment", "service_name", "agent_version",
)

# Column layout of a broker message.
MESSAGE = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

WINDOW_RECORD = T.StructType([
    T.StructField("recordType", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("env", T.StringType()),
    T.StructField("windowStartMs", T.LongType()),
    T.StructField("windowEndMs", T.LongType()),
    T.StructField("windowStart", T.StringType()),
    T.StructField("windowEnd", T.StringType()),
    T.StructField("requestVolume", T.LongType()),
    T.StructField("errorRate", T.DoubleType()),
    T.StructField("warnRate", T.DoubleType()),
    T.StructField("errorCount", T.LongType()),
    T.StructField("warnCount", T.LongType()),
    T.StructField("p99LatencyMs", T.LongType()),
    T.StructField("p95LatencyMs", T.LongType()),
    T.StructField("p50LatencyMs", T.LongType()),
    T.StructField("avgLatencyMs", T.LongType()),
    T.StructField("topErrors", T.ArrayType(T.StructType([
        T.StructField("message", T.StringType()),
        T.StructField("count", T.LongType()),
    ]))),
])

BASELINE_STATE = T.StructType([
    T.StructField("mean", T.DoubleType()),
    T.StructField("std_dev", T.DoubleType()),
    T.StructField("ewma", T.DoubleType()),
    T.StructField("sample_count", T.LongType()),
    T.StructField("last_updated", T.DoubleType()),
])

LOG_SAMPLE = T.StructType([
    T.StructField("message", T.StringType()),
    T.StructField("count", T.LongType()),
])

ANOMALY_EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("anomaly_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("z_score", T.DoubleType()),
    T.StructField("baseline", T.MapType(T.StringType(), BASELINE_STATE)),
    T.StructField("observed", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("top_log_samples", T.ArrayType(LOG_SAMPLE)),
    T.StructField("correlated_services", T.ArrayType(T.StringType())),
    T.StructField("timestamp", T.StringType()),
])

OWNER = T.StructType([
    T.StructField("team", T.StringType()),
    T.StructField("oncall", T.StringType()),
    T.StructField("slack_channel", T.StringType()),
    T.StructField("pagerduty_service_id", T.StringType()),
    T.StructField("escalation_policy", T.StringType()),
    T.StructField("tier", T.StringType()),
    T.StructField("runbook_url", T.StringType()),
])

"""Parsing, projection and scalar operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.catalog import views as v
from logtide.functions.levels import canonical_level, is_at_least, level_in_text, severity_num
from logtide.functions.scalars import (
    clamp01, daily_index, first_present, iso_utc, message_key, normalise_path, parse_iso,
    percent_change,
)
from logtide.operators import parse as p
from logtide.operators.multiline import JAVA_STACK, PYTHON_STACK, assemble
from logtide.operators.windows import features, record_features, service_windows, window_records
from logtide.schema import COLLECTOR_RESERVED
from logtide.settings import RECORD_TYPE, WindowSettings
from logtide.sources.readers import decode_window_records
from logtide.sources.writers import json_messages

SIX_HOURS = WindowSettings(size=v.HOURS_6)


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    return p.parsed_records(p.parse_messages(v.raw_messages(spark, folder)))


def normalised(spark: SparkSession, folder: str) -> DataFrame:
    return p.normalise(parsed(spark, folder))


def plain_lines(spark: SparkSession, folder: str) -> DataFrame:
    logs = v.logs(spark, folder)
    t = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    level, i = F.rpad("level", 8, " "), F.col("event_id") % 4
    line = (
        F.when(i == 0, F.concat(t, F.lit("Z "), level, F.lit(" ["), "service", F.lit("] "), "message"))
        .when(i == 1, F.concat(t, F.lit(" "), level, F.lit(" "), "message"))
        .when(i == 2, F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss,SSS"),
                               F.lit(" "), level, F.lit(" "), "message"))
        .otherwise(F.concat("message", F.lit(" ("), F.lower("level"), F.lit(")"))))
    return logs.select("event_id", line.alias("line"))


PLAIN_LINES = """plain_lines AS (
  SELECT event_id, CASE event_id % 4
    WHEN 0 THEN strftime(event_time, '%Y-%m-%dT%H:%M:%S.%g') || 'Z ' || rpad(level, 8, ' ') || ' [' || service || '] ' || message
    WHEN 1 THEN strftime(event_time, '%Y-%m-%dT%H:%M:%S.%g') || ' ' || rpad(level, 8, ' ') || ' ' || message
    WHEN 2 THEN strftime(event_time, '%Y-%m-%d %H:%M:%S,%g') || ' ' || rpad(level, 8, ' ') || ' ' || message
    ELSE message || ' (' || lower(level) || ')' END AS line
  FROM logs)"""


def stack_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Log files by service: header lines, stack traces, stray lines."""
    logs = v.logs(spark, folder)
    head = F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "level", F.lit(" "), "message")
    error = F.col("level").isin("ERROR", "CRITICAL")
    trace = F.array(head, F.lit("\tat app.Main.run(Main.java:1)"), F.lit("Caused by: java.io.IOException"),
                    F.lit("\t... 3 more"))
    stray = F.array(head, F.lit("loose line"), F.lit("    at nowhere"))
    lines = F.when(error, trace).when(F.col("event_id") % 11 == 0, stray).otherwise(F.array(head))
    return logs.select(
        F.col("service").alias("source_file"), "event_id", F.posexplode(lines).alias("pos", "line")
    ).select("source_file", (F.col("event_id") * 10 + F.col("pos")).alias("line_no"), "line")


STACK_LINES = """stack_lines AS (
  SELECT source_file, event_id * 10 + pos - 1 AS line_no, line FROM (
    SELECT source_file, event_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM (
      SELECT service AS source_file, event_id,
        CASE WHEN level IN ('ERROR', 'CRITICAL') THEN [head, chr(9) || 'at app.Main.run(Main.java:1)',
            'Caused by: java.io.IOException', chr(9) || '... 3 more']
          WHEN event_id % 11 = 0 THEN [head, 'loose line', '    at nowhere'] ELSE [head] END AS lines
      FROM (SELECT *, strftime(event_time, '%Y-%m-%d %H:%M:%S') || ' ' || level || ' ' || message AS head FROM logs))))"""


def syslog_lines(spark: SparkSession, folder: str) -> DataFrame:
    logs = v.logs(spark, folder)
    i = F.col("event_id")
    pri = (i % 192).cast("string")
    modern = F.concat(F.lit("<"), pri, F.lit(">1 "), iso_utc(F.col("event_time")), F.lit(" "), "host",
                      F.lit(" "), "service", F.lit(" - - - "), "message")
    old = F.concat(F.lit("<"), pri, F.lit(">"), F.date_format("event_time", "MMM dd HH:mm:ss"), F.lit(" "),
                   "host", F.lit(" "), "service", F.lit("["), F.col("user_id").cast("string"), F.lit("]: "), "message")
    line = F.when(i % 3 == 0, modern).when(i % 3 == 1, old).otherwise(F.col("message"))
    return logs.select("event_id", line.alias("line"))


SYSLOG_LINES = """syslog_lines AS (
  SELECT event_id, CASE event_id % 3
    WHEN 0 THEN '<' || CAST(event_id % 192 AS VARCHAR) || '>1 ' || strftime(event_time, '%Y-%m-%dT%H:%M:%S.%g')
      || 'Z ' || host || ' ' || service || ' - - - ' || message
    WHEN 1 THEN '<' || CAST(event_id % 192 AS VARCHAR) || '>' || strftime(event_time, '%b %d %H:%M:%S') || ' '
      || host || ' ' || service || '[' || CAST(user_id AS VARCHAR) || ']: ' || message
    ELSE message END AS line
  FROM logs)"""


def field_sql(key: str) -> str:
    return f"""json_extract_string(value, '$."{key}"')"""


def first_sql(*keys: str, default: str = "") -> str:
    tests = [f"CASE WHEN regexp_matches({field_sql(k)}, '\\S') THEN {field_sql(k)} END" for k in keys]
    return f"coalesce({', '.join(tests)}, '{default}')"


def number_sql(path: str) -> str:
    return (f"CASE WHEN json_type(value, '{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') "
            f"THEN CAST(json_extract_string(value, '{path}') AS DOUBLE) END")


LEVEL_SQL = f"""CASE WHEN lvl IN ('DEBUG', 'TRACE', 'VERBOSE') THEN 'DEBUG'
      WHEN lvl IN ('INFO', 'INFORMATION', 'NOTICE') THEN 'INFO' WHEN lvl IN ('WARN', 'WARNING') THEN 'WARNING'
      WHEN lvl IN ('ERROR', 'ERR') THEN 'ERROR' WHEN lvl IN ('CRITICAL', 'CRIT', 'FATAL', 'EMERGENCY') THEN 'CRITICAL'
      ELSE 'UNKNOWN' END"""
LATENCY_PATHS = ["$.http.duration_ms", "$.extra.http.duration_ms"] + [
    path for k in p.LATENCY_KEYS for path in (f"$.{k}", f"$.extra.{k}")]
PARSED = "parsed AS (SELECT * FROM raw_messages WHERE value LIKE '{%' AND json_valid(value))"
NORMALISED = f"""read_fields AS (
  SELECT event_id, timestamp, value,
    {first_sql('@timestamp', 'timestamp', 'time')} AS time_text,
    upper(trim({first_sql('level', 'severity', 'log_level')})) AS lvl,
    {first_sql('service_name', 'service', default='unknown')} AS service,
    {first_sql('hostname', 'host', default='unknown')} AS host,
    {first_sql('environment', 'env', default='unknown')} AS env,
    {first_sql('logger')} AS logger,
    {first_sql('message', 'msg', 'log')} AS message,
    {first_sql('trace_id')} AS trace_id, {first_sql('span_id')} AS span_id,
    {first_sql('error')} AS error,
    CAST(trunc(coalesce({', '.join(number_sql(x) for x in LATENCY_PATHS)})) AS BIGINT) AS latency_ms
  FROM parsed),
timed AS (
  SELECT *, {LEVEL_SQL} AS level,
    CASE WHEN regexp_matches(time_text, '^[0-9.]+$') THEN make_timestamp(CAST(
        CASE WHEN CAST(time_text AS DOUBLE) > 1e12 THEN CAST(time_text AS DOUBLE)
        ELSE CAST(time_text AS DOUBLE) * 1000 END AS BIGINT) * 1000)
      ELSE try_cast(replace(time_text, ',', '.') AS TIMESTAMP) END AS parsed_time
  FROM read_fields),
normalised AS (
  SELECT *, coalesce(parsed_time, timestamp) AS event_time, parsed_time IS NULL OR level = 'UNKNOWN' AS degraded
  FROM timed)"""
BASE = v.with_ctes(v.LOGS, v.RAW_MESSAGES, PARSED)
FULL = v.with_ctes(v.LOGS, v.RAW_MESSAGES, PARSED, NORMALISED)


def tolerant_json(spark, folder):
    m = p.parse_messages(v.raw_messages(spark, folder))
    return m.select("event_id", "parse_error", F.when(F.col("parse_error").isNotNull(), F.col("value")).alias("dead_value"))


def strict_json(spark, folder):
    return p.parse_failures(p.parse_messages(v.raw_messages(spark, folder), strict_types=True)).select(
        "event_id", "parse_error")


def first_non_blank(spark, folder):
    doc = F.col("doc")
    return parsed(spark, folder).select(
        "event_id",
        first_present(p.text_at(doc, "service_name"), p.text_at(doc, "service"), default="unknown").alias("service"),
        first_present(p.text_at(doc, "logger")).alias("logger"))


def levels(spark, folder):
    doc = F.col("doc")
    raw = first_present(*[p.text_at(doc, k) for k in p.LEVEL_KEYS])
    return parsed(spark, folder).select("event_id", raw.alias("raw_level"), canonical_level(raw).alias("level"))


def level_rank(spark, folder):
    logs = v.logs(spark, folder)
    return logs.groupBy("service").agg(
        F.count_if(is_at_least(F.col("level"), "WARNING")).alias("at_least_warning"),
        F.count_if(is_at_least(F.col("level"), "ERROR")).alias("at_least_error"),
        F.sum(severity_num(F.col("level")).cast("bigint")).alias("severity_sum"))


def event_times(spark, folder):
    return normalised(spark, folder).select(
        "event_id", F.unix_millis("event_time").alias("event_ms"),
        F.when(F.col("timestamp_text").rlike("^[0-9]{13}$"), "epoch").otherwise("text").alias("kind"))


def latencies(spark, folder):
    return parsed(spark, folder).select("event_id", p.latency_ms(F.col("doc")).alias("latency_ms"))


def normalised_rows(spark, folder):
    return normalised(spark, folder).select(
        "event_id", F.unix_millis("event_time").alias("event_ms"), "level", "service", "host", "env", "logger",
        "message", "trace_id", "span_id", "error", "latency_ms")


def degraded_rows(spark, folder):
    bad = normalised(spark, folder).filter("degraded").select("event_id")
    records = parsed(spark, folder).join(bad, "event_id", "left_semi")
    return p.degrade(records).select(
        "event_id", F.unix_millis("event_time").alias("event_ms"), "level", "service", "message", "latency_ms", "host")


def plaintext(spark, folder):
    return plain_lines(spark, folder).withColumn("r", p.parse_plaintext(F.col("line"))).select("event_id", "r.*")


def text_levels(spark, folder):
    lines = plain_lines(spark, folder).select(
        F.lit("line").alias("origin"), F.col("event_id").alias("id"), level_in_text(F.col("line")).alias("level"))
    docs = v.table(spark, folder, "documents").select(
        F.lit("document").alias("origin"), F.col("doc_id").alias("id"), level_in_text(F.col("text")).alias("level"))
    return lines.unionByName(docs)


def collector(spark, folder):
    docs = p.collect_fields(parsed(spark, folder).select("event_id", "value", "doc"))
    lines = p.collect_fields(
        plain_lines(spark, folder).select(
        "event_id", F.lit(None).cast("string").alias("value"), F.lit(None).cast("variant").alias("doc"), "line"),
        line="line")
    columns = ["event_id", F.col("@timestamp").alias("ts_text"), "message", "log_level", "logger", "trace_id",
               "span_id", "error"]
    return docs.select(F.lit("json").alias("origin"), *columns).unionByName(
        lines.select(F.lit("plain").alias("origin"), *columns))


def overflow(spark, folder):
    extra = p.overflow_fields(F.col("doc"))
    entries = F.array_sort(F.transform(F.map_entries(extra), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return parsed(spark, folder).select("event_id", F.array_join(entries, ";").alias("extra"))


def stamped(spark, folder):
    logs = v.logs(spark, folder).select("event_id", F.col("host").alias("hostname"))
    return p.stamp(logs, "node-1", "prod", "payment-svc").select(
        "event_id", "hostname", "environment", "service_name", "agent_version")


def without_debug(spark, folder):
    logs = v.logs(spark, folder)
    return p.drop_debug(logs, "level", "env").select("event_id", "env", "level")


def multiline(spark, folder):
    return assemble(stack_lines(spark, folder), JAVA_STACK, chunk_lines=5_000).select(
        "source_file", "first_line", "n_lines", "log")


def python_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Log files by host: header lines, tracebacks, stray lines."""
    logs = v.logs(spark, folder)
    head = F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "level", F.lit(" "), "message")
    trace = F.array(F.lit("Traceback (most recent call last):"), F.lit('  File "app.py", line 7, in run'), F.lit("    start()"),
                    F.concat(F.lit("ValueError: "), "message"), F.lit("loose line"), F.lit("OtherException: alone"))
    lines = F.when(F.col("level").isin("ERROR", "CRITICAL"), trace).otherwise(F.array(head))
    return logs.select(F.col("host").alias("source_file"), "event_id", F.posexplode(lines).alias("pos", "line")).select(
        "source_file", (F.col("event_id") * 10 + F.col("pos")).alias("line_no"), "line")


PYTHON_TRACES = """stack_lines AS (
  SELECT source_file, event_id * 10 + pos - 1 AS line_no, line FROM (
    SELECT source_file, event_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM (
      SELECT host AS source_file, event_id, CASE WHEN level IN ('ERROR', 'CRITICAL')
        THEN ['Traceback (most recent call last):', '  File "app.py", line 7, in run', '    start()', 'ValueError: ' || message,
          'loose line', 'OtherException: alone']
        ELSE [strftime(event_time, '%Y-%m-%d %H:%M:%S') || ' ' || level || ' ' || message] END AS lines FROM logs)))"""


def python_records(spark, folder):
    return assemble(python_traces(spark, folder), PYTHON_STACK, chunk_lines=5_000).select(
        "source_file", "first_line", "n_lines", "log")


def iso_lines(spark, folder):
    return plain_lines(spark, folder).withColumn("r", p.parse_iso_line(F.col("line"))).select("event_id", "r.*")


def syslog(spark, folder):
    return syslog_lines(spark, folder).withColumn("r", p.parse_syslog(F.col("line"))).select(
        "event_id", "r.format", "r.pri", "r.time", "r.host", "r.ident", "r.pid", "r.msgid", "r.extradata",
        "r.message", F.col("r.facility").cast("bigint").alias("facility"),
        F.col("r.severity").cast("bigint").alias("severity"))


def without_unknown(spark, folder):
    return p.known_services(normalised(spark, folder)).select("event_id", "service")


def record_types(spark, folder):
    windows = json_messages(window_records(service_windows(v.logs(spark, folder), SIX_HOURS)))
    single = json_messages(v.logs(spark, folder).select(F.lit("LOG_EVENT").alias("recordType"), "service", "level"))
    kept = decode_window_records(windows.unionByName(single))
    return kept.select("recordType", "service", "windowStartMs", "requestVolume", "p99LatencyMs")


def feature_vectors(spark, folder):
    windows = json_messages(window_records(service_windows(v.logs(spark, folder), SIX_HOURS)))
    return record_features(decode_window_records(windows)).select(
        "service", F.unix_millis("ts").alias("ts_ms"), F.round("error_rate", 6).alias("error_rate"),
        "p99_latency_ms", "avg_latency_ms", "request_volume", F.round("warn_rate", 6).alias("warn_rate"))


def paths(spark, folder):
    return v.table(spark, folder, "pages").select("page_id", normalise_path(F.col("url")).alias("path"))


def time_texts(spark, folder):
    text = iso_utc(F.col("event_time"))
    return v.logs(spark, folder).select(
        "event_id", text.alias("iso"), F.unix_millis(parse_iso(text)).alias("ms"),
        daily_index("logs-aggregates-", F.col("event_time")).alias("index_name"))


def changes(spark, folder):
    f = features(service_windows(v.logs(spark, folder), SIX_HOURS))
    return f.select("service", F.unix_millis("ts").alias("ts_ms"),
                    F.round(percent_change(F.col("p99_latency_ms"), F.col("avg_latency_ms")), 6).alias("latency_pct"),
                    F.round(percent_change(F.col("warn_rate"), F.col("error_rate")), 6).alias("rate_pct"))


def clamped(spark, folder):
    return v.table(spark, folder, "events").select(
        "event_id", F.round(clamp01(F.col("value") / 50 - 0.2), 6).alias("clamped"))


def message_keys(spark, folder):
    return v.table(spark, folder, "documents").select(
        "doc_id", message_key(F.col("text"), 200).alias("message_key"))


QUERIES = {
    "P1_tolerant_json": tolerant_json,
    "P1_strict_json": strict_json,
    "P2_first_non_blank": first_non_blank,
    "P3_level_canonical": levels,
    "P4_level_rank": level_rank,
    "P5_timestamps": event_times,
    "P6_latency": latencies,
    "P7_normalise": normalised_rows,
    "P8_degraded": degraded_rows,
    "P9_plaintext": plaintext,
    "P10_level_in_text": text_levels,
    "P11_collector_layout": collector,
    "P12_overflow_fields": overflow,
    "P13_stamp": stamped,
    "P14_drop_debug": without_debug,
    "P15_multiline": multiline,
    "P15_python_traces": python_records,
    "P16_iso_lines": iso_lines,
    "P17_syslog": syslog,
    "P18_known_services": without_unknown,
    "P19_record_type": record_types,
    "P20_feature_vectors": feature_vectors,
    "P21_paths": paths,
    "P22_time_texts": time_texts,
    "P23_percent_change": changes,
    "P24_clamp": clamped,
    "P25_message_keys": message_keys,
}

_GROUPS = {"t": r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[.\d]*Z?)\s+([A-Z]+)\s+\[([^\]]+)\]\s+(.+)$",
           "u": r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[.\d]*Z?)\s+([A-Z]+)\s+(.+)$",
           "s": r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}[.,]?\d*)\s+([A-Z]+)\s+(.+)$"}


def _plain_sql(group_t: int | None, group: int | None) -> str:
    def part(name: str, g: int | None) -> str:
        return "NULL" if g is None else f"regexp_extract(line, '{_GROUPS[name]}', {g})"

    return (f"CASE WHEN regexp_matches(line, '{_GROUPS['t']}') THEN {part('t', group_t)} "
            f"WHEN regexp_matches(line, '{_GROUPS['u']}') THEN {part('u', group)} "
            f"WHEN regexp_matches(line, '{_GROUPS['s']}') THEN {part('s', group)} END")


PLAIN_FIELDS = f"""plain_fields AS (
  SELECT event_id, line, {_plain_sql(1, 1)} AS timestamp, {_plain_sql(2, 2)} AS log_level,
    {_plain_sql(3, None)} AS logger, coalesce({_plain_sql(4, 3)}, line) AS message
  FROM plain_lines)"""


def _scan_sql(text: str) -> str:
    words = ("CRITICAL", "FATAL", "ERROR", "WARNING", "WARN", "INFO", "DEBUG", "TRACE")
    tests = " ".join(f"WHEN regexp_matches(upper({text}), '(^|[^A-Z]){w}([^A-Z]|$)', 's') THEN '{w}'" for w in words)
    return f"CASE {tests} END"


def _collector_level(expr: str) -> str:
    return (f"CASE upper({expr}) WHEN 'WARN' THEN 'WARNING' WHEN 'ERR' THEN 'ERROR' WHEN 'CRIT' THEN 'CRITICAL' "
            f"WHEN 'FATAL' THEN 'CRITICAL' WHEN 'TRACE' THEN 'DEBUG' ELSE upper({expr}) END")


_ISO = (r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+"
        r"(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL)\s+(?:\[([^\]]+)\]\s+)?(.+)$")
_S5 = r"^<([0-9]{1,5})>1 ([^ ]+) ([^ ]+) ([^ ]+) ([-0-9]+) ([^ ]+) (\[.*?\]|-) (.+)$"
_S3 = (r"^<([0-9]+)>([^ ]* {1,2}[^ ]* [^ ]*) ([^ ]*) ([a-zA-Z0-9_/.\-]*)(?:\[([0-9]+)\])?(?:[^:]*:)? *(.*)$")


def _syslog_sql(g5: int | None, g3: int | None) -> str:
    a = "NULL" if g5 is None else f"regexp_extract(line, '{_S5}', {g5})"
    b = "NULL" if g3 is None else f"regexp_extract(line, '{_S3}', {g3})"
    return f"CASE WHEN regexp_matches(line, '{_S5}') THEN {a} WHEN regexp_matches(line, '{_S3}') THEN {b} END"


RESERVED_SQL = ", ".join(f"'{k}'" for k in COLLECTOR_RESERVED)
WINDOWS = v.with_ctes(v.LOGS, v.windows_sql(v.HOURS_6))

ORACLE = {
    "P1_tolerant_json": v.with_ctes(v.LOGS, v.RAW_MESSAGES) + """, judged AS (
SELECT event_id, value, CASE WHEN value = '' THEN 'empty message' WHEN NOT json_valid(value) THEN 'malformed json'
  WHEN value NOT LIKE '{%' THEN 'not an object' END AS parse_error FROM raw_messages)
SELECT event_id, parse_error, CASE WHEN parse_error IS NOT NULL THEN value END AS dead_value FROM judged""",
    "P1_strict_json": v.with_ctes(v.LOGS, v.RAW_MESSAGES) + """, judged AS (
SELECT event_id, CASE WHEN value = '' THEN 'empty message' WHEN NOT json_valid(value) THEN 'malformed json'
  WHEN value NOT LIKE '{%' THEN 'not an object'
  WHEN value LIKE '%"error":{%' THEN 'unexpected nested value' END AS parse_error FROM raw_messages)
SELECT event_id, parse_error FROM judged WHERE parse_error IS NOT NULL""",
    "P2_first_non_blank": BASE + f"""SELECT event_id, {first_sql('service_name', 'service', default='unknown')} AS service,
  {first_sql('logger')} AS logger FROM parsed""",
    "P3_level_canonical": BASE + f"""SELECT event_id, raw_level, {LEVEL_SQL} AS level FROM (
  SELECT event_id, raw_level, upper(trim(raw_level)) AS lvl FROM (
    SELECT event_id, {first_sql('level', 'severity', 'log_level')} AS raw_level FROM parsed))""",
    "P4_level_rank": v.with_ctes(v.LOGS) + """SELECT service,
  count(*) FILTER (level IN ('WARNING', 'ERROR', 'CRITICAL')) AS at_least_warning,
  count(*) FILTER (level IN ('ERROR', 'CRITICAL')) AS at_least_error,
  CAST(sum(CASE level WHEN 'DEBUG' THEN 10 WHEN 'INFO' THEN 20 WHEN 'WARNING' THEN 30 WHEN 'ERROR' THEN 40
    WHEN 'CRITICAL' THEN 50 ELSE 0 END) AS BIGINT) AS severity_sum FROM logs GROUP BY service""",
    "P5_timestamps": FULL + """SELECT event_id, (epoch_us(event_time) // 1000) AS event_ms,
  CASE WHEN regexp_matches(time_text, '^[0-9]{13}$') THEN 'epoch' ELSE 'text' END AS kind FROM normalised""",
    "P6_latency": FULL + "SELECT event_id, latency_ms FROM read_fields",
    "P7_normalise": FULL + """SELECT event_id, (epoch_us(event_time) // 1000) AS event_ms, level, service, host, env, logger, message,
  trace_id, span_id, error, latency_ms FROM normalised""",
    "P8_degraded": FULL + """SELECT event_id, (epoch_us(timestamp) // 1000) AS event_ms, 'UNKNOWN' AS level, service, message,
  CAST(NULL AS BIGINT) AS latency_ms, '' AS host FROM normalised WHERE degraded""",
    "P9_plaintext": v.with_ctes(v.LOGS, PLAIN_LINES, PLAIN_FIELDS)
    + "SELECT event_id, timestamp, log_level, logger, message FROM plain_fields",
    "P10_level_in_text": v.with_ctes(v.LOGS, PLAIN_LINES) + f"""SELECT 'line' AS origin, event_id AS id, {_scan_sql('line')} AS level
FROM plain_lines UNION ALL SELECT 'document', doc_id, {_scan_sql('text')} FROM documents""",
    "P11_collector_layout": v.with_ctes(v.LOGS, v.RAW_MESSAGES, PARSED, PLAIN_LINES, PLAIN_FIELDS) + f""",
picked AS (SELECT event_id, {field_sql('log')} AS log,
    coalesce({field_sql('timestamp')}, {field_sql('@timestamp')}, {field_sql('time')}) AS t,
    coalesce({field_sql('message')}, {field_sql('msg')}) AS m,
    coalesce({field_sql('level')}, {field_sql('severity')}, {field_sql('log_level')}) AS l,
    {field_sql('trace_id')} AS tr, {field_sql('span_id')} AS sp, {field_sql('error')} AS er FROM parsed)
SELECT 'json' AS origin, event_id, CASE WHEN log IS NULL THEN coalesce(t, '') ELSE '' END AS ts_text,
  coalesce(log, m, '') AS message,
  {_collector_level(f"CASE WHEN log IS NULL THEN l ELSE coalesce({_scan_sql('log')}, 'INFO') END")} AS log_level,
  '' AS logger, CASE WHEN log IS NULL THEN coalesce(tr, '') ELSE '' END AS trace_id,
  CASE WHEN log IS NULL THEN coalesce(sp, '') ELSE '' END AS span_id,
  CASE WHEN log IS NULL THEN coalesce(er, '') ELSE '' END AS error FROM picked
UNION ALL SELECT 'plain', event_id, coalesce(timestamp, ''), message,
  {_collector_level(f"coalesce(log_level, {_scan_sql('line')}, 'INFO')")}, coalesce(logger, ''), '', '', '' FROM plain_fields""",
    "P12_overflow_fields": BASE + f"""SELECT event_id, string_agg(k || '=' || CASE WHEN k = 'http'
    THEN CAST(json_object('duration_ms', value -> '$.http.duration_ms', 'method', 'GET') AS VARCHAR)
    ELSE json_extract_string(value, '$."' || k || '"') END, ';' ORDER BY k) FILTER (k NOT IN ({RESERVED_SQL})) AS extra
FROM (SELECT event_id, value, unnest(json_keys(value)) AS k FROM parsed) GROUP BY event_id""",
    "P13_stamp": "SELECT event_id, 'node-1' AS hostname, 'prod' AS environment, 'payment-svc' AS service_name, '1.0.0' AS agent_version FROM events",
    "P14_drop_debug": v.with_ctes(v.LOGS) + "SELECT event_id, env, level FROM logs WHERE NOT (env = 'prod' AND level = 'DEBUG')",
    "P15_multiline": v.with_ctes(v.LOGS, STACK_LINES) + r""",
marked AS (SELECT *, regexp_matches(line, '^\s+at |^\s+\.\.\. \d+ more|^Caused by:|^\t') AS joins,
    regexp_matches(line, '^(\d{4}-\d{2}-\d{2}|[A-Z]{3,8}[\s:]|\[\d)') AS opens FROM stack_lines),
anchored AS (SELECT *, max(CASE WHEN NOT joins THEN line_no END) OVER (PARTITION BY source_file ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM marked),
owned AS (SELECT a.*, CASE WHEN a.joins AND coalesce(o.opens, false) THEN a.anchor ELSE a.line_no END AS first_line
  FROM anchored a LEFT JOIN marked o ON o.source_file = a.source_file AND o.line_no = a.anchor)
SELECT source_file, first_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS log
FROM owned GROUP BY source_file, first_line""",
    "P16_iso_lines": v.with_ctes(v.LOGS, PLAIN_LINES) + f"""SELECT event_id, nullif(regexp_extract(line, '{_ISO}', 1), '') AS timestamp,
  nullif(regexp_extract(line, '{_ISO}', 2), '') AS log_level, nullif(regexp_extract(line, '{_ISO}', 3), '') AS logger,
  CASE WHEN regexp_matches(line, '{_ISO}') THEN regexp_extract(line, '{_ISO}', 4) ELSE line END AS message FROM plain_lines""",
    "P17_syslog": v.with_ctes(v.LOGS, SYSLOG_LINES) + f"""SELECT event_id,
  CASE WHEN regexp_matches(line, '{_S5}') THEN 'rfc5424' WHEN regexp_matches(line, '{_S3}') THEN 'rfc3164' END AS format,
  {_syslog_sql(1, 1)} AS pri, {_syslog_sql(2, 2)} AS time, {_syslog_sql(3, 3)} AS host, {_syslog_sql(4, 4)} AS ident,
  {_syslog_sql(5, 5)} AS pid, {_syslog_sql(6, None)} AS msgid, {_syslog_sql(7, None)} AS extradata,
  {_syslog_sql(8, 6)} AS message, CAST({_syslog_sql(1, 1)} AS BIGINT) // 8 AS facility,
  CAST({_syslog_sql(1, 1)} AS BIGINT) % 8 AS severity FROM syslog_lines""",
    "P18_known_services": FULL + "SELECT event_id, service FROM normalised WHERE service <> 'unknown'",
    "P19_record_type": WINDOWS + f"""SELECT '{RECORD_TYPE}' AS "recordType", service, start_us // 1000 AS "windowStartMs",
  request_volume AS "requestVolume", p99_latency_ms AS "p99LatencyMs" FROM windows""",
    "P20_feature_vectors": WINDOWS + """SELECT service, ts_us // 1000 AS ts_ms, round(error_rate, 6) AS error_rate, p99_latency_ms,
  avg_latency_ms, request_volume, round(warn_rate, 6) AS warn_rate FROM features""",
    "P21_paths": r"""SELECT page_id, regexp_replace(regexp_replace(url,
  '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '{id}', 'g'), '/\d+', '/{id}', 'g') AS path FROM pages""",
    "P22_time_texts": v.with_ctes(v.LOGS) + """SELECT event_id, strftime(event_time, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso,
  (epoch_us(event_time) // 1000) AS ms, 'logs-aggregates-' || strftime(event_time, '%Y.%m.%d') AS index_name FROM logs""",
    "P23_percent_change": WINDOWS + """SELECT service, ts_us // 1000 AS ts_ms,
  round(CASE WHEN avg_latency_ms <> 0 THEN (p99_latency_ms - avg_latency_ms) / abs(avg_latency_ms) * 100 END, 6) AS latency_pct,
  round(CASE WHEN error_rate <> 0 THEN (warn_rate - error_rate) / abs(error_rate) * 100 END, 6) AS rate_pct FROM features""",
    "P24_clamp": "SELECT event_id, round(greatest(0.0, least(1.0, value / 50 - 0.2)), 6) AS clamped FROM events",
    "P25_message_keys": r"SELECT doc_id, CASE WHEN regexp_matches(text, '\S') THEN left(text, 200) END AS message_key FROM documents",
}

ORACLE["P15_python_traces"] = (
    ORACLE["P15_multiline"].replace(STACK_LINES, PYTHON_TRACES)
    .replace(r"'^\s+at |^\s+\.\.\. \d+ more|^Caused by:|^\t'", r"'^  File |^\w+Error:|^\w+Exception:|^\s{4}'")
    .replace(r"'^(\d{4}-\d{2}-\d{2}|[A-Z]{3,8}[\s:]|\[\d)'", r"'^(\d{4}-\d{2}-\d{2}|Traceback)'"))

"""Suppression, rate limiting and anomaly events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.catalog import baselines as base
from logtide.catalog import views as v
from logtide.operators import detect as d
from logtide.operators.events import emit_events, severity
from logtide.operators.limiter import rate_limit
from logtide.operators.suppress import (
    cooldown, remaining_ttl, sliding_services, suppress, suppression_counts,
)
from logtide.settings import ALERT_LIMITER, DetectionSettings, LimiterSettings, SuppressionSettings

HOUR = 3_600
# The alerts of the test tables are about twenty minutes apart, so scaled settings are
# registered next to the defaults.
SCALED = SuppressionSettings(cooldown=2 * HOUR, storm_window=2 * HOUR, storm_threshold=5, storm_cooldown=HOUR)
WINDOWED = SuppressionSettings(cooldown=18 * HOUR, storm_window=18 * HOUR, storm_threshold=2, storm_cooldown=12 * HOUR)
SENSITIVE = DetectionSettings(z_critical=3.0)
SCALED_LIMITER = LimiterSettings(limit=3, window=6 * HOUR)
ACCESS_LIMITER = LimiterSettings(limit=2, window=24 * HOUR, left_open=True)


def ts_us():
    return F.unix_micros("ts").alias("ts_us")


def cooled(spark, folder):
    return cooldown(v.alerts(spark, folder), SCALED.cooldown).select("event_id", "service", "allowed")


def cooled_default(spark, folder):
    return cooldown(v.alerts(spark, folder), 600).select("event_id", "service", "allowed")


def _decided(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        "event_id", "service", "reason", "allowed", "is_storm",
        F.array_join(F.array_sort("storm_services"), ",").alias("storm_services"))


def storms(spark, folder):
    return _decided(suppress(v.alerts(spark, folder), SCALED))


def storms_default(spark, folder):
    return _decided(suppress(v.alerts(spark, folder)))


def sliding(spark, folder):
    return sliding_services(v.alerts(spark, folder), SCALED.storm_window).select(
        "event_id", "service", F.col("services").cast("bigint").alias("services"))


def reasons(spark, folder):
    return suppression_counts(suppress(v.alerts(spark, folder), SCALED))


def clear_times(spark, folder):
    return v.table(spark, folder, "events").filter("event_id % 97 = 0").select(F.col("ts").cast("timestamp").alias("ts"))


def overrides(spark, folder):
    decisions = suppress(v.alerts(spark, folder), SCALED, clears=clear_times(spark, folder))
    as_of = v.moment(base.AS_OF)
    return remaining_ttl(decisions, as_of).select("scope", "service", F.round("ttl", 3).alias("ttl"))


def cleared(spark, folder):
    return _decided(suppress(v.alerts(spark, folder), SCALED, clears=clear_times(spark, folder)))


def severities(spark, folder):
    rows = d.detect(base.feature_rows(spark, folder), detection=SENSITIVE)
    kind = F.when(F.col("max_z") > 5, "zscore_critical").when(F.col("tier1_fired"), "both_tiers").when(
        F.col("learning"), "system_wide_incident").otherwise("none")
    return rows.select("service", ts_us(), kind.alias("anomaly_type"),
                       severity(kind, F.col("max_z")).alias("severity"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return emit_events(d.detect(base.feature_rows(spark, folder), detection=SENSITIVE), settings=WINDOWED)


def _event_columns(rows: DataFrame) -> DataFrame:
    observed = F.array_join(F.transform(F.map_entries("observed"), lambda e: F.concat(
        e["key"], F.lit("="), F.round(e["value"], 3).cast("string"))), ";")
    counts = F.array_join(F.transform(F.map_entries("baseline"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"]["sample_count"].cast("string"))), ";")
    return rows.select(
        "event_id", "service", "anomaly_type", "severity", F.round("z_score", 6).alias("z_score"), ts_us(),
        observed.alias("observed"), counts.alias("baseline"),
        F.array_join(F.array_sort("correlated_services"), ",").alias("correlated_services"), "timestamp")


def single_events(spark, folder):
    return _event_columns(events(spark, folder).filter("service <> 'system'"))


def storm_events(spark, folder):
    return _event_columns(events(spark, folder).filter("service = 'system'"))


def whole_chain(spark, folder):
    return _event_columns(events(spark, folder))


def limited(spark, folder):
    return rate_limit(v.alerts(spark, folder), SCALED_LIMITER).select("event_id", "service", "allowed")


def limited_default(spark, folder):
    return rate_limit(v.alerts(spark, folder), ALERT_LIMITER).select("event_id", "service", "allowed")


def requests(spark, folder):
    calls = v.table(spark, folder, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return rate_limit(calls, ACCESS_LIMITER, key="user_id").select("event_id", "user_id", "allowed", "remaining")


def limiter_counts(spark, folder):
    return rate_limit(v.alerts(spark, folder), SCALED_LIMITER).select("event_id", "service", "current_count")


QUERIES = {
    "A1_cooldown": cooled,
    "A1_cooldown_default": cooled_default,
    "A2_storms": storms,
    "A2_storms_default": storms_default,
    "A3_sliding_services": sliding,
    "A4_suppression_counts": reasons,
    "A5_remaining_ttl": overrides,
    "A5_cleared_storms": cleared,
    "E1_severity": severities,
    "E2_events": single_events,
    "E3_storm_events": storm_events,
    "E4_detect_to_events": whole_chain,
    "L1_alert_limiter": limited,
    "L1_alert_limiter_default": limited_default,
    "L2_request_limiter": requests,
    "L3_current_count": limiter_counts,
}

NAMES = "[" + ", ".join(f"'{s}'" for s in sorted(v.SERVICES)) + "]"


def storm_sql(source: str, s: SuppressionSettings, clears: str | None = None) -> str:
    """Ordered state machine over `source` (service, ts_us, id)."""
    second = 1_000_000
    clear_rows = f"UNION ALL SELECT '' AS service, ts_us, NULL AS id, true AS is_clear FROM {clears}" if clears else ""
    empty = "[NULL::BIGINT, NULL, NULL, NULL, NULL, NULL, NULL, NULL]"
    return f"""ordered_alerts AS (
  SELECT *, row_number() OVER (ORDER BY ts_us, service, id) AS rn, list_position({NAMES}, service) AS idx FROM (
    SELECT service, ts_us, id, false AS is_clear FROM {source} {clear_rows})),
machine AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS reason, {empty} AS cooled, {empty} AS recent, CAST(0 AS BIGINT) AS storm_until
  UNION ALL
  SELECT rn, CASE WHEN first_reason = 'allowed' AND members > {s.storm_threshold} THEN 'storm' ELSE first_reason END,
    cooled, recent,
    CASE WHEN first_reason = 'clear' THEN 0 WHEN first_reason = 'allowed' AND members > {s.storm_threshold}
      THEN ts_us + {s.storm_cooldown * second} ELSE storm_until END
  FROM (
    SELECT rn, ts_us, first_reason, cooled, recent, storm_until,
      CAST(list_count(recent) AS BIGINT) AS members
    FROM (
      SELECT rn, ts_us, first_reason, storm_until,
        CASE WHEN first_reason = 'allowed' THEN list_transform(range(1, 9), lambda i: CASE WHEN i = idx THEN ts_us + {s.cooldown * second} ELSE cooled[i] END)
          ELSE cooled END AS cooled,
        CASE WHEN first_reason = 'clear' THEN {empty} ELSE list_transform(range(1, 9), lambda i:
          CASE WHEN i = idx AND first_reason = 'allowed' THEN ts_us WHEN recent[i] > ts_us - {s.storm_window * second} THEN recent[i] END) END AS recent
      FROM (
        SELECT a.rn, a.ts_us, a.idx, m.cooled, m.recent, m.storm_until,
          CASE WHEN a.is_clear THEN 'clear' WHEN a.ts_us < m.cooled[a.idx] THEN 'cooldown'
            WHEN a.ts_us < m.storm_until THEN 'storm_active' ELSE 'allowed' END AS first_reason
        FROM machine m JOIN ordered_alerts a ON a.rn = m.rn + 1)))),
decisions AS (
  SELECT a.id, a.service, a.ts_us, m.reason, m.reason = 'allowed' AS allowed, m.reason = 'storm' AS is_storm,
    coalesce(array_to_string(list_filter({NAMES}, lambda n, i: m.recent[i] IS NOT NULL), ','), '') AS storm_services,
    m.cooled, m.storm_until, a.rn
  FROM machine m JOIN ordered_alerts a ON a.rn = m.rn)"""


def cooldown_sql(seconds: int) -> str:
    return v.with_ctes(v.LOGS, v.ALERTS) + f""", passed AS (
  SELECT service, min(epoch_us(ts)) AS passed_at FROM alerts GROUP BY service
  UNION ALL
  SELECT p.service, (SELECT min(epoch_us(a.ts)) FROM alerts a WHERE a.service = p.service AND epoch_us(a.ts) >= p.passed_at + {seconds * 1_000_000})
  FROM passed p WHERE p.passed_at IS NOT NULL)
SELECT a.event_id, a.service, p.passed_at IS NOT NULL AS allowed FROM alerts a LEFT JOIN passed p ON p.service = a.service AND p.passed_at = epoch_us(a.ts)"""


def limiter_sql(source: str, key: str, s: LimiterSettings) -> str:
    """Ordered state machine per key over `source` (key, ts_us, id)."""
    keep = f"t > c.ts_us - {s.window * 1_000_000}" if s.left_open else f"t >= c.ts_us - {s.window * 1_000_000}"
    return f"""calls AS (SELECT {key} AS k, ts_us, id, row_number() OVER (PARTITION BY {key} ORDER BY ts_us, id) AS rn FROM {source}),
limiter AS (
  SELECT k, rn, ts_us, id, true AS allowed, [ts_us] AS kept, CAST(1 AS BIGINT) AS current_count FROM calls WHERE rn = 1
  UNION ALL
  SELECT k, rn, ts_us, id, free, CASE WHEN free THEN list_append(kept, ts_us) ELSE kept END,
    CAST(len(kept) AS BIGINT) + CASE WHEN free THEN 1 ELSE 0 END
  FROM (SELECT *, len(kept) < {s.limit} AS free FROM (
    SELECT c.k, c.rn, c.ts_us, c.id, list_filter(l.kept, lambda t: {keep}) AS kept
    FROM limiter l JOIN calls c ON c.k = l.k AND c.rn = l.rn + 1)))"""


ALERT_ROWS = "alert_rows AS (SELECT service, epoch_us(ts) AS ts_us, event_id AS id FROM alerts)"
CLEARS = "clears AS (SELECT epoch_us(ts) AS ts_us FROM events WHERE event_id % 97 = 0)"


def _storms(s: SuppressionSettings, with_clears: bool = False) -> str:
    parts = [v.LOGS, v.ALERTS, ALERT_ROWS] + ([CLEARS] if with_clears else [])
    return v.with_ctes(*parts, storm_sql("alert_rows", s, "clears" if with_clears else None))


def _limited(s: LimiterSettings) -> str:
    return v.with_ctes(v.LOGS, v.ALERTS, ALERT_ROWS, limiter_sql("alert_rows", "service", s))


STORM_COLUMNS = "SELECT id AS event_id, service, reason, allowed, is_storm, storm_services FROM decisions WHERE reason <> 'clear'"
# Detections with a critical threshold of 3, suppressed with the window-scaled settings.
FOUND = """found AS (
  SELECT service, ts_us, max_z, sha256(service || '|' || CAST(ts_us AS VARCHAR)) AS id FROM judged
  WHERE NOT learning AND max_z > 3.0)"""
EVENTS = """gathered AS (
  SELECT service, ts_us,
    string_agg(metric || '=' || CAST(round(value, 3) AS VARCHAR), ';' ORDER BY list_position(['error_rate', 'p99_latency_ms', 'avg_latency_ms', 'request_volume', 'warn_rate'], metric)) AS observed,
    string_agg(metric || '=' || CAST(sample_count AS VARCHAR), ';' ORDER BY list_position(['error_rate', 'p99_latency_ms', 'avg_latency_ms', 'request_volume', 'warn_rate'], metric)) AS baseline
  FROM history GROUP BY service, ts_us),
built AS (
  SELECT d.id AS event_id, CASE WHEN is_storm THEN 'system' ELSE d.service END AS service,
    CASE WHEN is_storm THEN 'system_wide_incident' ELSE 'zscore_critical' END AS anomaly_type,
    CASE WHEN is_storm OR f.max_z > 5.0 THEN 'P1' ELSE 'P3' END AS severity, round(f.max_z, 6) AS z_score, d.ts_us,
    CASE WHEN is_storm THEN '' ELSE observed END AS observed, CASE WHEN is_storm THEN '' ELSE baseline END AS baseline,
    storm_services AS correlated_services,
    strftime(make_timestamp(d.ts_us), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp,
    f.max_z, d.is_storm
  FROM decisions d JOIN found f ON f.id = d.id JOIN gathered g ON g.service = d.service AND g.ts_us = d.ts_us
  WHERE allowed OR is_storm)"""
CHAIN_PARTS = (v.LOGS, v.windows_sql(v.HOURS_6), base.history_sql(), base.SCORED, FOUND, storm_sql("found", WINDOWED), EVENTS)
CHAIN = v.with_ctes(*CHAIN_PARTS)
EVENT_COLUMNS = """SELECT event_id, service, anomaly_type, severity, z_score, ts_us, observed, baseline, correlated_services, timestamp
FROM built"""

ORACLE = {
    "A1_cooldown": cooldown_sql(SCALED.cooldown),
    "A1_cooldown_default": cooldown_sql(600),
    "A2_storms": _storms(SCALED) + STORM_COLUMNS,
    "A2_storms_default": _storms(SuppressionSettings()) + STORM_COLUMNS,
    "A3_sliding_services": v.with_ctes(v.LOGS, v.ALERTS) + f"""SELECT a.event_id, a.service, count(DISTINCT b.service) AS services
FROM alerts a JOIN alerts b ON epoch_us(b.ts) <= epoch_us(a.ts) AND epoch_us(b.ts) > epoch_us(a.ts) - {SCALED.storm_window * 1_000_000}
GROUP BY a.event_id, a.service""",
    "A4_suppression_counts": _storms(SCALED) + """SELECT service, reason, count(*) AS suppressed FROM decisions
WHERE reason IN ('cooldown', 'storm_active') GROUP BY ALL""",
    "A5_remaining_ttl": _storms(SCALED, True) + f""", past AS (SELECT * FROM decisions WHERE ts_us <= {base.AS_OF_US} AND reason <> 'clear')
SELECT 'cooldown' AS scope, service, round(greatest(0.0, (max(cooled[list_position({NAMES}, service)]) - {base.AS_OF_US}) / 1000000.0), 3) AS ttl
FROM past GROUP BY service
UNION ALL SELECT 'storm', 'system', round(greatest(0.0, (max(greatest(storm_until, ts_us)) - {base.AS_OF_US}) / 1000000.0), 3) FROM past""",
    "A5_cleared_storms": _storms(SCALED, True) + STORM_COLUMNS,
    "E1_severity": base.FULL + """SELECT service, ts_us, anomaly_type, CASE WHEN anomaly_type = 'system_wide_incident' OR max_z > 5 THEN 'P1'
  WHEN anomaly_type = 'both_tiers' THEN 'P2' ELSE 'P3' END AS severity FROM (
  SELECT *, CASE WHEN max_z > 5 THEN 'zscore_critical' WHEN tier1_fired THEN 'both_tiers' WHEN learning THEN 'system_wide_incident'
    ELSE 'none' END AS anomaly_type FROM judged)""",
    "E2_events": CHAIN + EVENT_COLUMNS + " WHERE service <> 'system'",
    "E3_storm_events": CHAIN + EVENT_COLUMNS + " WHERE service = 'system'",
    "E4_detect_to_events": CHAIN + EVENT_COLUMNS,
    "L1_alert_limiter": _limited(SCALED_LIMITER) + "SELECT id AS event_id, k AS service, allowed FROM limiter",
    "L1_alert_limiter_default": _limited(ALERT_LIMITER) + "SELECT id AS event_id, k AS service, allowed FROM limiter",
    "L2_request_limiter": v.with_ctes("access_log AS (SELECT user_id, epoch_us(ts) AS ts_us, event_id AS id FROM events)",
                                      limiter_sql("access_log", "user_id", ACCESS_LIMITER))
    + f"SELECT id AS event_id, k AS user_id, allowed, {ACCESS_LIMITER.limit} - current_count AS remaining FROM limiter",
    "L3_current_count": _limited(SCALED_LIMITER) + "SELECT id AS event_id, k AS service, current_count FROM limiter",
}

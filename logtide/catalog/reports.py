"""Incident reports, routing and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.catalog import alerts as al
from logtide.catalog import views as v
from logtide.functions.scalars import iso_utc
from logtide.operators import reports as rp
from logtide.operators.enrich import with_owner
from logtide.operators.limiter import rate_limit


def anomaly_events(spark: SparkSession, folder: str) -> DataFrame:
    """Enriched anomaly events made from the error logs."""
    i = F.col("event_id")

    def state(ewma):
        return F.struct(ewma.cast("double").alias("ewma"), F.lit(5).cast("bigint").alias("sample_count"))

    number = (i % 3).cast("int")
    rows = v.alerts(spark, folder).select(
        "event_id", "service", "ts", iso_utc(F.col("ts")).alias("timestamp"),
        F.when(i % 30 == 2, "system_wide_incident").when(number == 0, "zscore_critical")
        .when(number == 1, "both_tiers").otherwise("other").alias("anomaly_type"),
        F.concat(F.lit("P"), (i % 4 + 1).cast("string")).alias("severity"),
        (F.col("latency_ms") / F.lit(10.0)).alias("z_score"),
        F.create_map(
            F.lit("error_rate"), (i % 100) / F.lit(100.0),
            F.lit("p99_latency_ms"), F.col("latency_ms").cast("double"),
            F.lit("warn_rate"), (i % 7) / F.lit(8.0)).alias("observed"),
        F.map_filter(F.create_map(
            F.lit("error_rate"), state((i % 10) / F.lit(20.0)),
            F.lit("p99_latency_ms"), state(F.lit(50.0)),
            F.lit("warn_rate"), F.when(i % 5 != 0, state(F.lit(0.5)))), lambda _, x: x.isNotNull()).alias("baseline"),
        F.array("service", v.service_of(F.col("user_id") + 1)).alias("correlated_services"),
        F.array(F.struct("message", F.lit(1).cast("bigint").alias("count"))).alias("top_log_samples"),
        F.lit(0).alias("pii_scrub_count"))
    return with_owner(rows, v.registry(spark))


EVENTS = """events_in AS (
  SELECT a.*, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp,
    CASE WHEN event_id % 30 = 2 THEN 'system_wide_incident' WHEN event_id % 3 = 0 THEN 'zscore_critical'
      WHEN event_id % 3 = 1 THEN 'both_tiers' ELSE 'other' END AS anomaly_type,
    'P' || CAST(event_id % 4 + 1 AS VARCHAR) AS severity, CAST(latency_ms AS DOUBLE) / 10 AS z_score,
    CAST(event_id % 100 AS DOUBLE) / 100 AS o1, CAST(latency_ms AS DOUBLE) AS o2, CAST(event_id % 7 AS DOUBLE) / 8 AS o3,
    CAST(event_id % 10 AS DOUBLE) / 20 AS b1, CAST(50 AS DOUBLE) AS b2,
    CASE WHEN event_id % 5 <> 0 THEN CAST(0.5 AS DOUBLE) END AS b3,
    CASE (user_id + 1) % 8 WHEN 0 THEN 'payment-svc' WHEN 1 THEN 'auth-svc' WHEN 2 THEN 'order-svc'
      WHEN 3 THEN 'inventory-svc' WHEN 4 THEN 'notification-svc' WHEN 5 THEN 'api-gateway'
      WHEN 6 THEN 'recommendation-svc' ELSE 'search-svc' END AS other
  FROM alerts a),
reports_in AS (
  SELECT *, 'Anomaly detected in ' || service || ': ' || anomaly_type || ' (z=' || printf('%.2f', z_score)
      || '). AI analysis unavailable — review raw metrics.' AS summary,
    service || ',' || other AS affected,
    'error_rate: observed=' || CAST(o1 AS VARCHAR) || '|p99_latency_ms: observed=' || CAST(o2 AS VARCHAR)
      || '|warn_rate: observed=' || CAST(o3 AS VARCHAR) AS evidence FROM events_in),
owned AS (
  SELECT e.*, coalesce(r.team, d.team) AS team FROM reports_in e
  LEFT JOIN registry r ON r.service = e.service AND r.service <> 'default'
  LEFT JOIN registry d ON d.service = 'default'),
merged AS (
  SELECT *, event_id % 4 = 0 AS ai_generated,
    CASE WHEN event_id % 4 <> 0 THEN severity WHEN event_id % 8 = 0 THEN 'P2' ELSE severity END AS new_severity,
    CASE WHEN event_id % 4 <> 0 THEN summary WHEN event_id % 12 = 0 THEN 'Cause ' || CAST(event_id AS VARCHAR) ELSE '' END AS new_summary,
    CASE WHEN event_id % 4 <> 0 THEN affected ELSE service END AS new_affected,
    CASE WHEN event_id % 4 <> 0 THEN 0.0 ELSE least(1.0, CAST(event_id % 30 AS DOUBLE) / 20) END AS confidence
  FROM owned)"""


def reports(spark: SparkSession, folder: str) -> DataFrame:
    return rp.fallback_reports(anomaly_events(spark, folder), F.lit("2024-02-01").cast("timestamp"))


def analysis(spark: SparkSession, folder: str) -> DataFrame:
    """External analyses of every fourth event, with missing fields and odd confidences."""
    i = F.col("event_id")
    none = F.lit(None)
    return v.alerts(spark, folder).filter(i % 4 == 0).select(
        "event_id", F.when(i % 8 == 0, "P2").alias("severity"),
        F.when(i % 12 == 0, F.concat(F.lit("Cause "), i.cast("string"))).alias("summary"),
        none.cast("array<string>").alias("affected_services"), none.cast("string").alias("probable_cause"),
        none.cast("array<string>").alias("evidence"), none.cast("array<string>").alias("suggested_actions"),
        none.cast("string").alias("estimated_user_impact"), ((i % 30) / F.lit(20.0)).alias("confidence_score"))


def merged_reports(spark: SparkSession, folder: str) -> DataFrame:
    return rp.merge_analysis(reports(spark, folder), analysis(spark, folder))


def with_time(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.to_timestamp("timestamp"))


def fallback(spark, folder):
    return reports(spark, folder).select(
        "event_id", "service", "severity", "summary", F.array_join("affected_services", ",").alias("affected"),
        F.array_join("evidence", "|").alias("evidence"), "confidence_score", "ai_generated",
        F.size("suggested_actions").cast("bigint").alias("actions"))


def merged(spark, folder):
    return merged_reports(spark, folder).select(
        "event_id", "severity", "summary", F.array_join("affected_services", ",").alias("affected"),
        F.round("confidence_score", 6).alias("confidence"), "ai_generated")


def rules(spark, folder):
    return rp.with_rule(anomaly_events(spark, folder)).select(
        "event_id", "severity", F.array_join("channels", ",").alias("channels"),
        F.array_join("slack_channels", ",").alias("targets"), "send_email", "send_pagerduty")


def routes(spark, folder):
    return rp.route(reports(spark, folder)).select(
        "event_id", F.array_join("slack_targets", ",").alias("targets"),
        F.array_join("email_recipients", ",").alias("emails"), "send_pagerduty")


def limits(spark: SparkSession, folder: str) -> DataFrame:
    return rate_limit(v.alerts(spark, folder), al.SCALED_LIMITER)


def dispatched(spark, folder):
    rows = rp.dispatch(rp.route(reports(spark, folder)), limits(spark, folder))
    return rows.select(
        "event_id", "service", F.array_join("channels_dispatched", ",").alias("channels"),
        F.array_join("slack_targets_notified", ",").alias("targets"), "pagerduty_triggered", "rate_limited",
        "digest_pending_count")


def digests(spark, folder):
    limited = limits(spark, folder).filter(~F.col("allowed")).select("event_id")
    rows = merged_reports(spark, folder).join(limited, "event_id")
    day = F.substring("timestamp", 1, 10)
    return rp.digests(rows, day).select(
        "service", "period", "suppressed", F.round("max_z", 6).alias("max_z"),
        F.round("avg_confidence", 6).alias("avg_confidence"), "title", "lines")


def primary(spark, folder):
    return rp.header_text(reports(spark, folder)).select(
        "event_id", "primary_metric", F.round("primary_pct", 6).alias("primary_pct"))


def headers(spark, folder):
    return rp.header_text(reports(spark, folder)).select("event_id", "header")


def repeated(spark, folder):
    logs = v.logs(spark, folder).select(
        F.concat_ws("/", "service", F.date_format("event_time", "yyyy-MM-dd")).alias("event_id"),
        F.col("event_id").alias("pos"), "message")
    rows = rp.repeated_messages(logs)
    return rows.select("event_id", F.col("rank").cast("bigint").alias("rank"),
                       rp.message_line(F.col("rank"), F.col("message"), F.col("count")).alias("line"))


def paging(spark, folder):
    return rp.paging_actions(reports(spark, folder)).select("event_id", "dedup_key", "action")


def incidents(spark, folder):
    rows = rp.incident_state(rp.paging_actions(with_time(reports(spark, folder))))
    return rows.select("dedup_key", "last_action", "is_open", "changes", F.unix_millis("last_change").alias("last_ms"))


def paging_severity(spark, folder):
    return rp.paging_actions(reports(spark, folder)).groupBy("severity", "paging_severity").agg(F.count("*").alias("n"))


QUERIES = {
    "T1_fallback_report": fallback,
    "T2_merged_report": merged,
    "T3_routing_rules": rules,
    "T4_routes": routes,
    "T5_dispatch": dispatched,
    "T6_digests": digests,
    "T7_primary_metric": primary,
    "T8_headers": headers,
    "T9_repeated_messages": repeated,
    "T10_paging_actions": paging,
    "T11_incident_state": incidents,
    "T12_paging_severity": paging_severity,
}

BASE = v.with_ctes(v.LOGS, v.ALERTS, v.REGISTRY, EVENTS)
_CHANNELS = "CASE severity WHEN 'P1' THEN 'pagerduty,slack,email' WHEN 'P2' THEN 'slack,email' ELSE 'slack' END"
_TARGET = "CASE severity WHEN 'P1' THEN '#incidents' WHEN 'P2' THEN '#alerts' ELSE '#monitoring' END"
_LIMITED = v.with_ctes(v.LOGS, v.ALERTS, v.REGISTRY, EVENTS, al.ALERT_ROWS, al.limiter_sql("alert_rows", "service", al.SCALED_LIMITER))
_PRIMARY = """, changes AS (
  SELECT event_id, pos, metric, CASE WHEN b <> 0 THEN (o - b) / abs(b) * 100 END AS pct FROM (
    SELECT event_id, 1 AS pos, 'Error Rate' AS metric, o1 AS o, b1 AS b FROM events_in
    UNION ALL SELECT event_id, 2, 'P99 Latency', o2, b2 FROM events_in
    UNION ALL SELECT event_id, 3, 'Warn Rate', o3, b3 FROM events_in)),
best AS (SELECT event_id, metric, pct FROM changes WHERE pct IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(pct) DESC, pos) = 1)
"""

ORACLE = {
    "T1_fallback_report": BASE + """SELECT event_id, service, severity, summary, affected, evidence,
  CAST(0 AS DOUBLE) AS confidence_score, false AS ai_generated, CAST(4 AS BIGINT) AS actions FROM reports_in""",
    "T2_merged_report": BASE + """SELECT event_id, new_severity AS severity, new_summary AS summary, new_affected AS affected,
  round(confidence, 6) AS confidence, ai_generated FROM merged""",
    "T3_routing_rules": BASE + f"""SELECT event_id, severity, {_CHANNELS} AS channels, {_TARGET} AS targets,
  severity IN ('P1', 'P2') AS send_email, severity = 'P1' AS send_pagerduty FROM events_in""",
    "T4_routes": BASE + f"""SELECT event_id, {_TARGET} || ',#' || team AS targets,
  CASE WHEN severity IN ('P1', 'P2') THEN team || '@example.org' ELSE '' END AS emails, severity = 'P1' AS send_pagerduty FROM owned""",
    "T5_dispatch": _LIMITED + f"""SELECT o.event_id, o.service, CASE WHEN l.allowed THEN {_CHANNELS} ELSE '' END AS channels,
  CASE WHEN l.allowed THEN {_TARGET} || ',#' || team ELSE '' END AS targets, l.allowed AND severity = 'P1' AS pagerduty_triggered,
  NOT l.allowed AS rate_limited, CASE WHEN l.allowed THEN 0 ELSE count(*) FILTER (NOT l.allowed) OVER (
    PARTITION BY o.service ORDER BY l.ts_us, l.id ROWS UNBOUNDED PRECEDING) END AS digest_pending_count
FROM owned o JOIN limiter l ON l.id = o.event_id""",
    "T6_digests": _LIMITED + """, rows_in AS (SELECT m.*, timestamp[1:10] AS period, '• [' || new_severity || '] `' || anomaly_type || '` z=' || printf('%.1f', z_score)
    || ' — ' || CASE WHEN length(new_summary) > 60 THEN new_summary[1:60] || '…' ELSE new_summary END || ' — _'
    || replace(timestamp[1:19], 'T', ' ') || '_' AS line FROM merged m JOIN limiter l ON l.id = m.event_id WHERE NOT l.allowed)
SELECT service, period, count(*) AS suppressed, round(max(z_score), 6) AS max_z, round(avg(confidence), 6) AS avg_confidence,
  'Alert digest for ' || service || ': ' || CAST(count(*) AS VARCHAR) || ' suppressed alert' || CASE WHEN count(*) <> 1 THEN 's' ELSE '' END AS title,
  string_agg(line, chr(10) ORDER BY timestamp, event_id) AS lines FROM rows_in GROUP BY service, period""",
    "T7_primary_metric": BASE + _PRIMARY + "SELECT event_id, metric AS primary_metric, round(pct, 6) AS primary_pct FROM best",
    "T8_headers": BASE + _PRIMARY + """SELECT e.event_id, CASE WHEN anomaly_type = 'system_wide_incident'
    THEN '[' || severity || '] System-Wide Incident — Multiple Services Affected'
  ELSE '[' || severity || '] ' || service || ' — ' || metric || ' ' || CASE anomaly_type WHEN 'zscore_critical' THEN 'Spike' ELSE 'Anomaly' END
    || ' (' || CASE WHEN pct >= 0 THEN '+' ELSE '' END
    || CASE WHEN pct < 0 AND round_even(pct, 0) = 0 THEN '-0' ELSE CAST(CAST(round_even(pct, 0) AS BIGINT) AS VARCHAR) END || '%)' END AS header
FROM events_in e JOIN best b ON b.event_id = e.event_id""",
    "T9_repeated_messages": v.with_ctes(v.LOGS) + """, counted AS (
  SELECT service || '/' || strftime(event_time, '%Y-%m-%d') AS event_id, message, count(*) AS n, min(event_id) AS first
  FROM logs GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, first) AS rank FROM counted)
SELECT event_id, rank, CAST(rank AS VARCHAR) || '. `' || message || '`' || CASE WHEN n > 1 THEN ' ×' || CAST(n AS VARCHAR) ELSE '' END AS line
FROM ranked WHERE rank <= 3""",
    "T10_paging_actions": BASE + """SELECT event_id, service || '_' || anomaly_type AS dedup_key,
  CASE WHEN z_score < 1.5 THEN 'resolve' ELSE 'trigger' END AS action FROM events_in""",
    "T11_incident_state": BASE + """SELECT service || '_' || anomaly_type AS dedup_key,
  max_by(CASE WHEN z_score < 1.5 THEN 'resolve' ELSE 'trigger' END, (ts, event_id)) AS last_action,
  max_by(z_score >= 1.5, (ts, event_id)) AS is_open, count(*) AS changes, (epoch_us(max(ts)) // 1000) AS last_ms FROM events_in GROUP BY 1""",
    "T12_paging_severity": BASE + """SELECT severity, CASE severity WHEN 'P1' THEN 'critical' WHEN 'P2' THEN 'error' ELSE 'warning' END AS paging_severity,
  count(*) AS n FROM events_in GROUP BY 1, 2""",
}

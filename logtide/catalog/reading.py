"""Read queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from logtide.catalog import alerts as al
from logtide.catalog import reports as rep
from logtide.catalog import views as v
from logtide.operators.suppress import cooldown
from logtide.plans import read
from logtide.session import scratch_dir
from logtide.sources.readers import read_message_files
from logtide.sources.writers import event_messages
from logtide.streaming.jobs import run_to_table

AS_OF = "2024-01-20 00:00:00"
AS_OF_SQL = "TIMESTAMP '2024-01-20 00:00:00'"
START = "2024-01-05"


def stored_reports(spark, folder):
    rows = rep.with_time(rep.reports(spark, folder)).withColumn("event_id", F.col("event_id").cast("string"))
    return rows.withColumn("report_id", F.concat(F.lit("r"), "event_id"))


def acks(spark, folder):
    """Two acknowledgements of every seventh alert."""
    rows = v.alerts(spark, folder).filter("event_id % 7 = 0")
    return rows.select(
        F.col("event_id").cast("string").alias("event_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("ack_id"),
        F.col("ts")).withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.col("ack_id") * 1_000_000))


def silence_requests(spark, folder):
    return v.logs(spark, folder).filter("event_id % 211 = 0").select(
        "service", F.col("event_time").alias("ts"), (F.col("event_id") % 3 * 720 + 60).alias("minutes"))


def anomalies_page(spark, folder):
    rows = read.list_anomalies(stored_reports(spark, folder), v.moment(START), v.moment(AS_OF), acks(spark, folder), page=2, size=50)
    return rows.select("event_id", "report_id", "service", "severity", "anomaly_type",
                       F.round("z_score", 6).alias("z_score"), F.unix_millis("ts").alias("ts_ms"), "summary", "acknowledged")


def anomalies_total(spark, folder):
    return read.count_anomalies(stored_reports(spark, folder), v.moment(START), v.moment(AS_OF), "order-svc")


def acknowledged(spark, folder):
    return read.acknowledge(acks(spark, folder)).select(
        "event_id", F.col("ack_id").cast("bigint").alias("ack_id"), "already_set")


def logs_page(spark, folder):
    rows = read.search_logs(v.logs(spark, folder), v.moment(START), v.moment(AS_OF), "auth-svc", "error", page=2, size=20)
    return rows.select("event_id", F.unix_micros("event_time").alias("ts_us"), "service", "level", "message")


def report_by_id(spark, folder):
    """Looked up by report id, by event id, and not found."""
    stored = stored_reports(spark, folder)
    # The first event id is looked up as an event id, then as a report id.
    key = stored.agg(F.min("event_id")).first()[0]
    found = [read.get_report(stored, k).select(F.lit(n).alias("lookup"), "report_id", "event_id", "service")
             for n, k in (("event", key), ("report", f"r{key}"), ("none", "missing"))]
    return found[0].unionByName(found[1]).unionByName(found[2])


def silences(spark, folder):
    return read.silence(silence_requests(spark, folder))


def rejected(spark, folder):
    """Requests with minutes missing or out of bounds."""
    asked = silence_requests(spark, folder).withColumn("minutes", F.expr("CASE WHEN minutes < 100 THEN null ELSE minutes * 2 END"))
    return read.rejected_silences(asked).groupBy("service", "reason").agg(F.count("*").alias("n"))


def default_pages(spark, folder):
    """The first pages without a start: the last day of anomalies, the last hour of logs."""
    end = v.moment(AS_OF)
    anomalies = read.list_anomalies(stored_reports(spark, folder), None, end, size=200)
    logs = read.search_logs(v.logs(spark, folder), None, end, size=500)
    return anomalies.select(F.lit("anomaly").alias("origin"), "event_id").unionByName(
        logs.select(F.lit("log").alias("origin"), F.col("event_id").cast("string").alias("event_id")))


def services(spark, folder):
    passed = cooldown(v.alerts(spark, folder), al.SCALED.cooldown).filter("allowed")
    return read.list_services(v.registry(spark), stored_reports(spark, folder), v.moment(AS_OF), passed,
                              silences(spark, folder), cooldown=al.SCALED.cooldown)


def metric_points(spark, folder):
    rows = read.service_metrics(stored_reports(spark, folder), "api-gateway", v.moment(AS_OF), hours=240)
    return rows.select("event_id", F.unix_millis("ts").alias("ts_ms"), F.round("z_score", 6).alias("z_score"), "severity",
                       F.element_at("observed_metrics", "p99_latency_ms").alias("p99"))


def healths(spark, folder):
    passed = cooldown(v.alerts(spark, folder), al.SCALED.cooldown).filter("allowed")
    return read.health(passed, v.moment(AS_OF), al.SCALED.cooldown)


def silenced_flags(spark, folder):
    return read.mark_silenced(v.alerts(spark, folder), silences(spark, folder)).select("event_id", "service", "silenced")


def without_silenced(spark, folder):
    return read.drop_silenced(v.alerts(spark, folder), silences(spark, folder)).select("event_id", "service")


def feed(spark, folder):
    """Stream of event messages, some of them not JSON, read from files."""
    base = scratch_dir(spark, "feed")
    events = rep.anomaly_events(spark, folder).select(
        F.col("event_id").cast("string").alias("event_id"), "service",
        F.when(F.col("event_id") % 9 != 0, F.col("anomaly_type")).alias("anomaly_type"))
    messages = event_messages(events).withColumn(
        "value", F.when(F.col("value").contains('7"'), F.expr("left(value, 10)")).otherwise(F.col("value")))
    messages.select("key", "value", F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"),
                    F.lit(None).cast("timestamp").alias("timestamp")).write.parquet(f"{base}/in")
    stream = read.live_feed(read_message_files(spark, f"{base}/in"), "order-svc")
    return run_to_table(stream, f"{base}/out", f"{base}/checkpoint").select("event", "id")


QUERIES = {
    "Q1_list_anomalies": anomalies_page,
    "Q1_count_anomalies": anomalies_total,
    "Q2_acknowledge": acknowledged,
    "Q3_search_logs": logs_page,
    "Q4_get_report": report_by_id,
    "Q5_list_services": services,
    "Q6_service_metrics": metric_points,
    "Q7_health": healths,
    "Q8_silenced": silenced_flags,
    "Q3_default_ranges": default_pages,
    "Q8_rejected": rejected,
    "Q8_drop_silenced": without_silenced,
    "Q9_live_feed": feed,
}

SILENCES = """silences AS (
  SELECT service, event_time AS from_ts, event_time + to_minutes(event_id % 3 * 720 + 60) AS to_ts FROM logs
  WHERE event_id % 211 = 0 AND event_id % 3 * 720 + 60 BETWEEN 1 AND 1440)"""
_COOL = al.cooldown_sql(al.SCALED.cooldown)
_PASSED = _COOL[:_COOL.rindex("SELECT a.event_id")]
_HEALTH = f"""(SELECT service, CASE WHEN {al.base.AS_OF_US} - max(passed_at) < {al.SCALED.cooldown * 1_000_000} THEN 'degraded' ELSE 'healthy' END AS health
  FROM passed WHERE passed_at <= {al.base.AS_OF_US} GROUP BY service)"""
_FLAGS = v.with_ctes(v.LOGS, v.ALERTS, SILENCES) + """, flags AS (
SELECT a.event_id, a.service, bool_or(s.service IS NOT NULL) AS silenced FROM alerts a
LEFT JOIN silences s ON s.service = a.service AND s.from_ts <= a.ts AND s.to_ts > a.ts GROUP BY ALL)
"""

ORACLE = {
    "Q1_list_anomalies": rep.BASE + f"""SELECT CAST(event_id AS VARCHAR) AS event_id, 'r' || CAST(event_id AS VARCHAR) AS report_id, service, severity,
  anomaly_type, round(z_score, 6) AS z_score, (epoch_us(ts) // 1000) AS ts_ms, summary, event_id % 7 = 0 AS acknowledged
FROM reports_in WHERE date_trunc('millisecond', ts) BETWEEN TIMESTAMP '2024-01-05' AND {AS_OF_SQL}
ORDER BY date_trunc('millisecond', ts) DESC, CAST(event_id AS VARCHAR) DESC LIMIT 50 OFFSET 50""",
    "Q1_count_anomalies": rep.BASE + f"""SELECT count(*) AS total FROM reports_in WHERE service = 'order-svc'
  AND date_trunc('millisecond', ts) BETWEEN TIMESTAMP '2024-01-05' AND {AS_OF_SQL}""",
    "Q2_acknowledge": v.with_ctes(v.LOGS, v.ALERTS) + """SELECT CAST(event_id AS VARCHAR) AS event_id, ack_id, ack_id > 1 AS already_set
FROM alerts, (VALUES (CAST(1 AS BIGINT)), (2)) a(ack_id) WHERE event_id % 7 = 0""",
    "Q3_search_logs": v.with_ctes(v.LOGS) + f"""SELECT event_id, epoch_us(event_time) AS ts_us, service, level, message FROM logs
WHERE service = 'auth-svc' AND level = 'ERROR' AND event_time BETWEEN TIMESTAMP '2024-01-05' AND {AS_OF_SQL}
ORDER BY event_time DESC, event_id DESC LIMIT 20 OFFSET 20""",
    "Q3_default_ranges": rep.BASE + f"""SELECT 'anomaly' AS origin, CAST(event_id AS VARCHAR) AS event_id FROM (
  SELECT event_id FROM reports_in WHERE date_trunc('millisecond', ts) BETWEEN {AS_OF_SQL} - INTERVAL 24 HOUR AND {AS_OF_SQL}
  ORDER BY date_trunc('millisecond', ts) DESC, CAST(event_id AS VARCHAR) DESC LIMIT 200)
UNION ALL SELECT 'log', CAST(event_id AS VARCHAR) FROM (SELECT event_id FROM logs WHERE event_time BETWEEN {AS_OF_SQL} - INTERVAL 1 HOUR AND {AS_OF_SQL}
  ORDER BY event_time DESC, event_id DESC LIMIT 500)""",
    "Q8_rejected": v.with_ctes(v.LOGS) + """SELECT service, CASE WHEN event_id % 3 = 0 THEN 'minutes missing'
  ELSE 'minutes not between 1 and 1440' END AS reason, count(*) AS n FROM logs WHERE event_id % 211 = 0
  AND (event_id % 3 = 0 OR (event_id % 3 * 720 + 60) * 2 > 1440) GROUP BY ALL""",
    "Q4_get_report": v.with_ctes(v.LOGS, v.ALERTS) + """, first AS (SELECT min(CAST(event_id AS VARCHAR)) AS k FROM alerts)
SELECT l.lookup, 'r' || k AS report_id, k AS event_id, service FROM first JOIN alerts ON CAST(event_id AS VARCHAR) = k,
  (VALUES ('event'), ('report')) l(lookup)""",
    "Q5_list_services": _PASSED.replace(v.ALERTS, f"{v.ALERTS},\n{v.REGISTRY},\n{SILENCES}", 1) + f"""
SELECT n.service AS id, coalesce(r.team, d.team) AS team, coalesce(r.tier, d.tier) AS tier, coalesce(r.team, d.team) || '@example.org' AS oncall,
  '#' || coalesce(r.team, d.team) AS slack_channel, coalesce(h.health, 'healthy') AS health,
  EXISTS (SELECT 1 FROM silences s WHERE s.service = n.service AND s.from_ts <= {AS_OF_SQL} AND s.to_ts > {AS_OF_SQL}) AS silenced
FROM (SELECT service FROM registry WHERE service <> 'default' UNION
  SELECT service FROM alerts WHERE date_trunc('millisecond', ts) >= {AS_OF_SQL} - INTERVAL 24 HOUR) n
LEFT JOIN registry r ON r.service = n.service LEFT JOIN registry d ON d.service = 'default'
LEFT JOIN {_HEALTH} h ON h.service = n.service""",
    "Q6_service_metrics": rep.BASE + f"""SELECT CAST(event_id AS VARCHAR) AS event_id, (epoch_us(ts) // 1000) AS ts_ms, round(z_score, 6) AS z_score, severity, o2 AS p99
FROM reports_in WHERE service = 'api-gateway' AND date_trunc('millisecond', ts) BETWEEN {AS_OF_SQL} - INTERVAL 240 HOUR AND {AS_OF_SQL}""",
    "Q7_health": _PASSED + f"SELECT service, health FROM {_HEALTH}",
    "Q8_silenced": _FLAGS + "SELECT event_id, service, silenced FROM flags",
    "Q8_drop_silenced": _FLAGS + "SELECT event_id, service FROM flags WHERE NOT silenced",
    "Q9_live_feed": rep.BASE + """SELECT CASE WHEN event_id % 9 <> 0 THEN anomaly_type ELSE 'anomaly' END AS event, CAST(event_id AS VARCHAR) AS id
FROM events_in WHERE service = 'order-svc' AND event_id % 10 <> 7""",
}

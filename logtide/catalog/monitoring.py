"""Functions over metric series made from the logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtide.catalog import views as v
from logtide.functions.scalars import normalise_path
from logtide.operators import monitor as m
from logtide.operators.limiter import group_notifications
from logtide.operators.windows import window_start

HOUR, WEEK = 3_600, 7 * 86_400
BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0)
START, END = "2024-01-05", "2024-01-20"
RANGE = 6 * HOUR


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per (service, level) as a counter at hourly scrapes; it restarts every week."""
    logs = v.logs(spark, folder)
    hourly = logs.groupBy("service", "level", window_start(F.col("event_time"), HOUR).alias("ts")).agg(
        F.count("*").alias("n"))
    week = F.floor(F.unix_micros("ts") / (WEEK * 1_000_000))
    w = Window.partitionBy("service", "level", "week").orderBy("ts")
    return hourly.withColumn("week", week).select(
        "service", "level", "ts", F.sum("n").over(w).cast("double").alias("value"))


COUNTERS = """hourly AS (
  SELECT service, level, epoch_us(event_time) // 3600000000 * 3600000000 AS ts_us, count(*) AS n FROM logs GROUP BY ALL),
counters AS (
  SELECT service, level, ts_us, CAST(sum(n) OVER (PARTITION BY service, level, ts_us // 604800000000 ORDER BY ts_us) AS DOUBLE) AS value FROM hourly),
stepped AS (
  SELECT *, CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END AS step FROM (
    SELECT *, lag(value) OVER (PARTITION BY service, level ORDER BY ts_us) AS before FROM counters)),
increased AS (
  SELECT *, sum(step) OVER (PARTITION BY service, level ORDER BY ts_us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS increase
  FROM stepped)"""
LABELS = ("service", "level")


def ts_us():
    return F.unix_micros("ts").alias("ts_us")


def gauges(spark, folder):
    """Hourly volume per service, as a gauge."""
    logs = v.logs(spark, folder)
    return logs.groupBy("service", window_start(F.col("event_time"), HOUR).alias("ts")).agg(
        F.count("*").cast("double").alias("value"))


GAUGES = """gauges AS (
  SELECT service, epoch_us(event_time) // 3600000000 * 3600000000 AS ts_us, CAST(count(*) AS DOUBLE) AS value FROM logs GROUP BY ALL)"""


def buckets(spark: SparkSession, folder: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative latency buckets per hour of the day and the given columns."""
    logs = v.logs(spark, folder).filter(F.col("latency_ms").isNotNull())
    staged = logs.withColumn("ts", window_start(F.col("event_time"), v.HOURS_6))
    return m.observe(staged, F.col("latency_ms"), BOUNDS, ("ts", *by))


def summed_gauge(spark, folder):
    return m.above(m.summed(gauges(spark, folder)), 14.0).select(ts_us(), "value")


def held_breach(spark, folder):
    rows = m.held(m.summed(gauges(spark, folder)), F.col("value") > 12, 2 * HOUR)
    return rows.select(ts_us(), "value", "breach", "firing")


def increases(spark, folder):
    return m.increase(counters(spark, folder), LABELS, RANGE).select("service", "level", ts_us(), "increase")


def rates(spark, folder):
    rows = m.rate_by(counters(spark, folder), LABELS, RANGE, ("level",), 60.0)
    return rows.select("level", ts_us(), F.round("value", 9).alias("value"))


def quantiles(spark, folder):
    parts = [m.histogram_quantile(buckets(spark, folder), q).select(
        F.lit(q).alias("q"), ts_us(), F.round("quantile", 6).alias("quantile")) for q in (0.5, 0.99, 0.999)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def quantiles_by(spark, folder):
    rows = m.histogram_quantile(buckets(spark, folder, ("service",)), 0.99, ("ts", "service"))
    return rows.select("service", ts_us(), F.round("quantile", 6).alias("quantile"))


def combined(spark: SparkSession, folder: str) -> DataFrame:
    b = buckets(spark, folder, ("env",))
    first = m.histogram_quantile(b.filter("env = 'prod'"), 0.99)
    return m.combined_quantile(first, m.histogram_quantile(b.filter("env = 'staging'"), 0.99))


def sla(spark, folder):
    return m.above(combined(spark, folder), 60.0).select(ts_us(), F.round("value", 6).alias("value"))


def spine(spark: SparkSession, folder: str) -> DataFrame:
    """Every hour and service between the first and the last scrape."""
    span = v.logs(spark, folder).agg(
        F.min(window_start(F.col("event_time"), HOUR)).alias("a"), F.max(window_start(F.col("event_time"), HOUR)).alias("b"))
    hours = span.select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("ts"))
    return hours.select("ts", F.explode(F.array(*[F.lit(s) for s in v.SERVICES])).alias("service"))


def service_counters(spark, folder):
    hourly = gauges(spark, folder)
    # A service that was idle keeps its count: every third hour the scrape repeats the last value.
    w = Window.partitionBy("service").orderBy("ts")
    kept = F.when(F.hour("ts") % 3 == 0, 0).otherwise(F.col("value"))
    return hourly.select("service", "ts", F.sum(kept).over(w).alias("value"))


def silent(spark, folder):
    return m.silent(spine(spark, folder), service_counters(spark, folder), ("service",), HOUR).select(
        "service", ts_us(), "reason")


def recovered(spark, folder):
    return m.recovered(service_counters(spark, folder), ("service",), HOUR).select("service", ts_us(), "increase")


def top(spark, folder):
    return m.top_increase(counters(spark, folder), LABELS, "service", v.moment(START), v.moment(END), 5)


def error_ratio(spark, folder):
    rows = m.rate(counters(spark, folder), LABELS, RANGE)
    severe = m.matches(F.col("level"), "ERR..|CRIT.*")
    sums = rows.groupBy("ts").agg(F.sum(F.when(severe, F.col("rate")).otherwise(0.0)).alias("a"), F.sum("rate").alias("b"))
    return sums.select(ts_us(), F.round(m.ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


def compliance(spark, folder):
    return combined(spark, folder).select(ts_us(), F.round(m.slo_compliance(F.col("value")), 6).alias("compliance"))


def totals(spark, folder):
    return m.total_increase(counters(spark, folder), LABELS, ("level",), v.moment(START), v.moment(END))


def rule_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alert evaluations of every hour: component, name, severity by volume."""
    severity = F.when(F.col("value") >= 4, "critical").when(F.col("value") >= 3, "warning").when(
        F.col("value") >= 2, "info").otherwise("none")
    names = F.when(F.hour("ts") % 2 == 0, F.array(F.lit("Volume"))).otherwise(F.array(F.lit("Volume"), F.lit("Lag")))
    return gauges(spark, folder).select(
        F.col("service").alias("component"), "ts", F.explode(names).alias("alertname"),
        F.when(F.col("value") == 1, "none").otherwise(severity).alias("severity")).withColumn(
        "severity", F.when(F.col("alertname") == "Lag", "warning").otherwise(F.col("severity")))


RULE_ALERTS = """rule_alerts AS (
  SELECT service AS component, ts_us, alertname, CASE WHEN alertname = 'Lag' THEN 'warning' WHEN value >= 4 THEN 'critical'
    WHEN value >= 3 THEN 'warning' WHEN value >= 2 THEN 'info' ELSE 'none' END AS severity
  FROM (SELECT *, unnest(CASE WHEN ts_us // 3600000000 % 2 = 0 THEN ['Volume'] ELSE ['Volume', 'Lag'] END) AS alertname FROM gauges))"""


def inhibited(spark, folder):
    return m.inhibit(rule_alerts(spark, folder)).select("component", ts_us(), "alertname", "severity")


def firing(spark, folder):
    return v.alerts(spark, folder).select(
        F.col("level").alias("alertname"), F.col("service").alias("component"), "message", "ts")


def notifications(spark, folder):
    rows = group_notifications(firing(spark, folder), ["alertname", "component"], "message",
                               wait=HOUR, interval=6 * HOUR, repeat=24 * HOUR)
    return rows.select("alertname", "component", ts_us(), "is_new", "notify")


def routed(spark, folder):
    return m.receivers(rule_alerts(spark, folder)).select(
        "component", ts_us(), "alertname", "receiver", F.col("group_wait").cast("bigint").alias("group_wait"),
        F.col("repeat_interval").cast("bigint").alias("repeat_interval"))


def lag(spark, folder):
    """End offsets against committed offsets per (topic, partition)."""
    offsets = v.table(spark, folder, "events").select(
        F.lit("processed-logs").alias("topic"), (F.col("user_id") % 12).alias("partition"), "event_id")
    ends = offsets.groupBy("topic", "partition").agg(F.max("event_id").alias("end_offset"))
    done = offsets.filter("event_id % 3 = 0 AND partition < 10").groupBy("topic", "partition").agg(
        F.max(F.col("event_id") + F.col("partition") % 4).alias("committed_offset"))
    return m.consumer_lag(ends, done)


def histogram(spark, folder):
    """Request durations by normalised path."""
    e = v.table(spark, folder, "events")
    path = normalise_path(F.concat(F.lit("/api/"), "event_type", F.lit("/"), F.col("user_id").cast("string")))
    return m.observe(e.withColumn("path", path), F.col("value") / 100, m.REQUEST_BUCKETS, ("path",)).select(
        "path", F.when(F.col("le") == float("inf"), F.lit("+Inf")).otherwise(F.col("le").cast("string")).alias("le"), "value")


def label_counts(spark, folder):
    return m.count_by_labels(v.logs(spark, folder), ("service", "level"))


QUERIES = {
    "M1_summed_threshold": summed_gauge,
    "M2_hold_duration": held_breach,
    "M3_increase": increases,
    "M4_rate_by_label": rates,
    "M5_histogram_quantile": quantiles,
    "M5_quantile_by_service": quantiles_by,
    "M6_combined_quantile": sla,
    "M7_silent": silent,
    "M7_recovered": recovered,
    "M8_top_increase": top,
    "M9_error_ratio": error_ratio,
    "M10_slo_compliance": compliance,
    "M11_totals": totals,
    "M12_inhibition": inhibited,
    "M13_group_notifications": notifications,
    "M14_receivers": routed,
    "M15_consumer_lag": lag,
    "M16_histogram": histogram,
    "M16_label_counts": label_counts,
}

_C = v.with_ctes(v.LOGS, COUNTERS)
_G = v.with_ctes(v.LOGS, GAUGES)
_R = v.with_ctes(v.LOGS, GAUGES, RULE_ALERTS)
_START, _END = 1_704_412_800_000_000, 1_705_708_800_000_000


def _buckets_sql(by: str = "") -> str:
    comma = f"{by}, " if by else ""
    bounds = ", ".join(f"({b})" for b in BOUNDS) + ", ('inf'::DOUBLE)"
    return v.with_ctes(v.LOGS, f"bounds(le) AS (SELECT CAST(x AS DOUBLE) FROM (VALUES {bounds}) t(x))") + f""", buckets AS (
  SELECT {comma}epoch_us(event_time) // 21600000000 * 21600000000 AS ts_us, le, CAST(count(*) FILTER (latency_ms <= le) AS DOUBLE) AS cum
  FROM logs, bounds WHERE latency_ms IS NOT NULL GROUP BY ALL),
placed AS (
  SELECT *, coalesce(lag(cum) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS low, max(cum) OVER (PARTITION BY {comma}ts_us) AS total
  FROM buckets WINDOW w AS (PARTITION BY {comma}ts_us ORDER BY le))"""


def _quantile_sql(q: float, by: str = "") -> str:
    comma = f"{by}, " if by else ""
    return f"""SELECT {comma}ts_us, min_by(CASE WHEN le = 'inf'::DOUBLE THEN low WHEN cum = below THEN le
    ELSE low + (le - low) * (({q}::DOUBLE * total - below) / (cum - below)) END, le) AS quantile
  FROM placed WHERE cum >= {q}::DOUBLE * total GROUP BY {comma}ts_us"""


_COMBINED = _buckets_sql("env") + f""", quantiles AS ({_quantile_sql(0.99, 'env')}),
combined AS (SELECT a.ts_us, a.quantile + b.quantile AS value FROM quantiles a JOIN quantiles b ON a.ts_us = b.ts_us
  AND a.env = 'prod' AND b.env = 'staging')
"""
_SILENT = _G + """, kept AS (
  SELECT service, ts_us, sum(CASE WHEN ts_us // 3600000000 % 24 % 3 = 0 THEN 0 ELSE value END) OVER (PARTITION BY service ORDER BY ts_us) AS value FROM gauges),
grown AS (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY service ORDER BY ts_us), 0) AS increase FROM kept),
spine AS (SELECT service, unnest(range((SELECT min(ts_us) FROM kept), (SELECT max(ts_us) FROM kept) + 1, 3600000000)) AS ts_us
  FROM (SELECT DISTINCT service FROM logs))
"""
_NOTIFY = v.with_ctes(v.LOGS, v.ALERTS) + """, firsts AS (
  SELECT level AS alertname, service AS component, message, epoch_us(ts) AS ts_us,
    row_number() OVER (PARTITION BY level, service, message ORDER BY ts) = 1 AS fresh FROM alerts),
ticks AS (SELECT *, row_number() OVER (PARTITION BY alertname, component ORDER BY ts_us) AS rn FROM (
  SELECT alertname, component, ts_us, bool_or(fresh) AS is_new FROM firsts GROUP BY ALL)),
machine AS (
  SELECT alertname, component, rn, ts_us, is_new, ts_us AS first, CAST(NULL AS BIGINT) AS last, is_new AS pending, false AS notify
  FROM ticks WHERE rn = 1
  UNION ALL
  SELECT alertname, component, rn, ts_us, is_new, first, CASE WHEN due THEN ts_us ELSE last END, pending AND NOT due, due
  FROM (SELECT *, CASE WHEN last IS NULL THEN ts_us - first >= 3600000000
      ELSE (pending AND ts_us - last >= 21600000000) OR ts_us - last >= 86400000000 END AS due FROM (
    SELECT t.alertname, t.component, t.rn, t.ts_us, t.is_new, m.first, m.last, m.pending OR t.is_new AS pending
    FROM machine m JOIN ticks t ON t.alertname = m.alertname AND t.component = m.component AND t.rn = m.rn + 1)))
SELECT alertname, component, ts_us, is_new, notify FROM machine"""

ORACLE = {
    "M1_summed_threshold": _G + "SELECT ts_us, sum(value) AS value FROM gauges GROUP BY ts_us HAVING sum(value) > 14",
    "M2_hold_duration": _G + """, totals AS (SELECT ts_us, sum(value) AS value, sum(value) > 12 AS breach FROM gauges GROUP BY ts_us),
runs AS (SELECT *, sum(CASE WHEN breach THEN 0 ELSE 1 END) OVER (ORDER BY ts_us) AS run FROM totals)
SELECT ts_us, value, breach, breach AND ts_us - min(CASE WHEN breach THEN ts_us END) OVER (PARTITION BY run, breach) >= 7200000000 AS firing FROM runs""",
    "M3_increase": _C + "SELECT service, level, ts_us, increase FROM increased",
    "M4_rate_by_label": _C + "SELECT level, ts_us, round(sum(increase / 21600) * 60, 9) AS value FROM increased GROUP BY level, ts_us",
    "M5_histogram_quantile": _buckets_sql() + "\n" + "\nUNION ALL\n".join(
        f"SELECT CAST({q} AS DOUBLE) AS q, ts_us, round(quantile, 6) AS quantile FROM ({_quantile_sql(q)})" for q in (0.5, 0.99, 0.999)),
    "M5_quantile_by_service": _buckets_sql("service") + f"\nSELECT service, ts_us, round(quantile, 6) AS quantile FROM ({_quantile_sql(0.99, 'service')})",
    "M6_combined_quantile": _COMBINED + "SELECT ts_us, round(value, 6) AS value FROM combined WHERE value > 60",
    "M7_silent": _SILENT + """SELECT s.service, s.ts_us, CASE WHEN g.service IS NULL THEN 'absent' ELSE 'stalled' END AS reason
FROM spine s LEFT JOIN grown g ON g.service = s.service AND g.ts_us = s.ts_us WHERE g.service IS NULL OR g.increase = 0""",
    "M7_recovered": _SILENT + "SELECT service, ts_us, increase FROM grown WHERE increase > 0",
    "M8_top_increase": _C + f"""SELECT service, sum(step) AS value FROM stepped WHERE ts_us > {_START} AND ts_us <= {_END}
GROUP BY service ORDER BY value DESC, service LIMIT 5""",
    "M9_error_ratio": _C + """SELECT ts_us, round(coalesce(sum(increase / 21600) FILTER (level IN ('ERROR', 'CRITICAL')), 0) / (sum(increase / 21600) + 0.0001::DOUBLE), 6) AS ratio
FROM increased GROUP BY ts_us""",
    "M10_slo_compliance": _COMBINED + "SELECT ts_us, round(100 * (1 - greatest(value - 60, 0) / 60), 6) AS compliance FROM combined",
    "M11_totals": _C + f"SELECT level, sum(step) AS value FROM stepped WHERE ts_us > {_START} AND ts_us <= {_END} GROUP BY level",
    "M12_inhibition": _R + """SELECT component, ts_us, alertname, severity FROM rule_alerts a WHERE severity NOT IN ('warning', 'info')
  OR NOT EXISTS (SELECT 1 FROM rule_alerts c WHERE c.severity = 'critical' AND c.component = a.component AND c.ts_us = a.ts_us)""",
    "M13_group_notifications": _NOTIFY,
    "M14_receivers": _R + """SELECT component, ts_us, alertname, receiver, CAST(wait AS BIGINT) AS group_wait, CAST(repeat AS BIGINT) AS repeat_interval
FROM rule_alerts a JOIN (VALUES ('critical', 'pagerduty-critical', 30, 14400), ('critical', 'slack-incidents', 10, 14400),
  ('warning', 'slack-monitoring', 30, 7200), ('info', 'slack-monitoring', 30, 86400), ('none', 'slack-monitoring', 30, 14400))
  r(severity, receiver, wait, repeat) ON r.severity = a.severity""",
    "M15_consumer_lag": """WITH offsets AS (SELECT 'processed-logs' AS topic, user_id % 12 AS partition, event_id FROM events),
ends AS (SELECT topic, partition, max(event_id) AS e FROM offsets GROUP BY ALL),
done AS (SELECT topic, partition, max(event_id + partition % 4) AS c FROM offsets WHERE event_id % 3 = 0 AND partition < 10 GROUP BY ALL)
SELECT ends.topic, ends.partition, greatest(0, e - coalesce(c, 0)) AS lag FROM ends LEFT JOIN done USING (topic, partition)""",
    "M16_histogram": "WITH bounds(le) AS (SELECT CAST(x AS DOUBLE) FROM (VALUES "
    + ", ".join(f"({b})" for b in m.REQUEST_BUCKETS) + """, ('inf'::DOUBLE)) t(x))
SELECT '/api/' || event_type || '/{id}' AS path, CASE WHEN le = 'inf'::DOUBLE THEN '+Inf' ELSE CAST(le AS VARCHAR) END AS le,
  CAST(count(*) FILTER (value / 100 <= le) AS DOUBLE) AS value FROM events, bounds GROUP BY ALL""",
    "M16_label_counts": v.with_ctes(v.LOGS) + "SELECT service, level, CAST(count(*) AS DOUBLE) AS value FROM logs GROUP BY ALL",
}

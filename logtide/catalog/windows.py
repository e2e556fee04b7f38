"""Windowed aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.catalog import views as v
from logtide.operators import windows as w
from logtide.settings import RECORD_TYPE, WindowSettings

SIX_HOURS = WindowSettings(size=v.HOURS_6)
HOUR = WindowSettings(size=3_600)


def start_us():
    return F.unix_micros("window_start").alias("start_us")


def counts(spark, folder):
    return w.window_counts(v.logs(spark, folder), 3_600).select("service", start_us(), "request_volume")


def counts_by_level(spark, folder):
    logs = v.logs(spark, folder)
    return w.window_counts(logs, 300, ("service", "level")).select("service", "level", start_us(), "request_volume")


def level_counts(spark, folder):
    return w.window_counts(v.logs(spark, folder), 3_600).select(
        "service", start_us(), "request_volume", "error_count", "warn_count")


def rates(spark, folder):
    return w.window_counts(v.logs(spark, folder), v.HOURS_6).select(
        "service", start_us(), F.round("error_rate", 6).alias("error_rate"), F.round("warn_rate", 6).alias("warn_rate"))


def percentiles(spark, folder):
    cells = w.window_cells(v.logs(spark, folder), v.HOURS_6)
    return w.summarise_cells(cells, v.HOURS_6).select(
        "service", start_us(), "p50_latency_ms", "p95_latency_ms", "p99_latency_ms")


def average(spark, folder):
    cells = w.window_cells(v.logs(spark, folder), v.HOURS_6)
    return w.summarise_cells(cells, v.HOURS_6).select("service", start_us(), "avg_latency_ms", "latency_count")


def reservoir(spark, folder):
    key = F.md5(F.col("event_id").cast("string"))
    return w.latency_reservoir(v.logs(spark, folder), key, v.HOURS_6, cap=5).select(
        "event_id", "service", start_us(), "latency_ms", F.col("sample_rank").cast("bigint").alias("sample_rank"))


def top_messages(spark, folder):
    return w.top_errors(v.logs(spark, folder), v.HOURS_6, 5).select(
        "service", start_us(), F.col("rank").cast("bigint").alias("rank"), "message", F.col("count").alias("n"))


def late_rows(spark, folder):
    marked = w.mark_late(v.arrivals(spark, folder), "arrival_seq", HOUR, chunk_rows=5_000)
    return marked.select("event_id", "service", "is_late")


def late_counts(spark, folder):
    """One-minute windows over the rows that are not late, and how many were routed away."""
    marked = w.mark_late(v.arrivals(spark, folder), "arrival_seq", WindowSettings(), chunk_rows=5_000)
    return marked.groupBy("service").agg(
        F.count_if(~F.col("is_late")).alias("on_time"), F.count_if("is_late").alias("late"))


def identity(spark, folder):
    cells = w.window_cells(v.logs(spark, folder), v.HOURS_6)
    return w.summarise_cells(cells, v.HOURS_6).select("service", start_us(), "env")


def rolled_up(spark, folder):
    """Minute cells merged into days."""
    cells = w.merge_cells(w.window_cells(v.logs(spark, folder), 60), 86_400)
    return w.summarise_cells(cells, 86_400).select(
        "service", start_us(), "request_volume", "error_count", "warn_count", "p50_latency_ms", "p95_latency_ms",
        "p99_latency_ms", "avg_latency_ms", F.round("error_rate", 6).alias("error_rate"))


def window_rows(spark: SparkSession, folder: str, settings: WindowSettings) -> DataFrame:
    return _record_rows(w.service_windows(v.logs(spark, folder), settings))


def _record_rows(windows: DataFrame) -> DataFrame:
    tops = F.array_join(F.transform("top_errors", lambda e: F.concat(
        e["message"], F.lit("="), e["count"].cast("string"))), ";")
    return windows.select(
        F.lit(RECORD_TYPE).alias("record_type"), "service", "env", start_us(),
        F.unix_micros("window_end").alias("end_us"), "request_volume", "error_count", "warn_count",
        F.round("error_rate", 6).alias("error_rate"), F.round("warn_rate", 6).alias("warn_rate"),
        "p50_latency_ms", "p95_latency_ms", "p99_latency_ms", "avg_latency_ms", tops.alias("top_errors"))


def window_summary(spark: SparkSession, folder: str) -> DataFrame:
    return window_rows(spark, folder, SIX_HOURS)


def minute_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The default one-minute windows."""
    return window_rows(spark, folder, WindowSettings())


def closed_windows(spark, folder):
    """Stream of hourly windows in append mode: the windows the watermark has closed."""
    from logtide.session import scratch_dir
    from logtide.streaming.jobs import run_to_table, window_stream

    base = scratch_dir(spark, "closed-windows")
    v.logs(spark, folder).write.parquet(f"{base}/in")
    logs = spark.readStream.schema(v.logs(spark, folder).schema).parquet(f"{base}/in")
    counted = window_stream(logs, HOUR)
    return run_to_table(counted, f"{base}/out", f"{base}/checkpoint").select(
        "service", start_us(), "request_volume", "error_count", "warn_count", "p99_latency_ms")


def _streamed_windows(spark, folder, final: bool) -> DataFrame:
    """Logs in three batches that overlap in time, and one from the future that closes all windows; the stream's table."""
    from logtide.catalog.io import in_batches
    from logtide.session import scratch_dir
    from logtide.streaming.jobs import start_window_records

    base, logs = scratch_dir(spark, "window-records"), v.logs(spark, folder)
    ahead = logs.limit(1).withColumns({"event_time": v.moment("2031-01-01 00:00:00"), "service": F.lit("ahead")})
    parts = [logs.filter(F.pmod("event_id", F.lit(3)) == i) for i in range(3)]
    # The batches overlap in time, so the watermark has to wait for all of them.
    patient = WindowSettings(size=v.HOURS_6, allowed_lateness=40 * 86_400)
    in_batches([*parts, ahead], f"{base}/in", lambda: start_window_records(
        spark.readStream.schema(logs.schema).parquet(f"{base}/in"), base, f"{base}/checkpoint", patient, final, available_now=True).awaitTermination())
    return _record_rows(spark.read.parquet(f"{base}/windows").where("service <> 'ahead'"))


def streamed_windows(spark, folder):
    """Complete windows, written once when they are final."""
    return _streamed_windows(spark, folder, True)


def refined_windows(spark, folder):
    """Complete windows, written again with every batch that changes them."""
    return _streamed_windows(spark, folder, False)


QUERIES = {
    "W1_tumbling_windows": counts,
    "W1_windows_by_level": counts_by_level,
    "W2_level_counts": level_counts,
    "W3_rates": rates,
    "W4_percentiles": percentiles,
    "W5_average_latency": average,
    "W6_reservoir": reservoir,
    "W7_top_errors": top_messages,
    "W8_closed_windows_stream": closed_windows,
    "W9_late_rows": late_rows,
    "W9_late_minutes": late_counts,
    "W11_window_env": identity,
    "W12_roll_up": rolled_up,
    "W8_windows_stream": streamed_windows,
    "W8_windows_refined_stream": refined_windows,
    "W13_service_windows": window_summary,
    "W13_service_minutes": minute_summary,
}


def _base(size: int) -> str:
    return v.with_ctes(v.LOGS, v.windows_sql(size))


def _summary(size: int) -> str:
    width = size * 1_000_000
    return v.with_ctes(v.LOGS, v.windows_sql(size)) + f""", counted AS (
  SELECT service, epoch_us(event_time) // {width} * {width} AS start_us, left(message, 200) AS message, count(*) AS n
  FROM logs WHERE level IN ('ERROR', 'CRITICAL') GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY service, start_us ORDER BY n DESC, message) AS rank FROM counted),
tops AS (SELECT service, start_us, string_agg(message || '=' || CAST(n AS VARCHAR), ';' ORDER BY rank) AS top_errors
  FROM ranked WHERE rank <= 5 GROUP BY ALL)
SELECT '{RECORD_TYPE}' AS record_type, w.service, env, w.start_us, end_us, request_volume, error_count, warn_count,
  round(error_count / request_volume, 6) AS error_rate, round(warn_count / request_volume, 6) AS warn_rate,
  p50_latency_ms, p95_latency_ms, p99_latency_ms, avg_latency_ms, coalesce(top_errors, '') AS top_errors
FROM windows w LEFT JOIN tops t ON w.service = t.service AND w.start_us = t.start_us"""


def _late(size: int) -> str:
    width = size * 1_000_000
    return v.with_ctes(v.LOGS, v.ARRIVALS) + f""", watermarked AS (
  SELECT *, max(epoch_us(event_time)) OVER (ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM arrivals),
marked AS (SELECT *, coalesce(epoch_us(event_time) // {width} * {width} + {width} + 30000000 <= seen - 30000000, false) AS is_late
  FROM watermarked)
"""


ORACLE = {
    "W1_tumbling_windows": _base(3_600) + "SELECT service, start_us, request_volume FROM windows",
    "W1_windows_by_level": v.with_ctes(v.LOGS) + """SELECT service, level, epoch_us(event_time) // 300000000 * 300000000 AS start_us,
  count(*) AS request_volume FROM logs GROUP BY ALL""",
    "W2_level_counts": _base(3_600) + "SELECT service, start_us, request_volume, error_count, warn_count FROM windows",
    "W3_rates": _base(v.HOURS_6) + """SELECT service, start_us, round(error_count / request_volume, 6) AS error_rate,
  round(warn_count / request_volume, 6) AS warn_rate FROM windows""",
    "W4_percentiles": _base(v.HOURS_6) + "SELECT service, start_us, p50_latency_ms, p95_latency_ms, p99_latency_ms FROM windows",
    "W5_average_latency": v.with_ctes(v.LOGS) + """SELECT service, epoch_us(event_time) // 21600000000 * 21600000000 AS start_us,
  CAST(sum(latency_ms) // nullif(count(latency_ms), 0) AS BIGINT) AS avg_latency_ms, count(latency_ms) AS latency_count
FROM logs GROUP BY ALL""",
    "W6_reservoir": v.with_ctes(v.LOGS) + """, ranked AS (
  SELECT event_id, service, epoch_us(event_time) // 21600000000 * 21600000000 AS start_us, latency_ms,
    row_number() OVER (PARTITION BY service, epoch_us(event_time) // 21600000000 ORDER BY md5(CAST(event_id AS VARCHAR))) AS sample_rank
  FROM logs WHERE latency_ms IS NOT NULL)
SELECT * FROM ranked WHERE sample_rank <= 5""",
    "W7_top_errors": v.with_ctes(v.LOGS) + """, counted AS (
  SELECT service, epoch_us(event_time) // 21600000000 * 21600000000 AS start_us, left(message, 200) AS message, count(*) AS n
  FROM logs WHERE level IN ('ERROR', 'CRITICAL') GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY service, start_us ORDER BY n DESC, message) AS rank FROM counted)
SELECT * FROM ranked WHERE rank <= 5""",
    "W8_closed_windows_stream": _base(3_600) + """SELECT service, start_us, request_volume, error_count, warn_count, p99_latency_ms
FROM windows WHERE end_us <= (SELECT max(epoch_us(event_time)) FROM logs) - 60000000""",
    "W9_late_rows": _late(3_600) + "SELECT event_id, service, is_late FROM marked",
    "W9_late_minutes": _late(60) + """SELECT service, count(*) FILTER (NOT is_late) AS on_time, count(*) FILTER (is_late) AS late
FROM marked GROUP BY service""",
    "W11_window_env": _base(v.HOURS_6) + "SELECT service, start_us, env FROM windows",
    "W12_roll_up": _base(86_400) + """SELECT service, start_us, request_volume, error_count, warn_count, p50_latency_ms, p95_latency_ms,
  p99_latency_ms, avg_latency_ms, round(error_count / request_volume, 6) AS error_rate FROM windows""",
    "W8_windows_stream": _summary(v.HOURS_6),
    "W8_windows_refined_stream": _summary(v.HOURS_6),
    "W13_service_windows": _summary(v.HOURS_6),
    "W13_service_minutes": _summary(60),
}

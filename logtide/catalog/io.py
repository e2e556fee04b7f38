"""Sources and sinks, and the stream forms of the stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.catalog import alerts as al
from logtide.catalog import baselines as base
from logtide.catalog import parsing as ps
from logtide.catalog import reports as rep
from logtide.catalog import views as v
from logtide.operators import parse as p
from logtide.operators.multiline import assemble
from logtide.operators.windows import document_keys, service_windows, window_records
from logtide.session import materialise, scratch_dir
from logtide.settings import RECORD_TYPE, WindowSettings
from logtide.sources import readers as rd
from logtide.sources import writers as wr
from logtide.streaming import jobs, stateful
from logtide.streaming.events import start_events

SIX_HOURS = WindowSettings(size=v.HOURS_6)


def message_files(spark: SparkSession, folder: str, base_dir: str) -> str:
    path = f"{base_dir}/messages"
    v.raw_messages(spark, folder).select("key", "value", "partition", "offset", "timestamp").write.parquet(path)
    return path


def message_stream(spark, folder):
    base_dir = scratch_dir(spark, "messages")
    stream = rd.read_message_files(spark, message_files(spark, folder, base_dir))
    kept = p.parse_messages(stream).select("key", "partition", "offset", "parse_error")
    return jobs.run_to_table(kept, f"{base_dir}/out", f"{base_dir}/checkpoint").groupBy("partition").agg(
        F.count("*").alias("messages"), F.max("offset").alias("last_offset"),
        F.count_if(F.col("parse_error").isNotNull()).alias("failed")).withColumn(
        "partition", F.col("partition").cast("bigint"))


def json_files(spark, folder):
    base_dir = scratch_dir(spark, "json-lines")
    v.raw_messages(spark, folder).filter("value <> ''").select("value").write.text(f"{base_dir}/logs")
    lines = rd.read_json_lines(spark, f"{base_dir}/logs")
    level = F.coalesce(*[p.text_at(F.col("doc"), k) for k in ("level", "severity", "log_level")])
    return lines.groupBy(F.col("log").isNull().alias("is_json"), F.coalesce(level, F.lit("-")).alias("level")).agg(
        F.count("*").alias("n"), F.count_if(F.col("source_file").contains("/logs/")).alias("with_path"))


def plain_files(spark, folder):
    """Plaintext files, numbered, reassembled into records."""
    base_dir = scratch_dir(spark, "plain-lines")
    lines = ps.stack_lines(spark, folder)
    # One file per service: the lines of a service are sorted into one partition.
    (lines.repartition("source_file").sortWithinPartitions("source_file", "line_no")
     .select("line", "source_file").write.partitionBy("source_file").text(f"{base_dir}/logs"))
    read = rd.read_plain_lines(spark, f"{base_dir}/logs").withColumn(
        "source_file", F.regexp_extract("source_file", "source_file=([^/]+)", 1))
    return assemble(read).select(
        "source_file", "first_line", "n_lines", F.md5("log").alias("log_md5"))


def json_sink(spark, folder):
    base_dir = scratch_dir(spark, "json-sink")
    wr.json_messages(v.logs(spark, folder).select("event_id", "service", "level", "latency_ms")).write.parquet(base_dir)
    return spark.read.parquet(base_dir).select(
        F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"), "value")


def keyed_events(spark, folder):
    rows = rep.anomaly_events(spark, folder).select("event_id", "service", "severity", "z_score")
    messages = wr.event_messages(rows)
    return messages.select("key", F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"),
                           F.get_json_object("value", "$.severity").alias("severity"))


def upserted_windows(spark, folder):
    """Three overlapping writes of window aggregates into one table."""
    path = scratch_dir(spark, "windows")
    logs = v.logs(spark, folder)
    parts = [logs.filter("event_id % 2 = 0"), logs, logs.filter("event_time < '2024-01-10'")]
    for seq, part in enumerate(parts):
        rows = document_keys(service_windows(part, SIX_HOURS)).withColumn("seq", F.lit(seq).cast("bigint"))
        wr.upsert(rows, path, ["service", "window_start"], ["seq"], "index_date")
    return spark.read.parquet(path).select("doc_id", "index_name", "request_volume", "error_count", "p99_latency_ms", "seq")


def upserted_reports(spark, folder):
    path = scratch_dir(spark, "reports")
    first = rep.reports(spark, folder)
    second = rep.merged_reports(spark, folder).filter("ai_generated")
    for seq, part in enumerate((first, second)):
        rows = part.select("event_id", "service", "severity", "summary", "ai_generated", "timestamp").withColumns({
            "seq": F.lit(seq).cast("bigint"), "report_date": F.to_date(F.substring("timestamp", 1, 10))})
        wr.upsert(rows, path, ["event_id"], ["seq"], "report_date")
    return spark.read.parquet(path).select("event_id", "severity", "summary", "ai_generated", "seq")


def archived(spark, folder):
    path = scratch_dir(spark, "archive")
    wr.write_archive(v.raw_messages(spark, folder), path, F.col("timestamp"), 100_000)
    back = spark.read.text(path)
    return back.groupBy("year", "month", "day", "hour").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars")).select(
        *[F.col(c).cast("bigint").alias(c) for c in ("year", "month", "day", "hour")], "n", "chars")


def archived_stream(spark, folder):
    """The archive as a stream, in three batches."""
    base_dir = scratch_dir(spark, "archive-stream")
    raw = v.raw_messages(spark, folder).select("event_id", "key", "value", "partition", "offset", "timestamp")
    in_batches([raw.filter(F.pmod("event_id", F.lit(3)) == i).drop("event_id") for i in range(3)], f"{base_dir}/in", lambda: wr.start_archive(
        rd.read_message_files(spark, f"{base_dir}/in"), f"{base_dir}/out", f"{base_dir}/checkpoint", F.col("timestamp"), 1_000,
        available_now=True).awaitTermination())
    back = spark.read.text(f"{base_dir}/out")
    return back.groupBy("year", "month", "day", "hour").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars")).select(
        *[F.col(c).cast("bigint").alias(c) for c in ("year", "month", "day", "hour")], "n", "chars")


def dead_letters(spark, folder):
    """The ingest stream: unusable messages are split off, everything else becomes logs."""
    base_dir = scratch_dir(spark, "ingest")
    stream = rd.read_message_files(spark, message_files(spark, folder, base_dir))
    jobs.start_ingest(stream, base_dir, f"{base_dir}/checkpoint", available_now=True).awaitTermination()
    letters = spark.read.parquet(f"{base_dir}/dead_letters").groupBy("reason").agg(F.count("*").alias("n"))
    logs = spark.read.parquet(f"{base_dir}/logs").agg(F.lit("written").alias("reason"), F.count("*").alias("n"))
    return letters.unionByName(logs)


FUTURE = '{"timestamp":"2031-01-01T00:00:00Z","service_name":"auth-svc","level":"INFO","message":"ahead"}'
SPLIT = "2024-01-16"


#: Rows of a message file: one is read by one task, so their number has to grow with the input.
FILE_ROWS = 50_000


def in_batches(parts: list[DataFrame], path: str, run) -> None:
    """Write each part as it lies and run the stream over what is new: one batch, in many tasks, for each part."""
    for part in parts:
        part.write.mode("append").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
        run()


def late_stream(spark, folder):
    """Three batches: early rows; rows that are partly late, with one from the future; rows that are all late by then."""
    base_dir = scratch_dir(spark, "late")
    raw = v.raw_messages(spark, folder).select("event_id", "key", "value", "partition", "offset", "timestamp")
    even = F.col("event_id") % 2 == 0
    ahead = raw.limit(1).withColumn("value", F.lit(FUTURE))
    parts = [part.drop("event_id") for part in (raw.filter(even & (F.col("timestamp") < SPLIT)), raw.filter(~even).unionByName(ahead),
                                                raw.filter(even & (F.col("timestamp") >= SPLIT)))]
    in_batches(parts, f"{base_dir}/in", lambda: jobs.start_ingest(
        rd.read_message_files(spark, f"{base_dir}/in"), base_dir, f"{base_dir}/checkpoint", available_now=True).awaitTermination())
    letters = spark.read.parquet(f"{base_dir}/dead_letters").groupBy("reason").agg(
        F.count("*").alias("n"), F.count("timestamp").alias("placed"))
    logs = spark.read.parquet(f"{base_dir}/logs").agg(
        F.lit("written").alias("reason"), F.count("*").alias("n"), F.count("event_date").alias("placed"))
    return letters.unionByName(logs)


def event_dead_letters(spark, folder):
    """Messages without an event: broken JSON, no id, nothing at all."""
    events = rep.anomaly_events(spark, folder).select(F.col("event_id").cast("string").alias("event_id"), "service")
    n = F.col("event_id").cast("bigint") % 10
    value = (F.when(n == 7, F.lit("not json")).when(n == 8, F.lit('{"service":"x"}')).when(n == 9, F.lit(""))
             .otherwise(F.to_json(F.struct("event_id", "service"))))
    messages = events.select(F.col("service").alias("key"), value.alias("value"), F.lit(3).alias("partition"),
                             F.col("event_id").cast("bigint").alias("offset"))
    return rd.undecodable_events(messages).select("offset", "reason", "value", "key")


def registry(spark, folder):
    """Registry file read back and joined with the services seen in the logs."""
    path = scratch_dir(spark, "registry")
    spark.range(1).select(F.lit(v.registry_document()).alias("value")).write.text(path)
    owners = rd.read_registry(spark, path).select("service", "owner.team", "owner.tier", "owner.pagerduty_service_id")
    counts = v.logs(spark, folder).groupBy("service").agg(F.count("*").alias("rows"))
    return owners.join(counts, "service", "left")


def consumed_events(spark, folder):
    """Stream of anomaly events from files; messages that do not decode are skipped."""
    base_dir = scratch_dir(spark, "events")
    rows = rep.anomaly_events(spark, folder).select(
        F.col("event_id").cast("string").alias("event_id"), "service", "anomaly_type", "severity", "z_score",
        "observed", "correlated_services", "timestamp")
    value = F.when(F.col("value").contains('7"'), F.lit("not json")).otherwise(F.col("value"))
    wr.event_messages(rows).select(
        "key", value.alias("value"), F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"),
        F.lit(None).cast("timestamp").alias("timestamp")).write.parquet(f"{base_dir}/in")
    decoded = rd.decode_events(rd.read_message_files(spark, f"{base_dir}/in"))
    out = jobs.run_to_table(decoded.drop("baseline", "top_log_samples"), f"{base_dir}/out", f"{base_dir}/checkpoint")
    return out.select("event_id", "service", "anomaly_type", F.element_at("observed", "error_rate").alias("error_rate"),
                      F.array_join("correlated_services", ",").alias("correlated"))


def consumed_windows(spark, folder):
    """Stream of window records from a mixed topic, to feature vectors."""
    base_dir = scratch_dir(spark, "records")
    windows = wr.json_messages(window_records(service_windows(v.logs(spark, folder), SIX_HOURS)))
    single = wr.json_messages(v.logs(spark, folder).select(F.lit("LOG_EVENT").alias("recordType"), "service"))
    windows.unionByName(single).select(
        "key", "value", F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"),
        F.lit(None).cast("timestamp").alias("timestamp")).write.parquet(f"{base_dir}/in")
    decoded = rd.decode_window_records(rd.read_message_files(spark, f"{base_dir}/in"))
    out = jobs.run_to_table(decoded.drop("topErrors"), f"{base_dir}/out", f"{base_dir}/checkpoint")
    return out.select("recordType", "service", "windowStartMs", "requestVolume", "p99LatencyMs")


def streamed(spark: SparkSession, rows: DataFrame, build, purpose: str) -> DataFrame:
    """Write rows as files, run a stream over them, return its output table."""
    base_dir = scratch_dir(spark, purpose)
    rows.write.parquet(f"{base_dir}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{base_dir}/in")
    return jobs.run_to_table(build(source), f"{base_dir}/out", f"{base_dir}/checkpoint")


def baseline_stream(spark, folder):
    rows = streamed(spark, base.samples(spark, folder), stateful.baseline_stream, "baseline-stream")
    return rows.select("service", "metric", "ts_us", base.r("ewma"), base.r("prev_ewma"))


def cooldown_stream(spark, folder):
    rows = v.alerts(spark, folder).select("event_id", "service", "ts")
    return streamed(spark, rows, lambda s: stateful.cooldown_stream(s, al.SCALED.cooldown), "cooldown-stream").select(
        "event_id", "service", "allowed")


def limiter_stream(spark, folder):
    rows = v.alerts(spark, folder).select("event_id", "service", "ts")
    return streamed(spark, rows, lambda s: stateful.limiter_stream(s, al.SCALED_LIMITER), "limiter-stream").select(
        "event_id", "service", "allowed")


def events_stream(spark, folder):
    """Window features in four batches to events: some rows come a batch late, and the last batch only moves the watermark on."""
    base_dir = scratch_dir(spark, "events-stream")
    rows = materialise(base.feature_rows(spark, folder), "events-features")
    third = F.floor((F.unix_micros("ts") - F.unix_micros(v.moment("2024-01-01 00:00:00"))) / (10 * 86_400_000_000))
    part = F.least(F.lit(2), F.greatest(F.lit(0), third)) + F.when(F.pmod(F.xxhash64("service", "ts"), F.lit(7)) == 0, 1).otherwise(0)
    dealt = rows.withColumn("_part", F.least(F.lit(2), part))
    ahead = rows.limit(1).withColumns({"service": F.lit("ahead"), "ts": v.moment("2031-01-01 00:00:00")})
    in_batches([*[dealt.where(F.col("_part") == i).drop("_part") for i in range(3)], ahead], f"{base_dir}/in", lambda: start_events(
        spark.readStream.schema(rows.schema).parquet(f"{base_dir}/in"), base_dir, f"{base_dir}/checkpoint", "21 days",
        detection=al.SENSITIVE, suppression=al.WINDOWED, available_now=True).awaitTermination())
    return al._event_columns(spark.read.parquet(f"{base_dir}/events"))


def updated_windows(spark, folder):
    """Window stream in update mode, upserted into a table."""
    base_dir = scratch_dir(spark, "updated-windows")
    v.logs(spark, folder).repartition(3, "event_id").write.parquet(f"{base_dir}/in")
    logs = spark.readStream.schema(v.logs(spark, folder).schema).option("maxFilesPerTrigger", 2).parquet(f"{base_dir}/in")
    # The files overlap in time, so the watermark has to wait for all of them.
    patient = WindowSettings(size=v.HOURS_6, allowed_lateness=40 * 86_400)
    jobs.start_windows(logs, f"{base_dir}/out", f"{base_dir}/checkpoint", patient, available_now=True).awaitTermination()
    return spark.read.parquet(f"{base_dir}/out").select(
        "service", F.unix_micros("window_start").alias("start_us"), "request_volume", "error_count", "warn_count", "p99_latency_ms")


QUERIES = {
    "S1_message_stream": message_stream,
    "S2_json_lines": json_files,
    "S3_plain_lines": plain_files,
    "S4_json_sink": json_sink,
    "S5_keyed_events": keyed_events,
    "S6_upsert_windows": upserted_windows,
    "S6_update_mode_stream": updated_windows,
    "S7_upsert_reports": upserted_reports,
    "S8_archive": archived,
    "S8_archive_stream": archived_stream,
    "S9_dead_letters": dead_letters,
    "S9_late_stream": late_stream,
    "S10_registry": registry,
    "S11_event_dead_letters": event_dead_letters,
    "S11_event_stream": consumed_events,
    "S11_window_record_stream": consumed_windows,
    "B1_ewma_stream": baseline_stream,
    "A1_cooldown_stream": cooldown_stream,
    "L1_limiter_stream": limiter_stream,
    "E4_events_stream": events_stream,
}

_RAW = v.with_ctes(v.LOGS, v.RAW_MESSAGES)
_JUDGED = _RAW + """, judged AS (
SELECT *, CASE WHEN value = '' THEN 'empty message' WHEN NOT json_valid(value) THEN 'malformed json'
  WHEN value NOT LIKE '{%' THEN 'not an object' END AS parse_error FROM raw_messages)
"""
_MULTILINE = ps.ORACLE["P15_multiline"]
_OWNED = _MULTILINE[:_MULTILINE.rindex("SELECT source_file")]
_ARCHIVE = _RAW + """SELECT CAST(year(timestamp) AS BIGINT) AS year, CAST(month(timestamp) AS BIGINT) AS month, CAST(day(timestamp) AS BIGINT) AS day,
  CAST(hour(timestamp) AS BIGINT) AS hour, count(*) AS n, CAST(sum(length(value)) AS BIGINT) AS chars FROM raw_messages GROUP BY ALL"""
_WIN = v.with_ctes(v.LOGS, v.windows_sql(v.HOURS_6))

ORACLE = {
    "S1_message_stream": _JUDGED + """SELECT CAST(partition AS BIGINT) AS partition, count(*) AS messages, max("offset") AS last_offset,
  count(parse_error) AS failed FROM judged GROUP BY partition""",
    "S2_json_lines": _JUDGED + """, read_lines AS (SELECT *, parse_error IS NULL AS is_json FROM judged WHERE value <> '')
SELECT is_json, CASE WHEN is_json THEN coalesce(json_extract_string(value, '$.level'), json_extract_string(value, '$.severity'),
  json_extract_string(value, '$.log_level')) ELSE '-' END AS level, count(*) AS n, count(*) AS with_path FROM read_lines GROUP BY 1, 2""",
    "S3_plain_lines": _OWNED + """, dense AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY line_no) - 1 AS pos FROM owned)
SELECT source_file, min(pos) AS first_line, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS log_md5
FROM dense GROUP BY source_file, first_line""",
    "S4_json_sink": v.with_ctes(v.LOGS) + """SELECT event_id, '{"event_id":' || CAST(event_id AS VARCHAR) || ',"service":"' || service
  || '","level":"' || level || '","latency_ms":' || coalesce(CAST(latency_ms AS VARCHAR), 'null') || '}' AS value FROM logs""",
    "S5_keyed_events": rep.BASE + "SELECT service AS key, event_id, severity FROM events_in",
    "S6_upsert_windows": v.with_ctes(v.LOGS) + """, versions AS (
  SELECT service, epoch_us(event_time) // 21600000000 * 21600000000 AS start_us, seq, count(*) AS request_volume,
    count(*) FILTER (level IN ('ERROR', 'CRITICAL')) AS error_count, quantile_disc(latency_ms, 0.99) AS p99_latency_ms
  FROM logs, (VALUES (CAST(0 AS BIGINT)), (1), (2)) s(seq)
  WHERE (seq = 0 AND event_id % 2 = 0) OR seq = 1 OR (seq = 2 AND event_time < TIMESTAMP '2024-01-10') GROUP BY ALL)
SELECT service || '-' || CAST(start_us // 1000 AS VARCHAR) AS doc_id, 'logs-aggregates-' || strftime(make_timestamp(start_us), '%Y.%m.%d') AS index_name,
  request_volume, error_count, p99_latency_ms, seq FROM versions QUALIFY row_number() OVER (PARTITION BY service, start_us ORDER BY seq DESC) = 1""",
    "S6_update_mode_stream": _WIN + "SELECT service, start_us, request_volume, error_count, warn_count, p99_latency_ms FROM windows",
    "S7_upsert_reports": rep.BASE + """SELECT event_id, new_severity AS severity, new_summary AS summary, ai_generated,
  CAST(CASE WHEN ai_generated THEN 1 ELSE 0 END AS BIGINT) AS seq FROM merged""",
    "S8_archive": _ARCHIVE,
    "S8_archive_stream": _ARCHIVE,
    "S9_dead_letters": _JUDGED + """SELECT coalesce(parse_error, 'written') AS reason, count(*) AS n FROM judged GROUP BY 1""",
    "S9_late_stream": ps.FULL + f""", marked AS (
  SELECT *, event_id % 2 = 0 AS even, epoch_us(event_time) // 60000000 * 60000000 + 90000000 AS final_us FROM normalised),
first AS (SELECT max(epoch_us(event_time)) AS mark FROM marked WHERE even AND timestamp < TIMESTAMP '{SPLIT}')
SELECT 'written' AS reason, count(*) + 1 AS n, count(*) + 1 AS placed FROM normalised
UNION ALL SELECT 'late event', count(*), count(*) FROM marked, first WHERE service <> 'unknown'
  AND ((NOT even AND final_us <= mark - 30000000) OR (even AND timestamp >= TIMESTAMP '{SPLIT}')) HAVING count(*) > 0
UNION ALL SELECT parse_error, count(*), count(*) FROM ({_JUDGED} SELECT * FROM judged) WHERE parse_error IS NOT NULL GROUP BY 1""",
    "S11_event_dead_letters": rep.BASE + """SELECT event_id AS "offset", CASE event_id % 10 WHEN 7 THEN 'malformed json' WHEN 8 THEN 'no event id'
  ELSE 'empty message' END AS reason, CASE event_id % 10 WHEN 7 THEN 'not json' WHEN 8 THEN '{"service":"x"}' ELSE '' END AS value, service AS key
FROM events_in WHERE event_id % 10 >= 7""",
    "S10_registry": v.with_ctes(v.LOGS, v.REGISTRY) + """SELECT r.service, team, tier, CASE WHEN r.service <> 'default' THEN 'PD-' || team END AS pagerduty_service_id,
  n AS rows FROM registry r LEFT JOIN (SELECT service, count(*) AS n FROM logs GROUP BY service) l ON l.service = r.service""",
    "S11_event_stream": rep.BASE + """SELECT CAST(event_id AS VARCHAR) AS event_id, service, anomaly_type, o1 AS error_rate, service || ',' || other AS correlated
FROM events_in WHERE event_id % 10 <> 7""",
    "S11_window_record_stream": _WIN + f"""SELECT '{RECORD_TYPE}' AS "recordType", service, start_us // 1000 AS "windowStartMs",
  request_volume AS "requestVolume", p99_latency_ms AS "p99LatencyMs" FROM windows""",
    "B1_ewma_stream": base.ORACLE["B1_ewma"],
    "A1_cooldown_stream": al.ORACLE["A1_cooldown"],
    "L1_limiter_stream": al.ORACLE["L1_alert_limiter"],
    "E4_events_stream": al.ORACLE["E4_detect_to_events"],
}

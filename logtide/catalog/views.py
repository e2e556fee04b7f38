"""Log, alert, deployment and registry views over the given tables, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.scalars import iso_utc

# Fixed values of the views.
SERVICES = (
    "payment-svc", "auth-svc", "order-svc", "inventory-svc",
    "notification-svc", "api-gateway", "recommendation-svc", "search-svc",
)
TEAMS = {
    "payment-svc": ("payments", "P1"), "auth-svc": ("identity", "P1"),
    "order-svc": ("commerce", "P1"), "inventory-svc": ("commerce", "P2"),
    "notification-svc": ("platform", "P2"), "api-gateway": ("platform", "P1"),
    "recommendation-svc": ("personalization", "P3"), "default": ("platform", "P3"),
}
HOURS_6 = 6 * 3_600


def moment(text: str):
    """Timestamp literal; the session time zone is UTC."""
    return F.lit(text).cast("timestamp")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def service_of(number):
    return F.element_at(F.array(*[F.lit(s) for s in SERVICES]), (number % 8 + 1).cast("int"))


def logs(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("event_time"), "user_id", "event_type",
        service_of(F.col("user_id")).alias("service"),
        F.when((kind == "error") & (F.col("event_id") % 5 == 0), "CRITICAL")
        .when(kind == "error", "ERROR").when(kind == "purchase", "WARNING")
        .when(kind == "signup", "DEBUG").otherwise("INFO").alias("level"),
        F.when(kind != "signup", F.floor("value").cast("bigint")).alias("latency_ms"),
        F.concat(kind, F.lit(" k="), (k % 10).cast("string")).alias("message"),
        F.when(F.col("user_id") % 4 == 0, "staging").otherwise("prod").alias("env"),
        F.concat(F.lit("host-"), (F.col("user_id") % 16).cast("string")).alias("host"))


LOGS = """logs AS (
  SELECT event_id, ts AS event_time, user_id, event_type,
    CASE user_id % 8 WHEN 0 THEN 'payment-svc' WHEN 1 THEN 'auth-svc' WHEN 2 THEN 'order-svc'
      WHEN 3 THEN 'inventory-svc' WHEN 4 THEN 'notification-svc' WHEN 5 THEN 'api-gateway'
      WHEN 6 THEN 'recommendation-svc' ELSE 'search-svc' END AS service,
    CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'CRITICAL'
      WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' THEN 'WARNING'
      WHEN event_type = 'signup' THEN 'DEBUG' ELSE 'INFO' END AS level,
    CASE WHEN event_type <> 'signup' THEN CAST(floor(value) AS BIGINT) END AS latency_ms,
    event_type || ' k=' || CAST(CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 10 AS VARCHAR) AS message,
    CASE WHEN user_id % 4 = 0 THEN 'staging' ELSE 'prod' END AS env,
    'host-' || CAST(user_id % 16 AS VARCHAR) AS host
  FROM events)"""


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    return logs(spark, folder).filter(F.col("level").isin("ERROR", "CRITICAL")).select(
        "event_id", "service", F.col("event_time").alias("ts"), "level", "message", "latency_ms",
        "user_id")


ALERTS = """alerts AS (
  SELECT event_id, service, event_time AS ts, level, message, latency_ms, user_id
  FROM logs WHERE level IN ('ERROR', 'CRITICAL'))"""


def raw_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Broker messages in three field spellings, some of them unusable."""
    e = logs(spark, folder)
    i = F.col("event_id")
    ms = F.unix_millis("event_time").cast("string")
    latency = F.coalesce(F.col("latency_ms").cast("string"), F.lit("null"))
    service = F.when(i % 31 == 0, "  ").otherwise(F.col("service"))
    first_time = F.when(i % 53 == 0, F.lit("yesterday")).otherwise(iso_utc(F.col("event_time")))
    first = F.concat(
        F.lit('{"timestamp":"'), first_time, F.lit('","level":"'), F.col("level"),
        F.lit('","message":"'), F.col("message"), F.lit('","service_name":"'), service,
        F.lit('","hostname":"'), F.col("host"), F.lit('","environment":"'), F.col("env"),
        F.lit('","trace_id":"t'), i.cast("string"),
        F.lit('","http":{"method":"GET","duration_ms":'), latency, F.lit("}}"))
    second = F.concat(
        F.lit('{"@timestamp":"'), ms, F.lit('","severity":"'), F.lower(F.substring("level", 1, 4)),
        F.lit('","msg":"'), F.col("message"), F.lit('","service":"'), service,
        F.lit('","host":"'), F.col("host"), F.lit('","env":"'), F.col("env"),
        F.lit('","span_id":"s'), i.cast("string"), F.lit('","latency_ms":'),
        F.when(i % 7 == 0, F.concat(F.lit('"'), latency, F.lit('"'))).otherwise(latency), F.lit("}"))
    third = F.concat(
        F.lit('{"time":"'), F.date_format("event_time", "yyyy-MM-dd HH:mm:ss,SSS"),
        F.lit('","log_level":" '), F.lower("level"), F.lit(' ","level":"","log":"'), F.col("message"),
        F.lit('","service_name":"'), service,
        F.lit('","error":{"type":"E'), (i % 5).cast("string"),
        F.lit('"},"extra":{"http":{"duration_ms":'), latency, F.lit('}},"user_id":'),
        F.col("user_id").cast("string"), F.lit("}"))
    text = F.when(i % 3 == 0, first).when(i % 3 == 1, second).otherwise(third)
    value = (
        F.when(i % 113 == 0, "").when(i % 127 == 0, "[1,2]")
        .when(i % 97 == 0, F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int")))
        .otherwise(text)
    )
    return e.select(
        "event_id", F.col("service").alias("key"), value.alias("value"),
        (F.col("user_id") % 4).cast("int").alias("partition"), i.alias("offset"),
        F.timestamp_micros(F.unix_micros("event_time") + 5_000_000).alias("timestamp"))


RAW_MESSAGES = r"""spelled AS (
  SELECT *, CAST((epoch_us(event_time) // 1000) AS VARCHAR) AS ms,
    coalesce(CAST(latency_ms AS VARCHAR), 'null') AS lat,
    CASE WHEN event_id % 31 = 0 THEN '  ' ELSE service END AS svc
  FROM logs),
texts AS (
  SELECT *, CASE event_id % 3
    WHEN 0 THEN '{"timestamp":"' || CASE WHEN event_id % 53 = 0 THEN 'yesterday'
        ELSE strftime(event_time, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END || '","level":"' || level
      || '","message":"' || message || '","service_name":"' || svc || '","hostname":"' || host
      || '","environment":"' || env || '","trace_id":"t' || CAST(event_id AS VARCHAR)
      || '","http":{"method":"GET","duration_ms":' || lat || '}}'
    WHEN 1 THEN '{"@timestamp":"' || ms || '","severity":"' || lower(level[1:4])
      || '","msg":"' || message || '","service":"' || svc || '","host":"' || host
      || '","env":"' || env || '","span_id":"s' || CAST(event_id AS VARCHAR) || '","latency_ms":'
      || CASE WHEN event_id % 7 = 0 THEN '"' || lat || '"' ELSE lat END || '}'
    ELSE '{"time":"' || strftime(event_time, '%Y-%m-%d %H:%M:%S,%g')
      || '","log_level":" ' || lower(level) || ' ","level":"","log":"' || message
      || '","service_name":"' || svc || '","error":{"type":"E' || CAST(event_id % 5 AS VARCHAR)
      || '"},"extra":{"http":{"duration_ms":' || lat || '}},"user_id":' || CAST(user_id AS VARCHAR) || '}'
    END AS text
  FROM spelled),
raw_messages AS (
  SELECT event_id, service AS key,
    CASE WHEN event_id % 113 = 0 THEN '' WHEN event_id % 127 = 0 THEN '[1,2]'
      WHEN event_id % 97 = 0 THEN left(text, CAST(floor(length(text) / 2) AS BIGINT))
      ELSE text END AS value,
    CAST(user_id % 4 AS INTEGER) AS partition, event_id AS "offset",
    event_time + INTERVAL 5 SECOND AS timestamp
  FROM texts)"""


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Logs in an arrival order that makes some of them late."""
    i = F.col("event_id")
    order = F.when(i % 50 == 0, (i + 40) * 2 + 1).otherwise(i * 2)
    return logs(spark, folder).withColumn("arrival_seq", order)


ARRIVALS = """arrivals AS (
  SELECT *, CASE WHEN event_id % 50 = 0 THEN (event_id + 40) * 2 + 1 ELSE event_id * 2 END AS arrival_seq
  FROM logs)"""


def deployments(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    start = 1_704_067_200_000_000  # 2024-01-01 in microseconds
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("deployment_id"), service_of(F.col("o_custkey")).alias("service"),
        F.timestamp_micros(F.lit(start) + (F.col("o_orderkey") % 43_200) * 60_000_000).alias("ts"),
        F.concat(F.lit("v"), (F.col("o_orderkey") % 100).cast("string")).alias("version"),
        F.col("c_name").alias("deployed_by"))


DEPLOYMENTS = """deployments AS (
  SELECT o_orderkey AS deployment_id,
    CASE o_custkey % 8 WHEN 0 THEN 'payment-svc' WHEN 1 THEN 'auth-svc' WHEN 2 THEN 'order-svc'
      WHEN 3 THEN 'inventory-svc' WHEN 4 THEN 'notification-svc' WHEN 5 THEN 'api-gateway'
      WHEN 6 THEN 'recommendation-svc' ELSE 'search-svc' END AS service,
    make_timestamp(1704067200000000 + (o_orderkey % 43200) * 60000000) AS ts,
    'v' || CAST(o_orderkey % 100 AS VARCHAR) AS version, c_name AS deployed_by
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


def registry_document() -> str:
    """Registry JSON for the views; `search-svc` is missing on purpose and gets the default."""
    import json

    return json.dumps({
        name: {
            "team": team, "oncall": f"{team}@example.org", "slack_channel": f"#{team}",
            "pagerduty_service_id": None if name == "default" else f"PD-{team}",
            "escalation_policy": f"{team}-policy", "tier": tier,
            "runbook_url": f"https://example.org/runbooks/{name}",
        } for name, (team, tier) in TEAMS.items()
    })


def registry(spark: SparkSession) -> DataFrame:
    from logtide.sources.readers import registry_rows

    return registry_rows(spark.range(1).select(F.lit(registry_document()).alias("value")))


REGISTRY = "registry(service, team, tier) AS (VALUES " + ", ".join(
    f"('{name}', '{team}', '{tier}')" for name, (team, tier) in TEAMS.items()) + ")"


def windows_sql(size: int) -> str:
    """Window aggregates over `logs` with the given window size in seconds."""
    width = size * 1_000_000
    return f"""windows AS (
  SELECT service, epoch_us(event_time) // {width} * {width} AS start_us,
    epoch_us(event_time) // {width} * {width} + {width} AS end_us,
    count(*) AS request_volume,
    count(*) FILTER (level IN ('ERROR', 'CRITICAL')) AS error_count,
    count(*) FILTER (level = 'WARNING') AS warn_count,
    quantile_disc(latency_ms, 0.5) AS p50_latency_ms,
    quantile_disc(latency_ms, 0.95) AS p95_latency_ms,
    quantile_disc(latency_ms, 0.99) AS p99_latency_ms,
    CAST(sum(latency_ms) // nullif(count(latency_ms), 0) AS BIGINT) AS avg_latency_ms,
    min_by(env, event_time) AS env
  FROM logs GROUP BY ALL),
features AS (
  SELECT service, end_us AS ts_us,
    error_count / request_volume AS error_rate,
    coalesce(CAST(p99_latency_ms AS DOUBLE), 0.0) AS p99_latency_ms,
    coalesce(CAST(avg_latency_ms AS DOUBLE), 0.0) AS avg_latency_ms,
    CAST(request_volume AS DOUBLE) AS request_volume,
    warn_count / request_volume AS warn_rate
  FROM windows),
samples AS (
  UNPIVOT features ON error_rate, p99_latency_ms, avg_latency_ms, request_volume, warn_rate
  INTO NAME metric VALUE value)"""


def with_ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"

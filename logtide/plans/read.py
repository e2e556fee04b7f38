"""Read queries over reports, logs, services and the live feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
LIST_FIELDS = ["event_id", "report_id", "service", "severity", "anomaly_type", "z_score", "ts", "summary"]
LOG_FIELDS = ["event_time", "service", "level", "message", "trace_id", "span_id", "error"]
MAX_PAGE, MAX_LOG_PAGE = 200, 500
LEAST_MINUTES, MOST_MINUTES = 1, 1_440
ANOMALY_HOURS, LOG_HOURS = 24, 1


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of a sorted result; Spark keeps only `offset + size` rows per task."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def default_start(end: Column, hours: int) -> Column:
    return F.timestamp_micros(F.unix_micros(end) - hours * 3_600_000_000)


def list_anomalies(reports: DataFrame, start: Column | None, end: Column, acks: DataFrame | None = None,
                   service: str | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """Reports in [start, end], newest first, with the acknowledged flag; the last 24 hours without a start."""
    if not 1 <= size <= MAX_PAGE or page < 1:
        raise ValueError(f"page must be positive and size between 1 and {MAX_PAGE}")
    start = default_start(end, ANOMALY_HOURS) if start is None else start
    found = reports.filter((F.col("ts") >= start) & (F.col("ts") <= end))
    if service:
        found = found.filter(F.col("service") == service)
    fields = [f for f in LIST_FIELDS if f in reports.columns]
    rows = page_of(found.select(*fields), [F.desc("ts"), F.desc("event_id")], page, size)
    if acks is None:
        return rows.withColumn("acknowledged", F.lit(False))
    marked = acks.select("event_id", F.lit(True).alias("acknowledged")).distinct()
    return rows.join(marked, "event_id", "left").withColumn(
        "acknowledged", F.coalesce("acknowledged", F.lit(False)))


def count_anomalies(reports: DataFrame, start: Column, end: Column, service: str | None = None) -> DataFrame:
    found = reports.filter((F.col("ts") >= start) & (F.col("ts") <= end))
    if service:
        found = found.filter(F.col("service") == service)
    return found.agg(F.count("*").alias("total"))


def acknowledge(acks: DataFrame) -> DataFrame:
    """Acknowledgements in order, with `already_set` for all but the first of an event."""
    w = Window.partitionBy("event_id").orderBy("ts", "ack_id")
    return acks.withColumn("already_set", F.row_number().over(w) > 1)


def effective_acks(acks: DataFrame) -> DataFrame:
    return acks.groupBy("event_id").agg(F.min("ts").alias("acknowledged_at"))


def search_logs(logs: DataFrame, start: Column | None, end: Column, service: str | None = None,
                level: str | None = None, page: int = 1, size: int = 50,
                tie_break: str = "event_id") -> DataFrame:
    """Log rows in [start, end], newest first; the level is matched in upper case.

    Without a start the last hour is searched. A table that `start_ingest` wrote is pruned to the days of the range.
    """
    if not 1 <= size <= MAX_LOG_PAGE or page < 1:
        raise ValueError(f"page must be positive and size between 1 and {MAX_LOG_PAGE}")
    start = default_start(end, LOG_HOURS) if start is None else start
    found = logs.filter((F.col("event_time") >= start) & (F.col("event_time") <= end))
    if "event_date" in logs.columns:
        found = found.filter(F.col("event_date").between(F.to_date(start), F.to_date(end)))
    if service:
        found = found.filter(F.col("service") == service)
    if level:
        found = found.filter(F.col("level") == level.upper())
    fields = [f for f in LOG_FIELDS if f in logs.columns]
    return page_of(found.select(tie_break, *fields), [F.desc("event_time"), F.desc(tie_break)], page, size)


def get_report(reports: DataFrame, key: str) -> DataFrame:
    """The report with this report id, else one with this event id; empty when not found."""
    matched = reports.filter((F.col("report_id") == key) | (F.col("event_id") == key))
    return matched.orderBy(F.when(F.col("report_id") == key, 0).otherwise(1), "report_id").limit(1)


def list_services(registry: DataFrame, reports: DataFrame, as_of: Column,
                  alerts: DataFrame | None = None, silences: DataFrame | None = None,
                  cooldown: int = 600, hours: int = 24, limit: int | None = None) -> DataFrame:
    """Registered services and those seen in reports lately, with owner, health, silenced; sorted by name.

    `limit` keeps only that many of the services seen lately, the busiest first.
    """
    recent = (
        reports.filter(F.col("ts") >= F.timestamp_micros(F.unix_micros(as_of) - hours * 3_600_000_000))
        .groupBy("service").agg(F.count("*").alias("_n"))
    )
    if limit is not None:
        recent = recent.orderBy(F.desc("_n"), "service").limit(limit)
    recent = recent.select("service")
    known = registry.filter(F.col("service") != "default").select("service")
    names = known.union(recent).distinct()
    # Imported here: enrichment is a sibling operator family.
    from logtide.operators.enrich import with_owner

    out = with_owner(names, registry)
    if alerts is not None:
        out = out.join(health(alerts, as_of, cooldown), "service", "left")
    else:
        out = out.withColumn("health", F.lit(None).cast("string"))
    if silences is not None:
        active = active_silences(silences, as_of).select("service", F.lit(True).alias("silenced")).distinct()
        out = out.join(active, "service", "left")
    else:
        out = out.withColumn("silenced", F.lit(False))
    return out.select(
        F.col("service").alias("id"), "oncall_owner.team", "oncall_owner.tier",
        "oncall_owner.oncall", "oncall_owner.slack_channel",
        F.coalesce("health", F.lit("healthy")).alias("health"),
        F.coalesce("silenced", F.lit(False)).alias("silenced")).orderBy("id")


def health(allowed_alerts: DataFrame, as_of: Column, cooldown: int = 600) -> DataFrame:
    """degraded while the last alert that passed is less than the cooldown ago."""
    last = (allowed_alerts.filter(F.col("ts") <= as_of)
            .groupBy("service").agg(F.max("ts").alias("_last")))
    age = F.unix_micros(as_of) - F.unix_micros("_last")
    return last.select("service", F.when(age < cooldown * 1_000_000, "degraded")
                       .otherwise("healthy").alias("health"))


def service_metrics(reports: DataFrame, service: str, as_of: Column, hours: int = 24,
                    limit: int | None = None) -> DataFrame:
    """Metric points of a service over the last hours, oldest first; all of them without a `limit`."""
    start = F.timestamp_micros(F.unix_micros(as_of) - hours * 3_600_000_000)
    fields = [f for f in ("ts", "z_score", "observed_metrics", "severity", "anomaly_type", "event_id")
              if f in reports.columns]
    points = (reports.filter((F.col("service") == service) & (F.col("ts") >= start) & (F.col("ts") <= as_of))
              .select(*fields).orderBy("ts", "event_id"))
    return points if limit is None else points.limit(limit)


def _in_bounds() -> Column:
    return F.coalesce(F.col("minutes").between(LEAST_MINUTES, MOST_MINUTES), F.lit(False))


def silence(requests: DataFrame) -> DataFrame:
    """Silence requests (service, ts, minutes) to intervals [from, to); others are in `rejected_silences`."""
    return requests.filter(_in_bounds()).select(
        "service", F.col("ts").alias("from_ts"),
        F.timestamp_micros(F.unix_micros("ts") + F.col("minutes").cast("bigint") * 60_000_000).alias("to_ts"))


def rejected_silences(requests: DataFrame) -> DataFrame:
    """Requests whose minutes are missing or out of bounds, with the reason."""
    reason = (F.when(F.col("minutes").isNull(), "minutes missing")
              .otherwise(f"minutes not between {LEAST_MINUTES} and {MOST_MINUTES}"))
    return requests.filter(~_in_bounds()).withColumn("reason", reason)


def active_silences(silences: DataFrame, as_of: Column) -> DataFrame:
    return silences.filter((F.col("from_ts") <= as_of) & (F.col("to_ts") > as_of))


def mark_silenced(alerts: DataFrame, silences: DataFrame, out: str = "silenced") -> DataFrame:
    """Add `silenced`: some silence of the service covers the alert time.

    Among the silences that started before an alert the latest end decides, which is a
    running maximum over alerts and silences together. A silence lasts at most a day, so it
    reaches into two day buckets, and every (service, day) is handled on its own.
    """
    day = 86_400_000_000

    def bucket(column: str) -> Column:
        return F.floor(F.unix_micros(column) / day)

    rows = alerts.withColumn("_ends", F.lit(None).cast("timestamp")).withColumn(
        "_side", F.lit(1)).withColumn("_bucket", bucket("ts"))
    starts = silences.select(
        "service", F.col("from_ts").alias("ts"), F.col("to_ts").alias("_ends"), F.lit(0).alias("_side"),
        F.explode(F.sequence(bucket("from_ts"), bucket("to_ts"))).alias("_bucket"))
    w = (Window.partitionBy("service", "_bucket").orderBy("ts", "_side")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        rows.unionByName(starts, allowMissingColumns=True)
        .withColumn("_until", F.max("_ends").over(w)).filter(F.col("_side") == 1)
        .withColumn(out, F.coalesce(F.col("_until") > F.col("ts"), F.lit(False)))
        .drop("_ends", "_side", "_until", "_bucket")
    )


def drop_silenced(alerts: DataFrame, silences: DataFrame) -> DataFrame:
    return mark_silenced(alerts, silences).filter(~F.col("silenced")).drop("silenced")


def live_feed(messages: DataFrame, service: str | None = None, value: str = "value") -> DataFrame:
    """Feed entries (event, id, data) from event messages; bad JSON is skipped."""
    doc = F.try_parse_json(F.col(value))
    staged = messages.select(F.col(value).alias("data"), doc.alias("_doc")).filter(F.col("_doc").isNotNull())
    field = {n: F.try_variant_get("_doc", f"$.{n}", "string") for n in ("service", "anomaly_type", "event_id")}
    if service:
        staged = staged.filter(field["service"] == service)
    return staged.select(
        F.coalesce(field["anomaly_type"], F.lit("anomaly")).alias("event"),
        field["event_id"].alias("id"), "data")

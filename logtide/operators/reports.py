"""Incident reports, routing, dispatch outcome and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtide.functions.scalars import (
    clamp01,
    is_blank,
    iso_utc,
    number_text,
    percent_change,
    pick,
    rounded_text,
)
from logtide.operators.chunks import running_count

# Texts of the report that is written without an external analysis.
NO_CAUSE = "Unable to determine — Claude API unavailable."
NO_IMPACT = ("Unknown — AI analysis unavailable. "
             "Treat as high-impact until a human assesses the situation.")
DEFAULT_ACTIONS = (
    "Check service logs for errors and stack traces.",
    "Review recent deployments for this service.",
    "Contact on-call engineer immediately if severity is P1.",
    "Monitor error rate and latency for recovery or escalation.",
)
SUMMARY_TAIL = "AI analysis unavailable — review raw metrics."

# Display names.
METRIC_LABELS = {
    "error_rate": "Error Rate",
    "p99_latency_ms": "P99 Latency",
    "latency_p99": "P99 Latency",
    "latency_p50": "P50 Latency",
    "request_rate": "Request Rate",
    "throughput": "Throughput",
    "cpu_usage": "CPU Usage",
    "memory_usage": "Memory Usage",
    "5xx_rate": "5xx Rate",
    "4xx_rate": "4xx Rate",
}
ANOMALY_LABELS = {
    "zscore_critical": "Spike",
    "both_tiers": "Anomaly",
    "system_wide_incident": "System-Wide Incident",
}
PAGING_SEVERITY = {"P1": "critical", "P2": "error", "P3": "warning"}
RESOLVE_BELOW = 1.5

# Severity, channels, chat targets, email, paging.
ROUTING_RULES = (
    ("P1", ["pagerduty", "slack", "email"], ["#incidents"], True, True),
    ("P2", ["slack", "email"], ["#alerts"], True, False),
    ("P3", ["slack"], ["#monitoring"], False, False),
)
DEFAULT_RULE = "P3"


def affected_services(service: Column, correlated: Column) -> Column:
    return F.concat(F.array(service), F.filter(correlated, lambda s: s != service))


def evidence_lines(observed: Column) -> Column:
    return F.transform(F.map_entries(observed), lambda e: F.concat(
        e["key"], F.lit(": observed="), number_text(e["value"])))


def fallback_reports(events: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """Report built from the metrics of each event alone; confidence 0."""
    summary = F.concat(
        F.lit("Anomaly detected in "), F.col("service"), F.lit(": "), F.col("anomaly_type"),
        F.lit(" (z="), F.format_string("%.2f", F.col("z_score")), F.lit("). " + SUMMARY_TAIL))
    return events.select(
        F.sha2(F.concat_ws("|", F.lit("report"), F.col("event_id").cast("string")), 256).alias("report_id"),
        "event_id", "service", "severity", "anomaly_type", "timestamp",
        iso_utc(generated_at if generated_at is not None else F.current_timestamp()).alias("generated_at"),
        summary.alias("summary"),
        affected_services(F.col("service"), F.col("correlated_services")).alias("affected_services"),
        F.lit(NO_CAUSE).alias("probable_cause"),
        evidence_lines(F.col("observed")).alias("evidence"),
        F.array(*[F.lit(a) for a in DEFAULT_ACTIONS]).alias("suggested_actions"),
        F.lit(NO_IMPACT).alias("estimated_user_impact"),
        F.lit(0.0).alias("confidence_score"),
        F.lit(False).alias("ai_generated"),
        "oncall_owner", "z_score",
        F.col("observed").alias("observed_metrics"),
        F.col("baseline").alias("baseline_metrics"),
        "pii_scrub_count", "top_log_samples")


def merge_analysis(reports: DataFrame, analysis: DataFrame) -> DataFrame:
    """Replace the fallback texts where an external analysis of the event exists.

    `analysis` is keyed by event_id; any of its fields may be null. Missing fields of an
    existing analysis become empty, not the fallback text.
    """
    a = analysis.select("event_id", F.lit(True).alias("_found"), *[
        F.col(c).alias(f"_{c}") for c in (
            "severity", "summary", "affected_services", "probable_cause", "evidence",
            "suggested_actions", "estimated_user_impact", "confidence_score")])
    empty = F.expr("cast(array() as array<string>)")

    def chosen(name: str, missing: Column) -> Column:
        return F.when(F.col("_found"), F.coalesce(F.col(f"_{name}"), missing)).otherwise(F.col(name))

    return (
        reports.join(a, "event_id", "left")
        .withColumns({
            "severity": chosen("severity", F.col("severity")),
            "summary": chosen("summary", F.lit("")),
            "affected_services": chosen("affected_services", F.array("service")),
            "probable_cause": chosen("probable_cause", F.lit("")),
            "evidence": chosen("evidence", empty),
            "suggested_actions": chosen("suggested_actions", empty),
            "estimated_user_impact": chosen("estimated_user_impact", F.lit("")),
            "confidence_score": F.when(
                F.col("_found"), clamp01(F.coalesce("_confidence_score", F.lit(0.0))))
            .otherwise(F.col("confidence_score")),
            "ai_generated": F.coalesce("_found", F.lit(False)),
        })
        .drop(*[c for c in a.columns if c != "event_id"])
    )


def routing_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        ROUTING_RULES, "severity string, channels array<string>, slack_channels array<string>, "
                       "send_email boolean, send_pagerduty boolean")


def with_rule(reports: DataFrame) -> DataFrame:
    """Add the rule of each severity; unknown severities get the rule of P3."""
    rules = routing_rules(reports.sparkSession).withColumnRenamed("severity", "_rule")
    known = [r[0] for r in ROUTING_RULES]
    rule = F.when(F.col("severity").isin(*known), F.col("severity")).otherwise(DEFAULT_RULE)
    # Three rows, fixed.
    return reports.withColumn("_rule", rule).join(F.broadcast(rules), "_rule").drop("_rule")


def route(reports: DataFrame) -> DataFrame:
    """Routing decision: rule targets plus the owner's channel, email recipient if enabled."""
    channel, oncall = F.col("oncall_owner.slack_channel"), F.col("oncall_owner.oncall")
    extra = ~is_blank(channel) & ~F.array_contains("slack_channels", channel)
    none = F.expr("cast(array() as array<string>)")
    mailed = F.col("send_email") & ~is_blank(oncall)
    return with_rule(reports).withColumns({
        "slack_targets": F.when(extra, F.array_append("slack_channels", channel))
        .otherwise(F.col("slack_channels")),
        "email_recipients": F.when(mailed, F.array(oncall)).otherwise(none),
    }).drop("slack_channels")


def dispatch(routed: DataFrame, limits: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Outcome per report from its route and its limiter decision (id, allowed, ts).

    A limited report goes to the digest; its pending count is the number of limited
    reports of the service so far.
    """
    decisions = limits.select(id_col, F.col("allowed").alias("_allowed"), F.col("ts").alias("_at"))
    limited = ~F.col("_allowed")
    none = F.expr("cast(array() as array<string>)")
    day = F.floor(F.unix_micros("_at") / 86_400_000_000)
    joined = running_count(routed.join(decisions, id_col), ["service"], ["_at", id_col], day, limited, "_pending")
    return joined.select(
        id_col, "service", "severity",
        F.when(limited, none).otherwise(F.col("channels")).alias("channels_dispatched"),
        F.when(limited, none).otherwise(F.col("slack_targets")).alias("slack_targets_notified"),
        (F.col("_allowed") & F.col("send_pagerduty")).alias("pagerduty_triggered"),
        limited.alias("rate_limited"), limited.alias("digest_queued"),
        F.when(limited, F.col("_pending"))
        .otherwise(F.lit(0).cast("bigint")).alias("digest_pending_count"))


def digest_line(chars: int = 60) -> Column:
    """Line of a digest; a summary is shown up to `chars` characters."""
    short = F.when(F.length("summary") > chars, F.concat(F.substring("summary", 1, chars), F.lit("…"))
                   ).otherwise(F.col("summary"))
    when = F.replace(F.substring("timestamp", 1, 19), F.lit("T"), F.lit(" "))
    return F.concat(
        F.lit("• ["), F.col("severity"), F.lit("] `"), F.col("anomaly_type"), F.lit("` z="),
        F.format_string("%.1f", F.col("z_score")), F.lit(" — "), short, F.lit(" — _"), when, F.lit("_"))


def digests(limited: DataFrame, period: Column) -> DataFrame:
    """Digest of the rate-limited reports of a service: count, lines, highest z, mean confidence.

    There is one digest per service and `period`, the flush interval of the digest.
    """
    rows = limited.withColumn("_line", digest_line()).withColumn("period", period)
    grouped = rows.groupBy("service", "period").agg(
        F.count("*").alias("suppressed"),
        F.max("z_score").alias("max_z"),
        F.avg("confidence_score").alias("avg_confidence"),
        F.array_sort(F.collect_list(F.struct("timestamp", "event_id", "_line"))).alias("_lines"))
    plural = F.when(F.col("suppressed") != 1, "s").otherwise("")
    return grouped.withColumns({
        "title": F.concat(F.lit("Alert digest for "), F.col("service"), F.lit(": "),
                          F.col("suppressed").cast("string"), F.lit(" suppressed alert"), plural),
        "lines": F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n"),
    }).drop("_lines")


def metric_label(metric: Column) -> Column:
    return pick(metric, METRIC_LABELS, F.initcap(F.replace(metric, F.lit("_"), F.lit(" "))))


def primary_metric(observed: Column, baseline: Column) -> Column:
    """Struct (metric, pct) of the largest absolute change against the ewma; first wins ties."""
    entries = F.map_entries(observed)

    def best(acc: Column, e: Column) -> Column:
        pct = percent_change(e["value"], F.element_at(baseline, e["key"])["ewma"])
        better = pct.isNotNull() & (acc["pct"].isNull() | (F.abs(pct) > F.abs(acc["pct"])))
        return F.when(better, F.struct(e["key"].alias("metric"), pct.alias("pct"))).otherwise(acc)

    start = F.struct(F.lit("").alias("metric"), F.lit(None).cast("double").alias("pct"))
    return F.aggregate(entries, start, best)


def header_text(reports: DataFrame) -> DataFrame:
    """Add `primary_metric`, `primary_pct` and `header`."""
    best = primary_metric(F.col("observed_metrics"), F.col("baseline_metrics"))
    staged = reports.withColumn("_best", best).withColumns({
        "primary_metric": metric_label(F.col("_best.metric")), "primary_pct": F.col("_best.pct")})
    label = pick(F.col("anomaly_type"), ANOMALY_LABELS, F.lit("Anomaly"))
    start = F.concat(F.lit("["), F.col("severity"), F.lit("] "))
    plain = F.concat(start, F.col("service"), F.lit(" — "), F.col("primary_metric"), F.lit(" "), label)
    sign = F.when(F.col("primary_pct") >= 0, "+").otherwise("")
    signed = F.concat(plain, F.lit(" ("), sign, rounded_text(F.col("primary_pct")), F.lit("%)"))
    storm = F.concat(start, F.lit("System-Wide Incident — Multiple Services Affected"))
    return staged.withColumn(
        "header",
        F.when(F.col("anomaly_type") == "system_wide_incident", storm)
        .when(F.col("primary_pct").isNotNull(), signed).otherwise(plain)).drop("_best")


def repeated_messages(samples: DataFrame, key: str = "event_id", n: int = 3) -> DataFrame:
    """The n most repeated messages of each report's samples, as ranked rows.

    `samples` has one row per sample: key, pos, message. Ties go to the earlier message.
    """
    text = F.trim("message")
    counted = (
        samples.filter(~is_blank(F.col("message")))
        .groupBy(key, text.alias("message"))
        .agg(F.count("*").alias("count"), F.min("pos").alias("_first"))
    )
    w = Window.partitionBy(key).orderBy(F.desc("count"), "_first")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("_first")


def message_line(rank: Column, message: Column, count: Column, chars: int = 80) -> Column:
    """Line of a ranked message, shown up to `chars` characters."""
    short = F.when(F.length(message) > chars, F.concat(F.substring(message, 1, chars), F.lit("…"))).otherwise(message)
    times = F.when(count > 1, F.concat(F.lit(" ×"), count.cast("string"))).otherwise(F.lit(""))
    return F.concat(rank.cast("string"), F.lit(". `"), short, F.lit("`"), times)


def paging_actions(reports: DataFrame) -> DataFrame:
    """Add dedup_key, action (trigger or resolve) and paging_severity."""
    return reports.withColumns({
        "dedup_key": F.concat_ws("_", "service", "anomaly_type"),
        "action": F.when(F.col("z_score") < RESOLVE_BELOW, "resolve").otherwise("trigger"),
        "paging_severity": pick(F.col("severity"), PAGING_SEVERITY, F.lit("warning")),
    })


def incident_state(actions: DataFrame, time_col: str = "ts", tie_break: str = "event_id") -> DataFrame:
    """Latest action per dedup key, and whether the incident is open."""
    latest = actions.groupBy("dedup_key").agg(
        F.max_by("action", F.struct(time_col, tie_break)).alias("last_action"),
        F.max(time_col).alias("last_change"), F.count("*").alias("changes"))
    return latest.withColumn("is_open", F.col("last_action") == "trigger")

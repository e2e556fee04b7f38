"""Anomaly events from detections and suppression decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions.scalars import iso_utc
from logtide.operators.suppress import suppress
from logtide.session import materialise
from logtide.settings import SuppressionSettings

# Fixed values.
MAX_SAMPLES = 20
STORM_TYPE = "system_wide_incident"
STORM_SERVICE = "system"


def severity(anomaly_type: Column, z: Column) -> Column:
    return (
        F.when((anomaly_type == STORM_TYPE) | (z > 5.0), "P1")
        .when(anomaly_type == "both_tiers", "P2")
        .otherwise("P3")
    )


def event_key(service: Column, ts: Column) -> Column:
    """Repeatable event id of a (service, window)."""
    return F.sha2(F.concat_ws("|", service, F.unix_micros(ts).cast("string")), 256)


def build_events(decided: DataFrame) -> DataFrame:
    """Events for allowed anomalies and one system-wide event per storm.

    Input: detections (service, ts, max_z, verdict_reason, observed, baseline,
    top_log_samples) with the suppression columns (event_id, allowed, is_storm,
    storm_services). Suppressed anomalies give no event.
    """
    storm = F.col("is_storm")
    kind = F.when(storm, STORM_TYPE).otherwise(F.col("verdict_reason"))

    def empty_if_storm(name: str) -> Column:
        kind_of = decided.schema[name].dataType.simpleString()
        return F.when(storm, F.expr(f"cast(map() as {kind_of})")).otherwise(F.col(name)).alias(name)

    return decided.filter(F.col("allowed") | storm).select(
        "event_id",
        F.when(storm, STORM_SERVICE).otherwise(F.col("service")).alias("service"),
        kind.alias("anomaly_type"),
        severity(kind, F.col("max_z")).alias("severity"),
        F.col("max_z").alias("z_score"),
        empty_if_storm("baseline"), empty_if_storm("observed"),
        F.slice("top_log_samples", 1, MAX_SAMPLES).alias("top_log_samples"),
        F.col("storm_services").alias("correlated_services"),
        "ts",
        iso_utc(F.col("ts")).alias("timestamp"))


def emit_events(detections: DataFrame, samples: DataFrame | None = None,
                settings: SuppressionSettings = SuppressionSettings()) -> DataFrame:
    """Detections to events: keep anomalies, suppress, build.

    `samples` (service, ts, top_log_samples) is optional. The anomalies are written out
    once: they are few, and both the suppression and the events need them.
    """
    found = materialise(detections.filter("is_anomaly").withColumn(
        "event_id", event_key(F.col("service"), F.col("ts"))), "anomalies")
    decisions = suppress(found, settings).drop("service", "ts")
    decided = found.join(decisions, "event_id")
    no_samples = F.expr("cast(array() as array<struct<message:string,count:bigint>>)")
    if samples is None:
        decided = decided.withColumn("top_log_samples", no_samples)
    else:
        decided = decided.join(samples, ["service", "ts"], "left").withColumn(
            "top_log_samples", F.coalesce("top_log_samples", no_samples))
    return build_events(decided)

"""Context joins for anomaly events: logs, correlated anomalies, deployments, owners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.operators.nearest import newest_in_range, newest_of_others

# Seconds before and after the event, and list lengths.
LOGS_BEFORE, LOGS_AFTER, MAX_LOGS = 300, 60, 20
CORRELATION_RADIUS, MAX_CORRELATED = 120, 20
MAX_DEPLOYMENTS = 3
CORRELATED_FIELDS = ["event_id", "service", "anomaly_type", "severity", "ts", "z_score", "summary"]


def _shift(column: str, seconds: int):
    return F.timestamp_micros(F.unix_micros(column) + seconds * 1_000_000)


def log_samples(events: DataFrame, logs: DataFrame, payload: list[str], log_time: str = "event_time",
                log_id: str = "event_id", before: int = LOGS_BEFORE, after: int = LOGS_AFTER,
                limit: int = MAX_LOGS, lists: bool = False) -> DataFrame:
    """Newest log rows of the event's service around the event, as ranked rows or lists."""
    return newest_in_range(
        events, logs, "service", "event_id", _shift("ts", -before), _shift("ts", after),
        log_time, log_id, payload, limit, lists=lists)


def correlated_anomalies(events: DataFrame, anomalies: DataFrame | None = None,
                         radius: int = CORRELATION_RADIUS, limit: int = MAX_CORRELATED,
                         fields: list[str] | None = None, lists: bool = False) -> DataFrame:
    """Newest anomalies of other services within `radius` seconds of each event.

    An event looks at no more than `limit` rows, however many services are busy around it and however long the range is.
    """
    found = anomalies if anomalies is not None else events
    fields = fields or [c for c in CORRELATED_FIELDS if c in found.columns]
    return newest_of_others(
        events, found, "service", "event_id", _shift("ts", -radius), _shift("ts", radius), "ts", "event_id",
        [F.col(f).alias(f"other_{f}") for f in fields], limit, lists)


def recent_deployments(events: DataFrame, deployments: DataFrame, payload: list[str],
                       deployment_id: str = "deployment_id", limit: int = MAX_DEPLOYMENTS, lists: bool = False) -> DataFrame:
    """Last deployments of the event's service up to the event time, as ranked rows or lists."""
    return newest_in_range(
        events, deployments, "service", "event_id", None, F.col("ts"),
        "ts", deployment_id, payload, limit, bucket_seconds=86_400, lists=lists)


def with_owner(df: DataFrame, registry: DataFrame, service: str = "service",
               out: str = "oncall_owner") -> DataFrame:
    """Add the owner of each service, else the default entry, else null.

    The first join finds the services that have an entry of their own, the second fetches the
    owner under that name or under `default`. There is no broadcast hint: Spark broadcasts
    the registry when its measured size is below the threshold.
    """
    names = registry.filter(F.col("service") != "default").select(F.col("service").alias("_name"))
    owners = registry.select(F.col("service").alias("_owner_key"), F.col("owner").alias(out))
    return (
        df.join(names, F.col(service) == F.col("_name"), "left")
        .withColumn("_key", F.coalesce("_name", F.lit("default")))
        .join(owners, F.col("_key") == F.col("_owner_key"), "left")
        .drop("_name", "_key", "_owner_key")
    )


def registered_services(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("service") != "default").select("service")


def as_lists(ranked: DataFrame, fields: list[str], out: str) -> DataFrame:
    """Ranked rows to one ordered list of structs per event; lists are bounded by the rank."""
    return (
        ranked.groupBy("event_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("_l"))
        .select("event_id", F.transform(
            "_l", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(out))
    )


def one_list(lists: DataFrame, out: str) -> DataFrame:
    """(event_id, out): the lists `found` of events, one for each id; those of events that share an id are merged by rank."""
    ranked = F.flatten(F.transform("_l", lambda found: F.transform(found, lambda x, i: F.struct(i.alias("rank"), x.alias("row")))))
    merged = F.transform(F.array_sort(ranked), lambda x: x["row"])
    return (lists.groupBy("event_id").agg(F.collect_list("found").alias("_l"))
            .select("event_id", F.when(F.size("_l") == 1, F.col("_l")[0]).otherwise(merged).alias(out)))


def enrich(events: DataFrame, logs: DataFrame, deployments: DataFrame, registry: DataFrame,
           log_fields: tuple[str, ...] = ("level", "message"),
           deployment_fields: tuple[str, ...] = ("version", "deployed_by"),
           log_id: str = "log_id", deployment_id: str = "deployment_id",
           other_fields: tuple[str, ...] | None = None) -> DataFrame:
    """Events with log_samples, correlated_anomalies, recent_deployments, oncall_owner.

    Events without a match get empty lists.
    """
    other = list(other_fields) if other_fields else [f for f in CORRELATED_FIELDS if f in events.columns]
    parts = [
        one_list(log_samples(events, logs, list(log_fields), log_id=log_id, lists=True), "log_samples"),
        one_list(correlated_anomalies(events, fields=other, lists=True), "correlated_anomalies"),
        one_list(recent_deployments(events, deployments, list(deployment_fields), deployment_id, lists=True), "recent_deployments"),
    ]
    out = events
    for part in parts:
        name = part.columns[-1]
        kind = part.schema[name].dataType.simpleString()
        out = out.join(part, "event_id", "left").withColumn(
            name, F.coalesce(F.col(name), F.expr(f"cast(array() as {kind})")))
    return with_owner(out, registry).withColumn("pii_scrub_count", F.lit(0))

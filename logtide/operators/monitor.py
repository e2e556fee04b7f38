"""Functions over metric series.

A series table has a time column `ts`, label columns and `value`. Windows run per series;
a series has one row per scrape, so its length is the time range over the scrape interval.
Range functions use the samples in (ts - range, ts] and do not extrapolate at the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
# Histogram bucket bounds in seconds.
PROCESSING_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
INFERENCE_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5)
REPORT_BUCKETS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 30.0, 60.0)
REQUEST_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
SLA_SECONDS = 60.0
EPSILON = 0.0001


def summed(series: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """sum by (...) at every scrape time."""
    return series.groupBy("ts", *by).agg(F.sum("value").alias("value"))


def above(series: DataFrame, threshold: float) -> DataFrame:
    return series.filter(F.col("value") > threshold)


def held(series: DataFrame, condition: Column, seconds: int, labels: tuple[str, ...] = ()) -> DataFrame:
    """Add `breach` and `firing`: the condition has been true without a break for `seconds`."""
    w = Window.partitionBy(*labels).orderBy("ts")
    staged = series.withColumn("breach", condition)
    staged = staged.withColumn("_run", F.sum((~F.col("breach")).cast("bigint")).over(w))
    run = Window.partitionBy(*labels, "_run", "breach")
    since = F.min(F.when(F.col("breach"), F.col("ts"))).over(run)
    lasted = F.unix_micros("ts") - F.unix_micros(since)
    return staged.withColumn(
        "firing", F.col("breach") & (lasted >= seconds * SECOND)).drop("_run")


def counter_steps(counters: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Add `step`: growth since the previous scrape; after a reset the new value counts."""
    w = Window.partitionBy(*labels).orderBy("ts")
    before = F.lag("value").over(w)
    return counters.withColumn("_before", before).withColumn(
        "step",
        F.when(F.col("_before").isNull(), F.lit(0.0))
        .when(F.col("value") < F.col("_before"), F.col("value"))
        .otherwise(F.col("value") - F.col("_before")).cast("double")).drop("_before")


def increase(counters: DataFrame, labels: tuple[str, ...], seconds: int) -> DataFrame:
    """Growth of each counter over (ts - seconds, ts], as `increase`."""
    w = (Window.partitionBy(*labels).orderBy(F.unix_micros("ts"))
         .rangeBetween(-(seconds * SECOND - 1), 0))
    return counter_steps(counters, labels).withColumn("increase", F.sum("step").over(w)).drop("step")


def rate(counters: DataFrame, labels: tuple[str, ...], seconds: int) -> DataFrame:
    """Growth per second over the range, as `rate`."""
    return increase(counters, labels, seconds).withColumn(
        "rate", F.col("increase") / seconds).drop("increase")


def rate_by(counters: DataFrame, labels: tuple[str, ...], seconds: int, by: tuple[str, ...],
            scale: float = 1.0) -> DataFrame:
    """sum by (...) (rate(x[range])) * scale."""
    return rate(counters, labels, seconds).groupBy("ts", *by).agg(
        (F.sum("rate") * scale).alias("value"))


def histogram_quantile(buckets: DataFrame, q: float, by: tuple[str, ...] = ("ts",),
                       le: str = "le", cumulative: str = "value") -> DataFrame:
    """Quantile from cumulative buckets by linear interpolation.

    `le` is the upper bound as double with infinity for the last bucket. In the last bucket
    the answer is the largest finite bound; null without observations.
    """
    w = Window.partitionBy(*by).orderBy(le)
    staged = (
        buckets
        .withColumn("_below", F.coalesce(F.lag(cumulative).over(w), F.lit(0.0)))
        .withColumn("_lower", F.coalesce(F.lag(le).over(w), F.lit(0.0)))
        .withColumn("_total", F.max(cumulative).over(Window.partitionBy(*by)))
    )
    rank = F.lit(q) * F.col("_total")
    hit = F.col(cumulative) >= rank
    inside = F.col("_lower") + (F.col(le) - F.col("_lower")) * (
        (rank - F.col("_below")) / (F.col(cumulative) - F.col("_below")))
    flat = F.col(cumulative) == F.col("_below")
    value = (
        F.when(F.col(le) == F.lit(float("inf")), F.col("_lower"))
        .when(flat, F.col(le)).otherwise(inside)
    )
    # The first bucket that reaches the rank has the smallest bound.
    reached = staged.filter(F.col("_total") > 0).filter(hit)
    return reached.groupBy(*by).agg(F.min_by(value, F.col(le)).alias("quantile"))


def combined_quantile(first: DataFrame, second: DataFrame, on: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Sum of two quantile series at the same time, as `value`."""
    return first.join(second.withColumnRenamed("quantile", "_q"), list(on)).select(
        *on, (F.col("quantile") + F.col("_q")).alias("value"))


def slo_compliance(latency: Column, sla: float = SLA_SECONDS) -> Column:
    return 100 * (1 - F.greatest(latency - sla, F.lit(0.0)) / sla)


def ratio(part: Column, total: Column, epsilon: float = EPSILON) -> Column:
    return part / (total + epsilon)


def matches(label: Column, pattern: str) -> Column:
    """Label regular expression, anchored at both ends."""
    return label.rlike(f"^(?:{pattern})$")


def silent(spine: DataFrame, counters: DataFrame, labels: tuple[str, ...], seconds: int) -> DataFrame:
    """Dead-man switch: rows of `spine` (ts, labels) with no sample at that time or no
    growth over the range, with `reason` absent or stalled."""
    keys = ["ts", *labels]
    absent = spine.join(counters.select(*keys), keys, "left_anti").select(
        *keys, F.lit("absent").alias("reason"))
    stalled = increase(counters, labels, seconds).filter(F.col("increase") == 0).select(
        *keys, F.lit("stalled").alias("reason"))
    return absent.unionByName(stalled.join(spine.select(*keys), keys, "left_semi"))


def recovered(counters: DataFrame, labels: tuple[str, ...], seconds: int) -> DataFrame:
    return increase(counters, labels, seconds).filter(F.col("increase") > 0)


def top_increase(counters: DataFrame, labels: tuple[str, ...], by: str, start: Column, end: Column,
                 k: int = 10) -> DataFrame:
    """topk(k, sum by (label) (increase over the whole range))."""
    return total_increase(counters, labels, (by,), start, end).orderBy(F.desc("value"), by).limit(k)


def total_increase(counters: DataFrame, labels: tuple[str, ...], by: tuple[str, ...],
                   start: Column, end: Column) -> DataFrame:
    """sum by (...) of the growth over (start, end]."""
    inside = (F.col("ts") > start) & (F.col("ts") <= end)
    steps = counter_steps(counters, labels).filter(inside)
    return steps.groupBy(*by).agg(F.sum("step").alias("value"))


def inhibit(alerts: DataFrame, equal: tuple[str, ...] = ("component", "ts"),
            source: str = "critical", targets: tuple[str, ...] = ("warning", "info")) -> DataFrame:
    """Drop target alerts while a source alert with equal labels is firing."""
    sources = alerts.filter(F.col("severity") == source).select(*equal).distinct()
    muted = alerts.filter(F.col("severity").isin(*targets))
    others = alerts.filter(~F.col("severity").isin(*targets))
    return others.unionByName(muted.join(sources, list(equal), "left_anti"))


# Receivers per severity with wait and repeat times in seconds. Critical
# alerts fall through to two receivers; everything else goes to the default receiver.
ROUTES = (
    ("critical", "pagerduty-critical", 30, 4 * 3_600),
    ("critical", "slack-incidents", 10, 4 * 3_600),
    ("warning", "slack-monitoring", 30, 2 * 3_600),
    ("info", "slack-monitoring", 30, 24 * 3_600),
)
DEFAULT_ROUTE = ("slack-monitoring", 30, 4 * 3_600)


def receivers(alerts: DataFrame) -> DataFrame:
    """One row per alert and receiver, with group_wait and repeat_interval."""
    def as_struct(r: tuple[str, int, int]) -> Column:
        return F.struct(F.lit(r[0]).alias("receiver"), F.lit(r[1]).alias("group_wait"),
                        F.lit(r[2]).alias("repeat_interval"))

    by_severity: dict[str, list[Column]] = {}
    for severity, *rest in ROUTES:
        by_severity.setdefault(severity, []).append(as_struct(tuple(rest)))
    expr = None
    for severity, targets in by_severity.items():
        test = F.col("severity") == severity
        expr = F.when(test, F.array(*targets)) if expr is None else expr.when(test, F.array(*targets))
    expr = expr.otherwise(F.array(as_struct(DEFAULT_ROUTE)))
    return alerts.withColumn("_r", F.explode(expr)).select("*", "_r.*").drop("_r")


def consumer_lag(end_offsets: DataFrame, committed: DataFrame) -> DataFrame:
    """max(0, end - committed) per (topic, partition); nothing committed counts as 0."""
    keys = ["topic", "partition"]
    return end_offsets.join(committed, keys, "left").select(
        *keys, F.greatest(F.lit(0).cast("bigint"),
                          F.col("end_offset") - F.coalesce("committed_offset", F.lit(0))).alias("lag"))


def observe(durations: DataFrame, value: Column, bounds: tuple[float, ...],
            labels: tuple[str, ...]) -> DataFrame:
    """Cumulative histogram of `value` per label set: rows (labels, le, value).

    All buckets are counted in one aggregation and unfolded afterwards, so the input is not
    multiplied by the number of buckets.
    """
    limits = [*bounds, float("inf")]
    counted = durations.withColumn("_v", value).groupBy(*labels).agg(
        *[F.count_if(F.col("_v") <= b).cast("double").alias(f"_b{i}") for i, b in enumerate(limits)])
    entries = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("value"))
                        for i, b in enumerate(limits)])
    return counted.select(*labels, F.explode(entries).alias("_e")).select(*labels, "_e.*")


def count_by_labels(events: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Counter values: events per label set."""
    return events.groupBy(*labels).agg(F.count("*").cast("double").alias("value"))

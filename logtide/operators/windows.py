"""Per-service event-time windows.

The heavy step is one hash aggregation of the raw rows into cells: (service, window,
latency value, env) with counts. All aggregate buffers are fixed-width, so it runs as a
code-generated hash aggregate with map-side combine, and a service that holds a third of
all rows is spread over its latency values. Cells merge by addition, which is what the
roll-up to longer windows does; percentiles are exact on merged cells as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions.levels import is_error
from logtide.functions.scalars import daily_index, iso_utc, message_key
from logtide.operators.chunks import running_max_before
from logtide.operators.parse import known_services
from logtide.settings import RECORD_TYPE, WindowSettings

PERCENTILES = (50, 95, 99)


def window_start(ts: Column, size: int) -> Column:
    """Start of the tumbling window that holds `ts`; windows are aligned to the epoch."""
    width = size * 1_000_000
    us = F.unix_micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(width)))


def window_end(start: Column, size: int) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + size * 1_000_000)


def rate(part: Column, total: Column) -> Column:
    return F.when(total > 0, part.cast("double") / total).otherwise(F.lit(0.0))


def window_counts(logs: DataFrame, size: int = 60, keys: tuple[str, ...] = ("service",),
                  time_col: str = "event_time") -> DataFrame:
    """Volume, error and warning counts and rates per key and window."""
    counts = (
        logs.groupBy(*keys, window_start(F.col(time_col), size).alias("window_start"))
        .agg(F.count("*").alias("request_volume"),
             F.count_if(is_error(F.col("level"))).alias("error_count"),
             F.count_if(F.col("level") == "WARNING").alias("warn_count"))
    )
    return counts.withColumns({
        "error_rate": rate(F.col("error_count"), F.col("request_volume")),
        "warn_rate": rate(F.col("warn_count"), F.col("request_volume")),
    })


def window_cells(logs: DataFrame, size: int = 60, time_col: str = "event_time",
                 said: Column | None = None) -> DataFrame:
    """Mergeable partial state of the windows, one row per latency value and env.

    With `said`, the text of an error or null, cells are kept apart by it as well, in `said`.
    """
    more = [] if said is None else [said.alias("said")]
    return (
        logs.groupBy("service", window_start(F.col(time_col), size).alias("window_start"),
                     "latency_ms", "env", *more)
        .agg(F.count("*").alias("n"),
             F.count_if(is_error(F.col("level"))).alias("errors"),
             F.count_if(F.col("level") == "WARNING").alias("warnings"),
             F.min(time_col).alias("first_time"))
    )


def merge_cells(cells: DataFrame, size: int) -> DataFrame:
    """Add up cells of shorter windows into windows of `size` seconds."""
    return (
        cells.groupBy("service", window_start(F.col("window_start"), size).alias("window_start"),
                      "latency_ms", "env")
        .agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"),
             F.sum("warnings").alias("warnings"), F.min("first_time").alias("first_time"))
    )


def summarise_cells(cells: DataFrame, size: int, top: int = 0) -> DataFrame:
    """Window aggregates from cells: counts, rates, nearest-rank percentiles, average, env.

    With `top`, also `top_errors`: that many texts of `said` with their counts, ranked before
    they are gathered.

    The percentile p of n samples is the sample of rank ceil(p/100 * n). The average is the
    integer quotient of the sum and the number of samples. The env is the earliest
    non-empty one.
    """
    w = Window.partitionBy("service", "window_start")
    ordered = w.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    samples = F.when(F.col("latency_ms").isNotNull(), F.col("n")).otherwise(F.lit(0))
    ranked = (
        cells.withColumn("_samples", samples)
        .withColumn("_cum", F.sum("_samples").over(ordered))
        .withColumn("_total", F.sum("_samples").over(w))
    )

    def nearest_rank(p: int) -> Column:
        rank = F.ceil(F.lit(p / 100.0) * F.col("_total"))
        reached = F.col("latency_ms").isNotNull() & (F.col("_cum") >= rank)
        return F.min(F.when(reached, F.col("latency_ms"))).alias(f"p{p}_latency_ms")

    tops = []
    if top:
        has_text = F.col("said").isNotNull()
        ranked = ranked.withColumn("_times", F.sum("n").over(Window.partitionBy("service", "window_start", "said")))
        place = F.dense_rank().over(w.orderBy(~has_text, F.desc("_times"), "said"))
        ranked = ranked.withColumn("_place", place)
        listed = F.collect_set(F.when(has_text & (F.col("_place") <= top), F.struct("_place", "said", "_times")))
        tops = [F.transform(F.array_sort(listed), lambda x: F.struct(
            x["said"].alias("message"), x["_times"].alias("count"))).alias("top_errors")]

    has_env = F.col("env") != ""
    grouped = ranked.groupBy("service", "window_start").agg(
        F.sum("n").alias("request_volume"),
        F.sum("errors").alias("error_count"),
        F.sum("warnings").alias("warn_count"),
        F.sum("_samples").alias("latency_count"),
        F.sum(F.col("latency_ms") * F.col("n")).alias("latency_sum"),
        *[nearest_rank(p) for p in PERCENTILES],
        F.coalesce(F.min(F.when(has_env, F.struct("first_time", "env")))["env"],
                   F.lit("")).alias("env"),
        *tops,
    )
    return grouped.withColumns({
        "window_end": window_end(F.col("window_start"), size),
        "error_rate": rate(F.col("error_count"), F.col("request_volume")),
        "warn_rate": rate(F.col("warn_count"), F.col("request_volume")),
        "avg_latency_ms": F.when(F.col("latency_count") > 0,
                                 F.expr("latency_sum div latency_count")),
    })


def top_errors(logs: DataFrame, size: int = 60, k: int = 5, chars: int = 200,
               time_col: str = "event_time") -> DataFrame:
    """The k most frequent error messages per (service, window), as rows with a rank."""
    counted = (
        logs.filter(is_error(F.col("level")))
        .select("service", window_start(F.col(time_col), size).alias("window_start"),
                message_key(F.col("message"), chars).alias("message"))
        .filter(F.col("message").isNotNull())
        .groupBy("service", "window_start", "message").agg(F.count("*").alias("count"))
    )
    order = Window.partitionBy("service", "window_start").orderBy(F.desc("count"), "message")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def service_windows(logs: DataFrame, settings: WindowSettings = WindowSettings(),
                    time_col: str = "event_time") -> DataFrame:
    """Complete window aggregate per service, unknown services left out."""
    # One pass over the logs: the texts of errors are a part of the cells.
    said = F.when(is_error(F.col("level")), message_key(F.col("message"), settings.message_chars))
    cells = window_cells(known_services(logs), settings.size, time_col, said)
    return summarise_cells(cells, settings.size, settings.top_errors)


def window_records(windows: DataFrame) -> DataFrame:
    """Window aggregates in the layout of the outgoing JSON record."""
    return windows.select(
        F.lit(RECORD_TYPE).alias("recordType"),
        "service", "env",
        F.unix_millis("window_start").alias("windowStartMs"),
        F.unix_millis("window_end").alias("windowEndMs"),
        iso_utc(F.col("window_start")).alias("windowStart"),
        iso_utc(F.col("window_end")).alias("windowEnd"),
        F.col("request_volume").alias("requestVolume"),
        F.col("error_rate").alias("errorRate"),
        F.col("warn_rate").alias("warnRate"),
        F.col("error_count").alias("errorCount"),
        F.col("warn_count").alias("warnCount"),
        F.col("p99_latency_ms").alias("p99LatencyMs"),
        F.col("p95_latency_ms").alias("p95LatencyMs"),
        F.col("p50_latency_ms").alias("p50LatencyMs"),
        F.col("avg_latency_ms").alias("avgLatencyMs"),
        F.col("top_errors").alias("topErrors"),
    )


def document_keys(windows: DataFrame) -> DataFrame:
    """Add the document id and the daily index of each window aggregate."""
    return windows.withColumns({
        "doc_id": F.concat_ws("-", "service", F.unix_millis("window_start")),
        "index_name": daily_index("logs-aggregates-", F.col("window_start")),
        "index_date": F.to_date("window_start"),
    })


def latency_reservoir(logs: DataFrame, order_key: Column, size: int = 60, cap: int = 10_000,
                      time_col: str = "event_time") -> DataFrame:
    """Repeatable uniform sample of at most `cap` latency rows per (service, window).

    `order_key` is a hash of the event identity. This is the opt-in bounded mode; the
    window aggregates themselves use every row.
    """
    w = Window.partitionBy("service", "window_start").orderBy("_order")
    return (
        logs.filter(F.col("latency_ms").isNotNull())
        .withColumn("window_start", window_start(F.col(time_col), size))
        .withColumn("_order", order_key)
        .withColumn("sample_rank", F.row_number().over(w))
        .filter(F.col("sample_rank") <= cap)
        .drop("_order")
    )


def mark_late(arrivals: DataFrame, order: str, settings: WindowSettings = WindowSettings(),
              time_col: str = "event_time", chunk_rows: int = 1_000_000) -> DataFrame:
    """Add `is_late`: the row's window had closed for good before the row arrived.

    The watermark before a row is the largest event time that arrived earlier, minus the
    out-of-orderness. A window stays open for the allowed lateness after its end.
    """
    us = F.unix_micros(F.col(time_col))
    staged = running_max_before(
        arrivals, [], [order], F.floor(F.col(order) / chunk_rows), us, "_max_us")
    end_us = F.unix_micros(window_end(window_start(F.col(time_col), settings.size), settings.size))
    late = (end_us + settings.allowed_lateness * 1_000_000
            <= F.col("_max_us") - settings.out_of_orderness * 1_000_000)
    return staged.withColumn("is_late", F.coalesce(late, F.lit(False))).drop("_max_us")


def features(windows: DataFrame, time_col: str = "window_end") -> DataFrame:
    """Feature vector of each window: five doubles, missing values as 0.0."""
    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name)

    return windows.select(
        "service", F.col(time_col).alias("ts"),
        number("error_rate"), number("p99_latency_ms"), number("avg_latency_ms"),
        number("request_volume"), number("warn_rate"))


def record_features(records: DataFrame) -> DataFrame:
    """Feature vectors from decoded window records."""
    def number(source: str, name: str) -> Column:
        return F.coalesce(F.col(source).cast("double"), F.lit(0.0)).alias(name)

    return records.select(
        "service", F.timestamp_millis("windowEndMs").alias("ts"),
        number("errorRate", "error_rate"),
        number("p99LatencyMs", "p99_latency_ms"),
        number("avgLatencyMs", "avg_latency_ms"),
        number("requestVolume", "request_volume"),
        number("warnRate", "warn_rate"))

"""Streaming jobs.

State lives in the RocksDB state store under the checkpoint location. Writes are keyed
upserts or partitions named by the batch id, so a restarted batch gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.functions.levels import is_error
from logtide.functions.scalars import message_key
from logtide.operators.parse import (
    known_services,
    normalise,
    parse_failures,
    parse_messages,
    parsed_records,
)
from logtide.operators.windows import document_keys, rate, summarise_cells, window_end, window_start
from logtide.settings import WindowSettings
from logtide.sources.writers import dead_letters, remove, table_exists, upsert

SECOND = 1_000_000


def window_stream(logs: DataFrame, settings: WindowSettings = WindowSettings(),
                  time_col: str = "event_time") -> DataFrame:
    """Window aggregates of a log stream in one stateful aggregation.

    The watermark is the out-of-orderness plus the allowed lateness: in append mode a window
    comes out once, when it is final; in update mode it comes out again with every change.
    Percentiles count values per window, so the state grows with distinct latencies only.
    """
    latency = F.col("latency_ms")
    known = known_services(logs).withWatermark(time_col, settings.watermark)
    rank = {p: F.expr(f"percentile_disc({p / 100.0}) within group (order by latency_ms)")
            for p in (50, 95, 99)}
    counted = known.groupBy(F.window(time_col, settings.duration), "service").agg(
        F.count("*").alias("request_volume"),
        F.count_if(is_error(F.col("level"))).alias("error_count"),
        F.count_if(F.col("level") == "WARNING").alias("warn_count"),
        F.count(latency).alias("latency_count"),
        F.sum(latency).alias("latency_sum"),
        *[r.cast("bigint").alias(f"p{p}_latency_ms") for p, r in rank.items()],
        F.coalesce(F.min_by("env", F.when(F.col("env") != "", F.col(time_col))), F.lit("")).alias("env"))
    return counted.select(
        "service", "env", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "request_volume", "error_count", "warn_count",
        rate(F.col("error_count"), F.col("request_volume")).alias("error_rate"),
        rate(F.col("warn_count"), F.col("request_volume")).alias("warn_rate"),
        "p50_latency_ms", "p95_latency_ms", "p99_latency_ms",
        F.when(F.col("latency_count") > 0, F.expr("latency_sum div latency_count")).alias("avg_latency_ms"))


def cell_stream(logs: DataFrame, settings: WindowSettings = WindowSettings(), time_col: str = "event_time") -> DataFrame:
    """Cells of complete windows on a stream: counts by latency value, env and error text, as `operators.windows` has them in batch.

    The state holds distinct values with their counts, not rows, and is spread over them: a busy service is not one key.
    """
    said = F.when(is_error(F.col("level")), message_key(F.col("message"), settings.message_chars))
    known = known_services(logs).withWatermark(time_col, settings.watermark).withColumn("said", said)
    counted = known.groupBy(F.window(time_col, settings.duration), "service", "latency_ms", "env", "said").agg(
        F.count("*").alias("n"), F.count_if(is_error(F.col("level"))).alias("errors"),
        F.count_if(F.col("level") == "WARNING").alias("warnings"), F.min(time_col).alias("first_time"))
    return counted.select("service", F.col("window.start").alias("window_start"), "latency_ms", "env", "said",
                          "n", "errors", "warnings", "first_time")


CELL_KEYS = ["service", "window_start", "latency_ms", "env", "said"]


def window_batch(tables: str, settings: WindowSettings = WindowSettings(), final: bool = True) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` body: cells to complete windows with their top errors, upserted into the table `windows`.

    With `final`, a batch has all cells of the windows that the watermark has closed, and nothing else is kept. Otherwise a batch has
    the cells that changed: they are upserted into the table `cells`, and each window they touch is summed up again from there.
    """
    def body(batch: DataFrame, batch_id: int) -> None:
        if final:
            return upsert_windows(summarise_cells(batch, settings.size, settings.top_errors), batch_id, f"{tables}/windows")
        # Without this every use of the batch would load the state and fold the rows again.
        dated = batch.withColumns({"index_date": F.to_date("window_start"), "seq": F.lit(batch_id).cast("bigint")}).persist()
        try:
            upsert(dated, f"{tables}/cells", CELL_KEYS, ["seq"], "index_date")
            touched = dated.select("index_date", "service", "window_start").distinct()
            cells = batch.sparkSession.read.schema(dated.schema).parquet(f"{tables}/cells").join(
                touched, ["index_date", "service", "window_start"], "left_semi").drop("index_date", "seq")
            upsert_windows(summarise_cells(cells, settings.size, settings.top_errors), batch_id, f"{tables}/windows")
        finally:
            dated.unpersist()

    return body


def start_window_records(logs: DataFrame, tables: str, checkpoint: str, settings: WindowSettings = WindowSettings(),
                         final: bool = True, available_now: bool = False):
    """Start the stream of complete window aggregates: once when they are final, or again with every change."""
    writer = (cell_stream(logs, settings).writeStream.outputMode("append" if final else "update")
              .foreachBatch(window_batch(tables, settings, final)).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything that is available and return the written table."""
    query = (stream.writeStream.format("parquet").outputMode(mode)
             .option("path", path).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(path)


def upsert_windows(batch: DataFrame, batch_id: int, path: str) -> None:
    """`foreachBatch` body: merge updated windows into the table, newest batch wins."""
    rows = document_keys(batch).withColumn("seq", F.lit(batch_id).cast("bigint"))
    upsert(rows, path, ["service", "window_start"], ["seq"], "index_date")


def write_batch(rows: DataFrame, batch_id: int, path: str, partitions: tuple[str, ...] = ()) -> None:
    """Write the rows of a batch below partitions of its own; repeating the batch replaces them."""
    if partitions:  # one file for each partition instead of one for each task and partition
        rows = rows.hint("rebalance", *partitions).sortWithinPartitions(*partitions, "event_time")
    rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*partitions, "batch_id").parquet(path)


def high_water(batch: DataFrame, batch_id: int, path: str) -> int | None:
    """Largest event time (microseconds) of all batches before this one.

    Every batch writes the mark it leaves behind, so only the one before is read: one row.
    """
    spark, before = batch.sparkSession, f"{path}/{batch_id - 1}"
    return spark.read.schema("max_us bigint").parquet(before).first()[0] if table_exists(spark, before) else None


def write_mark(logs: DataFrame, mark: int | None, batch_id: int, path: str) -> None:
    """Mark after a batch. A repeated batch reads the same mark and leaves the same one; older ones go."""
    spark = logs.sparkSession
    latest = logs.agg(F.greatest(F.max(F.unix_micros("event_time")), F.lit(mark).cast("bigint")).alias("max_us"))
    latest.coalesce(1).write.mode("overwrite").parquet(f"{path}/{batch_id}")
    remove(spark, f"{path}/{batch_id - 2}")


def ingest_batch(tables: str, settings: WindowSettings = WindowSettings()) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` body: raw messages to logs and dead letters.

    Every event goes to `logs`, below its date and sorted by time, so that hours are pruned by the files' statistics. Messages that do not parse go to `dead_letters`, and so do
    copies of the events of known services whose window had closed before the batch. Spark drops late rows inside
    stateful operators without a trace, so they are found here, against a stored high-water mark.
    """
    def body(batch: DataFrame, batch_id: int) -> None:
        messages = parse_messages(batch).persist()
        logs = normalise(parsed_records(messages)).persist()
        try:
            mark = high_water(batch, batch_id, f"{tables}/high_water")
            dated = logs.drop("value", "key", "partition", "offset").withColumn("event_date", F.to_date("event_time"))
            write_batch(dated, batch_id, f"{tables}/logs", ("event_date",))
            letters = dead_letters(parse_failures(messages), F.col("parse_error"), F.col("value"))
            if mark is not None:
                us = F.unix_micros(window_end(window_start(F.col("event_time"), settings.size), settings.size))
                late = known_services(logs).filter(
                    us + settings.allowed_lateness * SECOND <= F.lit(mark - settings.out_of_orderness * SECOND))
                letters = letters.unionByName(dead_letters(late, F.lit("late event"), F.col("value")))
            write_batch(letters, batch_id, f"{tables}/dead_letters")
            write_mark(logs, mark, batch_id, f"{tables}/high_water")
        finally:
            logs.unpersist()
            messages.unpersist()

    return body


def start_ingest(messages: DataFrame, tables: str, checkpoint: str,
                 settings: WindowSettings = WindowSettings(), available_now: bool = False):
    """Start the ingest stream from messages in the broker layout."""
    writer = messages.writeStream.foreachBatch(ingest_batch(tables, settings)).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_windows(logs: DataFrame, path: str, checkpoint: str,
                  settings: WindowSettings = WindowSettings(), available_now: bool = False):
    """Start the window stream: every change of a window is upserted into the table at `path`."""
    writer = (
        window_stream(logs, settings).writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: upsert_windows(batch, batch_id, path))
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()

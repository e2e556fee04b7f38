"""From window features to anomaly events on a stream.

Baselines are folded per service and metric in event-time order (`streaming.ordered`), so that each micro-batch of their history is the
next slice of event time, whole over all services. Detection and suppression then work on that slice: the storm
rules, which join all services, start from the state that the batch before has left, one row in a table. Everything a batch writes
carries its id, so a repeated batch gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.operators.baseline import HISTORY_SCHEMA, baseline_machine, is_learning, long_features
from logtide.operators.chunks import same_keys
from logtide.operators.detect import tier1, verdict, z_scores
from logtide.operators.events import build_events, event_key
from logtide.operators.suppress import suppress_slice
from logtide.settings import FEATURES, BaselineSettings, DetectionSettings, SuppressionSettings
from logtide.sources.writers import remove, table_exists
from logtide.streaming.jobs import write_batch
from logtide.streaming.ordered import ordered_stream

SECOND = 1_000_000
#: One row per service with the time it was first seen, and one with the state of the storm rules.
STATE = "service string, first_us bigint, storms binary"


def history_stream(samples: DataFrame, delay: str, settings: BaselineSettings = BaselineSettings()) -> DataFrame:
    """Baseline history of a stream of (service, metric, ts, value) in event-time order; idle baselines leave the state store."""
    narrow = samples.select("service", "metric", "ts", F.unix_micros("ts").alias("ts_us"), F.col("value").cast("double").alias("value"))
    return ordered_stream(narrow, ["service", "metric"], "ts", delay, baseline_machine(settings), "ts_us", ["ts_us"],
                          settings.expiry * SECOND + 1, HISTORY_SCHEMA)


def _history_rows(batch: DataFrame) -> DataFrame:
    number = F.lit(None).cast("double")
    return batch.withColumns({"ts": F.timestamp_micros("ts_us"), "prev_ewma": F.nanvl("prev_ewma", number),
                              "prev_std": F.nanvl("prev_std", number)})


def events_batch(tables: str, baseline: BaselineSettings, detection: DetectionSettings, suppression: SuppressionSettings,
                 metrics: tuple[str, ...] = FEATURES) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` body: a slice of baseline history to events, and the state for the next slice."""
    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier, own = f"{tables}/state/{batch_id - 1}", f"{tables}/state/{batch_id}"
        before = (spark.read.schema(STATE).parquet(earlier) if table_exists(spark, earlier)
                  else spark.createDataFrame([], STATE))
        history = _history_rows(batch).persist()
        try:
            seen = (before.where(F.col("storms").isNull()).select("service", "first_us")
                    .unionByName(history.select("service", F.col("ts_us").alias("first_us")))
                    .groupBy("service").agg(F.min("first_us").alias("first_us"))).persist()
            judged = verdict(same_keys(tier1(z_scores(history), detection, metrics), seen, ["service"]).withColumns({
                "learning": is_learning(F.col("ts"), F.timestamp_micros("first_us"), baseline), "tier2_fired": F.lit(False)}), detection)
            found = judged.where("is_anomaly").withColumn("event_id", event_key(F.col("service"), F.col("ts"))).persist()
            entry = before.where(F.col("storms").isNotNull()).first()
            decisions, storms = suppress_slice(found, entry.storms if entry else None, suppression)
            decided = found.join(decisions.drop("service", "ts"), "event_id").withColumn(
                "top_log_samples", F.expr("cast(array() as array<struct<message:string,count:bigint>>)"))
            write_batch(build_events(decided), batch_id, f"{tables}/events")
            left = seen.withColumn("storms", F.lit(None).cast("binary"))
            if storms is not None:
                left = left.unionByName(spark.createDataFrame([(None, None, bytearray(storms))], STATE))
            left.write.mode("overwrite").parquet(own)
            remove(spark, f"{tables}/state/{batch_id - 2}")
            found.unpersist()
            seen.unpersist()
        finally:
            history.unpersist()

    return body


def start_events(features: DataFrame, tables: str, checkpoint: str, delay: str = "60 seconds",
                 baseline: BaselineSettings = BaselineSettings(), detection: DetectionSettings = DetectionSettings(),
                 suppression: SuppressionSettings = SuppressionSettings(), metrics: tuple[str, ...] = FEATURES,
                 available_now: bool = False):
    """Start the chain from a stream of window features (service, ts, metrics) to the table `events` below `tables`.

    Features may come up to `delay` behind the newest one. An event is written once the watermark has passed its window.
    """
    writer = history_stream(long_features(features, metrics), delay, baseline).writeStream.outputMode("append").foreachBatch(
        events_batch(tables, baseline, detection, suppression, metrics)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

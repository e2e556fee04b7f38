"""Writers: JSON messages, keyed upserts, hourly archives, dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File size limits of the two archives, in records.
ARCHIVE_RECORDS = {"raw-logs": 100_000, "processed-logs": 50_000}
ARCHIVE_PARTITIONS = ["year", "month", "day", "hour"]


def json_messages(df: DataFrame, key: Column | None = None, type_name: str = "record") -> DataFrame:
    """Rows to (key, value) messages; a row that cannot be written becomes an error record."""
    failed = F.to_json(F.struct(F.lit("serialisation_failed").alias("_error"), F.lit(type_name).alias("type")))
    value = F.coalesce(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), failed)
    return df.select((key if key is not None else F.lit(None).cast("string")).alias("key"),
                     value.alias("value"))


def event_messages(events: DataFrame) -> DataFrame:
    """Events keyed by service, so that one service stays in order in one partition."""
    return json_messages(events, F.col("service"), "AnomalyEvent")


def write_kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str):
    """Start an at-least-once stream into a topic."""
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers).option("topic", topic)
        .option("kafka.acks", "all").option("kafka.compression.type", "lz4")
        .option("checkpointLocation", checkpoint).start()
    )


def latest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last writer wins: the row with the largest `order` per key, of equals the one whose JSON text is the largest."""
    by_key = Window.partitionBy(*keys)
    newest = df.withColumn("_rank", F.rank().over(by_key.orderBy(*[F.desc(o) for o in order]))).filter(F.col("_rank") == 1).drop("_rank")
    # Only equals are written as JSON.
    text = F.when(F.col("_equals") > 1, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    marked = newest.withColumn("_equals", F.count("*").over(by_key)).withColumn("_text", text)
    return (marked.withColumn("_rank", F.row_number().over(by_key.orderBy(F.desc("_text")))).filter(F.col("_rank") == 1)
            .drop("_rank", "_equals", "_text"))


def upsert(batch: DataFrame, path: str, keys: list[str], order: list[str], partition: str) -> None:
    """Merge rows into a Parquet table by key; only the touched partitions are rewritten.

    The partition must be a function of the key. Rewriting is idempotent: the same batch
    twice gives the same table. The batch is computed once, though it is used twice.
    """
    spark = batch.sparkSession
    if not table_exists(spark, path):
        return _write_latest(batch, path, keys, order, partition)
    batch = batch.persist()
    try:
        touched = batch.select(partition).distinct()
        current = spark.read.schema(batch.schema).parquet(path)
        _write_latest(current.join(touched, partition, "left_semi").unionByName(batch), path, keys, order, partition)
    finally:
        batch.unpersist()


def _write_latest(merged: DataFrame, path: str, keys: list[str], order: list[str], partition: str) -> None:
    (
        latest_rows(merged, keys, order).hint("rebalance", partition)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition).parquet(path)
    )


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder if it is there."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop_path))


def archive_rows(messages: DataFrame, at: Column, value: str = "value") -> DataFrame:
    """Message text with its hourly partition columns."""
    return messages.select(
        F.col(value).alias("value"),
        F.date_format(at, "yyyy").alias("year"), F.date_format(at, "MM").alias("month"),
        F.date_format(at, "dd").alias("day"), F.date_format(at, "HH").alias("hour"))


def write_archive(messages: DataFrame, path: str, at: Column, records: int = 100_000,
                  mode: str = "append") -> None:
    """Gzip text files below year=/month=/day=/hour=, at most `records` lines each.

    Rebalancing by hour avoids one small file per task and hour; adaptive execution splits
    an hour that is much larger than the others.
    """
    (
        archive_rows(messages, at).hint("rebalance", *ARCHIVE_PARTITIONS)
        .write.mode(mode).partitionBy(*ARCHIVE_PARTITIONS)
        .option("compression", "gzip").option("maxRecordsPerFile", records).text(path)
    )


def archive_batch(path: str, at: Column, records: int = 100_000) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` body: the archive of `write_archive` with a folder for the batch below each hour.

    A batch that is repeated writes the same folders and replaces them.
    """
    def body(batch: DataFrame, batch_id: int) -> None:
        parts = [*ARCHIVE_PARTITIONS, "batch"]
        (archive_rows(batch, at).withColumn("batch", F.lit(batch_id)).hint("rebalance", *ARCHIVE_PARTITIONS)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts)
         .option("compression", "gzip").option("maxRecordsPerFile", records).text(path))

    return body


def start_archive(messages: DataFrame, path: str, checkpoint: str, at: Column, records: int = 100_000, available_now: bool = False):
    """Start the archive stream of messages in the broker layout: every message once, below its hour."""
    writer = messages.writeStream.foreachBatch(archive_batch(path, at, records)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# Where a message stood in the source; with these a dead letter can be replayed.
COORDINATES = {"key": "string", "partition": "int", "offset": "bigint", "timestamp": "timestamp"}


def dead_letters(df: DataFrame, reason: Column, value: Column) -> DataFrame:
    """Rows in the layout of the dead-letter output; coordinates that `df` lacks are null."""
    place = [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in COORDINATES.items()]
    return df.select(reason.alias("reason"), value.alias("value"), *place)

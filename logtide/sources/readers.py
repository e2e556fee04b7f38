"""Readers for log files, broker topics and the service registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtide.schema import ANOMALY_EVENT, MESSAGE, OWNER, WINDOW_RECORD
from logtide.settings import RECORD_TYPE
from logtide.sources.writers import dead_letters

# Offset policies of the three consumers.
STARTING_OFFSETS = {"raw-logs": "earliest", "anomaly-events": "earliest", "processed-logs": "latest"}


def kafka_options(servers: str, topic: str, max_offsets: int | None = None,
                  fail_on_data_loss: bool = True) -> dict[str, str]:
    """Options of the Kafka source; the checkpoint keeps the committed offsets.

    Offsets that the broker no longer has stop the stream unless the caller accepts the loss.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": STARTING_OFFSETS.get(topic, "earliest"),
        "kafka.isolation.level": "read_committed",
        "kafka.metadata.max.age.ms": "60000",
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def read_kafka(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """Streaming messages of a topic with text key and value."""
    raw = spark.readStream.format("kafka").options(**kafka_options(servers, topic, max_offsets)).load()
    return raw.select(
        F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset", "timestamp")


def read_message_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Streaming messages from Parquet files in the broker layout."""
    reader = spark.readStream.schema(MESSAGE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def json_lines(df: DataFrame) -> DataFrame:
    """Text lines to documents: (source_file, value, doc, log).

    A line that is not a JSON object keeps its text under `log` and has no document.
    """
    doc = F.try_parse_json("value")
    return df.withColumn("doc", F.when(F.col("value").rlike(r"^\s*\{"), doc)).withColumn(
        "log", F.when(F.col("doc").isNull(), F.col("value")))


def read_json_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    lines = reader.format("text").load(path)
    return json_lines(lines.select("value", F.col("_metadata.file_path").alias("source_file")))


def read_plain_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their line number: (source_file, line_no, line).

    A large file is read in several blocks. Lines are counted per block, and each block
    starts at the sum of the counts before it, so no file has to go through one task.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
        F.col("value").alias("line"))
    inside = Window.partitionBy("source_file", "_block").orderBy("_seq")
    before = (Window.partitionBy("source_file").orderBy("_block")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = (
        lines.groupBy("source_file", "_block").agg(F.count("*").alias("_n"))
        .withColumn("_carry", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    return (
        lines.withColumn("_local", F.row_number().over(inside) - 1)
        .join(carry, ["source_file", "_block"])
        .select("source_file", (F.col("_local") + F.col("_carry")).alias("line_no"), "line")
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Service registry (service, owner) from one JSON object; no rows when the file is missing."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return spark.createDataFrame([], f"service string, owner {OWNER.simpleString()}")
    # A configuration document of a few kilobytes.
    return registry_rows(spark.read.text(path, wholetext=True))


def registry_rows(document: DataFrame, value: str = "value") -> DataFrame:
    entries = F.from_json(F.col(value), f"map<string,{OWNER.simpleString()}>")
    return document.select(F.explode(entries).alias("service", "owner"))


def decode_window_records(messages: DataFrame, value: str = "value") -> DataFrame:
    """Window aggregates of a mixed topic; other record types are left out."""
    kind = F.get_json_object(F.col(value), "$.recordType")
    return (messages.filter(kind == RECORD_TYPE)
            .select(F.from_json(value, WINDOW_RECORD).alias("r")).select("r.*"))


def _event(value: str):
    return F.from_json(value, ANOMALY_EVENT)


def decode_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """Anomaly events; the messages of `undecodable_events` are left out."""
    return messages.select(_event(value).alias("e")).filter(F.col("e.event_id").isNotNull()).select("e.*")


def undecodable_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """Messages that hold no anomaly event, as dead letters with their place in the source."""
    failed = messages.withColumn("_e", _event(value)).filter(F.col("_e.event_id").isNull())
    reason = (F.when(F.col(value).isNull() | (F.col(value) == ""), "empty message")
              .when(F.try_parse_json(value).isNull(), "malformed json").otherwise("no event id"))
    return dead_letters(failed, reason, F.col(value))

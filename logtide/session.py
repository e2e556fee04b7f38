"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Applied only where the caller has not chosen a value. Nothing here depends on the
# size of the cluster: adaptive execution picks the reduce-side parallelism.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    STATE_STORE: ROCKSDB,
}


def build_session(app_name: str = "logtide", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the library defaults; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Scratch folders that this process has asked for, oldest first.
_SCRATCH: list[str] = []


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB state store; sessions built elsewhere may not have it."""
    spark.conf.set(STATE_STORE, ROCKSDB)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared checkpoint location of the session.

    A cluster names that location in `spark.checkpoint.dir`. A machine-local folder is
    used only when the setting is missing and the master is local.
    """
    context = spark.sparkContext
    base = (spark.conf.get("spark.checkpoint.dir", None)
            or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir())
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = os.path.join(tempfile.gettempdir(), "logtide-scratch")
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders of this process and return how many there were.

    Results are lazy and read their intermediates when they are used, so this is for the caller, once everything that
    was derived from them has been written or collected.
    """
    paths = [_SCRATCH.pop() for _ in range(len(_SCRATCH))]
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result once to the shared scratch folder and read it back.

    For results that several later steps use: they then read a small table that survives
    lost executors, instead of each computing it again from the raw rows.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

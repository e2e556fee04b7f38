"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, under fixed names: other columns cannot clash with its own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each value, None for null, without going through `str`."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py()


#: Rows of an Arrow batch. Texts are long: the default of 10,000 would put tens of megabytes into each copy of a batch.
BATCH_ROWS, DEFAULT_ROWS = "4000", "10000"
#: Bytes of a batch that goes to Python, wherever Spark's own bound of 64 MB holds: each task keeps several copies of one outside the heap.
BATCH_BYTES, DEFAULT_BYTES = str(8 << 20), str(64 << 20)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless the caller has chosen a size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == DEFAULT_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("bB") == DEFAULT_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]],
                schema: str | StructType, done: Callable[[], None] | None = None) -> DataFrame:
    """`mapInArrow` with one call per batch; nothing is kept from one batch to the next.

    At the end of a partition `done` is called, and the worker gives the memory of its batches back.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch)
        if done is not None:
            done()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def mix64(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (finaliser of SplitMix64), in wrapping arithmetic."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class BoundedTable(dict):
    """Results of `fill` by key, computed on demand and kept in two generations of `size` entries at most.

    When the young one is full it becomes the old one; what is asked for again comes back from there.
    """

    def __init__(self, fill: Callable, size: int):
        super().__init__()
        self.fill, self.size, self.old = fill, size, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.fill(key)
        if len(self) >= self.size:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value

    def keep(self, key, value) -> None:
        """Put a value that the caller has computed."""
        if len(self) >= self.size:
            self.shrink()
        self[key] = value

    def shrink(self) -> None:
        """Start a new generation if the young one is full."""
        if len(self) >= self.size:
            self.old = self.copy()
            self.clear()

    def forget(self) -> None:
        self.clear()
        self.old = {}


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result that later steps read more than once to the shared folder of the session.

    Lost executors then cost no recomputation of what came before.
    """
    from logtide.session import materialise

    return materialise(df, f"llm-{purpose}")

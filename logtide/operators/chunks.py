"""Ordered running values without putting a whole key into one task.

A running value over a long ordered key is taken in two steps: inside fixed-width chunks
of the order column (one window task per chunk), and over one summary row per chunk. The
chunk carry is then added to every row. The summary has `range / width` rows per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join rows with a summary that has one row for each of their keys; null is a key like any other."""
    renamed = right.withColumnsRenamed({k: f"_same_{n}" for n, k in enumerate(keys)})
    match = None
    for n, k in enumerate(keys):
        test = left[k].eqNullSafe(renamed[f"_same_{n}"])
        match = test if match is None else match & test
    return left.join(renamed, match).drop(*[f"_same_{n}" for n in range(len(keys))])


def running_max_before(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                       value: Column, out: str) -> DataFrame:
    """Largest `value` (any ordered type) among the rows before each row; null for the first."""
    staged = df.withColumn("_chunk", chunk).withColumn("_value", value)
    inside = (Window.partitionBy(*keys, "_chunk").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    across = (Window.partitionBy(*keys).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = (staged.groupBy(*keys, "_chunk").agg(F.max("_value").alias("_chunk_max"))
             .withColumn("_carry", F.max("_chunk_max").over(across)).drop("_chunk_max"))
    local = staged.withColumn("_local", F.max("_value").over(inside))
    joined = same_keys(local, carry, [*keys, "_chunk"])
    return joined.withColumn(
        out, F.greatest(F.col("_local"), F.col("_carry"))
    ).drop("_chunk", "_value", "_local", "_carry")


def running_count(df: DataFrame, keys: list[str], order: list[Column | str], chunk: Column,
                  counted: Column, out: str) -> DataFrame:
    """Number of rows with `counted` true up to and including each row."""
    staged = df.withColumn("_chunk", chunk).withColumn("_one", counted.cast("bigint"))
    inside = (Window.partitionBy(*keys, "_chunk").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    across = (Window.partitionBy(*keys).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = (staged.groupBy(*keys, "_chunk").agg(F.sum("_one").alias("_n"))
             .withColumn("_carry", F.coalesce(F.sum("_n").over(across), F.lit(0))).drop("_n"))
    local = staged.withColumn("_local", F.sum("_one").over(inside))
    return (same_keys(local, carry, [*keys, "_chunk"])
            .withColumn(out, F.col("_local") + F.col("_carry"))
            .drop("_chunk", "_one", "_local", "_carry"))


def quiet_islands(df: DataFrame, keys: list[str], time_us: str, gap_us: int,
                  out: str = "island") -> DataFrame:
    """Number the stretches of activity of each key that are separated by silence.

    Two rows of different islands are at least `gap_us` apart. Only the distinct
    (key, bucket) pairs are ordered per key, never the rows: a bucket that is empty
    between two busy ones proves a gap of at least one bucket width.
    """
    bucket = F.floor(F.col(time_us) / F.lit(gap_us)).cast("bigint")
    staged = df.withColumn("_bucket", bucket)
    w = Window.partitionBy(*keys).orderBy("_bucket")
    starts = (
        staged.select(*keys, "_bucket").distinct()
        .withColumn("_before", F.lag("_bucket").over(w))
        .withColumn("_start", (F.col("_before").isNull()
                               | (F.col("_bucket") - F.col("_before") > 1)).cast("bigint"))
        .withColumn(out, F.sum("_start").over(w)).drop("_start", "_before")
    )
    return same_keys(staged, starts, [*keys, "_bucket"]).drop("_bucket")

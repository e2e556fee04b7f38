"""Operator 6: shards of nearly equal size by sampled splitters.

A size-weighted sample of the record keys gives quantile boundaries of many more ranges than there are shards; records
are dealt to the ranges, and ranges that turn out overfull are sampled again and subdivided. Exact sizes of the ranges
then give every record's position in the order of the keys, in bytes and in rows: a running sum within its range plus
what lies before the range. Shards are equal parts of that order, so they differ by less than one record, whatever the
sample was; the sample only decides how evenly the work is spread. No key is too hot: records of one key are ordered
further by checksum, size and a number of their own, and boundaries can fall between them.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logtide.llm.common import map_batches, stored

SHARDS = 24
#: Bytes a record has beside its text.
OVERHEAD = 8
#: Ranges: at least so many for each shard; beyond that one for so many bytes; and never more than can be listed.
RANGES_PER_SHARD, RANGE_BYTES, MOST_RANGES = 8, 1 << 30, 16_384
#: Sampled keys for each range, and rounds of subdividing.
SAMPLES_PER_RANGE, ROUNDS = 24, 4
OVERFULL = 2.0

KEY = ["doc_id", "crc", "size", "tie"]


def record_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, crc, tie): what the order of the records needs, once for each row; `tie` makes keys unique."""
    text = F.col(text_col).cast("string")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
                        F.coalesce(F.crc32(text), F.lit(0)).alias("crc"))
    return stored(sized.withColumn("tie", F.monotonically_increasing_id()), "sizes")


def _sample(rows: DataFrame, n: int) -> list[tuple]:
    """`n` keys, drawn without replacement with weights by size: the smallest arrivals of exponential clocks.

    The number drawn for a record is a hash of its key, so a repeated task draws the same.
    """
    uniform = (F.xxhash64(*KEY).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    drawn = rows.select(*KEY, (-F.log(uniform) / F.col("size")).alias("arrival")).orderBy("arrival", *KEY).limit(n)
    return sorted(_comparable(tuple(r[k] for k in KEY)) for r in drawn.collect())  # `n` rows at most


def _comparable(key: tuple) -> tuple:
    """Null ids come first."""
    return (key[0] is not None, key[0] or 0, *key[1:])


def _quantiles(keys: list[tuple], parts: int) -> list[tuple]:
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def _in_ranges(rows: DataFrame, bounds: list[tuple]) -> DataFrame:
    """`rows` with the number of the range of each: how many bounds are at or before its key."""
    ids = np.array([b[1] if b[0] else np.iinfo(np.int64).min for b in bounds], np.int64)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc_id = batch.column("doc_id")
        own = doc_id.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        place, last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        for i in np.flatnonzero(place != last):  # a bound has the same id: the rest of the key decides
            place[i] = bisect_right(bounds, _comparable(tuple(batch.column(k)[int(i)].as_py() for k in KEY)))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), pa.array(place.astype(np.int32))], [*KEY, "range"])

    return map_batches(rows.select(*KEY), work, "doc_id long, crc long, size long, tie long, range int")


def _contents(ranged: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each range, `MOST_RANGES` and a few more at most."""
    return {r["range"]: (r["bytes"], r["rows"])
            for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, crc, shard, slot): `slot` numbers the records of a shard from 0 without gaps, in order of the keys.

    Sizes of the shards differ by less than the largest record. A null text has no bytes; null ids come first; repeated
    rows are records of their own. With fewer records than shards some shards are empty.
    """
    rows = record_sizes(docs, id_col, text_col)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = min(MOST_RANGES, max(shards * RANGES_PER_SHARD, math.ceil(total / RANGE_BYTES)))
    bounds = _quantiles(_sample(rows, ranges * SAMPLES_PER_RANGE), ranges)
    ranged = stored(_in_ranges(rows, bounds), "ranges")
    held = _contents(ranged)
    for _ in range(ROUNDS):
        target = max(1, total // ranges)
        overfull = {k: b for k, (b, n) in held.items() if b > OVERFULL * target and n > 1}
        if not overfull or len(bounds) >= MOST_RANGES:
            break
        parts = {k: math.ceil(b / target) for k, b in overfull.items()}
        within = ranged.where(F.col("range").isin(list(overfull)))
        found: dict[int, list[tuple]] = {k: [] for k in overfull}
        for key in _sample(within, SAMPLES_PER_RANGE * sum(parts.values())):
            found[bisect_right(bounds, key)].append(key)
        more = {b for k, keys in found.items() for b in _quantiles(keys, parts[k])} - set(bounds)
        if not more:
            break
        bounds = sorted({*bounds, *more})
        ranged = stored(_in_ranges(rows, bounds), "ranges")
        held = _contents(ranged)

    before, bytes_so_far, rows_so_far = [], 0, 0
    for k in range(len(bounds) + 1):
        own_bytes, own_rows = held.get(k, (0, 0))
        before.append((k, bytes_so_far, rows_so_far))
        bytes_so_far, rows_so_far = bytes_so_far + own_bytes, rows_so_far + own_rows
    offsets = docs.sparkSession.createDataFrame(before, "range int, bytes_before long, rows_before long")
    order = Window.partitionBy("range").orderBy(*KEY)
    placed = (ranged.join(F.broadcast(offsets), "range")  # one row for each range, at most MOST_RANGES and a few
              .withColumn("at", F.col("bytes_before") + F.sum("size").over(order) - F.col("size"))
              .withColumn("row", F.col("rows_before") + F.row_number().over(order) - 1)
              .withColumn("shard", F.least(F.floor(F.col("at") * shards / F.lit(max(total, 1))).cast("int"), F.lit(shards - 1))))
    placed = stored(placed.select("doc_id", "size", "crc", "tie", "shard", "row"), "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return (placed.join(F.broadcast(first), "shard")  # one row for each shard
            .select("doc_id", "size", "crc", "shard", (F.col("row") - F.col("first")).alias("slot")))


def shard_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): sizes are nearly equal, so a new shard moves everything."""
    return assign_shards(docs).select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                                      "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the documents with all their columns, one folder for each shard."""
    same = ["doc_id", "crc", "size"]
    number = Window.partitionBy(*same).orderBy("slot_order")
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("document"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.crc32(text), F.lit(0)).alias("crc"),
                       (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.lit(0).alias("slot_order"))
    rows = rows.withColumn("copy", F.row_number().over(number))  # equal records: any of them takes any of their places
    places = assign_shards(docs, shards).withColumn("slot_order", F.col("shard") * F.lit(1 << 40) + F.col("slot"))
    places = places.withColumn("copy", F.row_number().over(number))
    keys = [rows[k].eqNullSafe(places[k]) for k in (*same, "copy")]
    (rows.join(places, keys).select("document.*", F.col("shard").alias("_shard"))
     .write.partitionBy("_shard").parquet(path))

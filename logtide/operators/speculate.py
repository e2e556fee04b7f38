"""Ordered folds of keys that never fall silent, in parallel.

A fold is a state machine over the rows of a key in time order. A key is first cut at silences that no state
survives; the islands between them are independent. An island with many rows is cut again, into chunks of
consecutive time buckets. All chunks are folded at once, each from an assumed entry state: none at first, afterwards the exit
state of the chunk before it. Only chunks whose entry differs from the one they were folded with are folded
again, until none does; what is left then is the serial fold, chunk for chunk. States of this kind forget, so chunks soon agree
whatever they started from. A machine that keeps its phase for ever would need one round per chunk; after a few rounds the
rest of such an island is folded in one go from its first open chunk, so that no row is folded more than `rounds` + 2 times.

Rows are stored once, and chunks have a head row with their entry state and a tail row with their exit state: states stay in
tables, a row per chunk, and a fold holds one state and one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from logtide.operators.chunks import same_keys
from logtide.operators.ordered import Arrays, _Columns, ordered_fold, stretches
from logtide.session import materialise

#: Rows from which an island is cut, and rounds before the rest of an island is folded serially.
CHUNK_ROWS, ROUNDS = 200_000, 6


@dataclass
class Machine:
    """A state machine: `step` reads rows and changes the state; `dump` gives equal bytes for states with an equal future."""

    new_state: Callable[[], object]
    step: Callable[[object, Arrays], Arrays]
    dump: Callable[[object], bytes]
    load: Callable[[bytes], object]


@dataclass
class Rounds:
    """What a fold did: chunks of all islands, rounds after the first, chunks folded again, rows folded serially in the end."""

    chunks: int = 0
    rounds: int = 0
    refolded: int = 0
    serial: bool = False


def chunk_number(n: Column, island: list[str], rows: int) -> Column:
    """Number of the chunk of a time bucket with `n` rows: about `rows` rows lie in each."""
    before = Window.partitionBy(*island).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return F.floor(F.coalesce(F.sum(n).over(before), F.lit(0)) / F.lit(rows)).cast("bigint")


def cut_islands(counts: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """(keys, _bucket, _island, _chunk) from (keys, _bucket, _n): islands between empty buckets, and chunks of about `rows` rows."""
    w = Window.partitionBy(*keys).orderBy("_bucket")
    joined = F.lag("_bucket").over(w) == F.col("_bucket") - 1
    return (counts.withColumn("_island", (~F.coalesce(joined, F.lit(False))).cast("bigint"))
            .withColumn("_island", F.sum("_island").over(w))
            .withColumn("_chunk", chunk_number(F.col("_n"), [*keys, "_island"], rows))
            .select(*keys, "_bucket", "_island", "_chunk"))


def _match(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Semi or anti join in which null is a key like any other."""
    renamed = right.select(*[F.col(n).alias(f"_r{i}") for i, n in enumerate(names)])
    test = left[names[0]].eqNullSafe(renamed["_r0"])
    for i, n in enumerate(names[1:], 1):
        test &= left[n].eqNullSafe(renamed[f"_r{i}"])
    return left.join(renamed, test, how)


def fold_units(rows: DataFrame, unit: list[str], order: list[str], heads: DataFrame | None, machine: Machine, schema: StructType) -> DataFrame:
    """Fold each unit from the state in its head row, or from a new one; adds `_exit`, which only the tail rows of units have."""
    staged = rows.withColumn("_entry", F.lit(None).cast("binary"))
    if heads is not None:
        staged = staged.unionByName(heads, allowMissingColumns=True)
    arranged = staged.repartition(*unit).sortWithinPartitions(*unit, F.col("_entry").isNull(), *order)
    wide = StructType([StructField(f.name, f.dataType) for f in schema] + [StructField("_exit", BinaryType())])
    wanted, given = to_arrow_schema(wide), set(rows.columns)

    def tails(done: list[tuple[tuple, bytes]]) -> pa.RecordBatch:
        values = {name: [key[i] for key, _ in done] for i, name in enumerate(unit)}
        values["_exit"] = [left for _, left in done]
        return pa.RecordBatch.from_arrays(
            [pa.array(values.get(f.name, [None] * len(done)), f.type) for f in wanted], schema=wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        state: object = None
        for batch in batches:
            if not batch.num_rows:
                continue
            entries = batch.column("_entry")
            heads_at = entries.is_valid().to_numpy(zero_copy_only=False)
            parts: list[Arrays] = []
            done: list[tuple[tuple, bytes]] = []
            for lo, hi in stretches(batch, unit):
                key = tuple(batch.column(k)[lo].as_py() for k in unit)
                if key != current:
                    if current is not None:
                        done.append((current, machine.dump(state)))
                    current, state = key, machine.load(entries[lo].as_py()) if heads_at[lo] else machine.new_state()
                lo += int(heads_at[lo])
                if lo < hi:
                    parts.append(machine.step(state, _Columns(batch.slice(lo, hi - lo))))
            if parts:
                own = batch.filter(pa.array(~heads_at))
                out = []
                for field in wanted:
                    if field.name == "_exit":
                        out.append(pa.nulls(own.num_rows, pa.binary()))
                    elif field.name in given:
                        out.append(own.column(field.name).cast(field.type))
                    else:
                        values = np.concatenate([p[field.name] for p in parts])
                        out.append(pa.array(values.tolist() if values.dtype == object else values, field.type))
                yield pa.RecordBatch.from_arrays(out, schema=wanted)
            if done:
                yield tails(done)
        if current is not None:
            yield tails([(current, machine.dump(state))])

    return arranged.mapInArrow(run, wide)


def speculative_fold(df: DataFrame, keys: list[str], time_us: str, order: list[str], gap_us: int, machine: Machine,
                     schema: StructType, chunk_rows: int = CHUNK_ROWS, rounds: int = ROUNDS, report: Rounds | None = None) -> DataFrame:
    """Fold every key of `df` in `order`; no state outlives a silence of `gap_us` in `time_us`.

    Columns of `schema` that `df` has are handed through, the others are what the steps return; keys may be null, or none.
    Returns the columns of `schema`, in which the keys must be.
    """
    bucketed = df.withColumn("_bucket", F.floor(F.col(time_us) / F.lit(gap_us)).cast("bigint"))
    cut = cut_islands(bucketed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")), keys, chunk_rows)
    return fold_cut(same_keys(bucketed, cut, [*keys, "_bucket"]).drop("_bucket"), cut, keys, order, machine, schema, rounds, report)


def fold_cut(rows: DataFrame, cut: DataFrame, keys: list[str], order: list[str], machine: Machine, schema: StructType,
             rounds: int = ROUNDS, report: Rounds | None = None) -> DataFrame:
    """`speculative_fold` of rows that have their `_island` and `_chunk`, by `cut` (keys, _island, _chunk)."""
    names = schema.names
    if not cut.agg(F.max("_chunk")).first()[0]:  # nothing to split: one fold, computed when it is used
        return ordered_fold(rows, [*keys, "_island"], order, machine.new_state, machine.step, schema).select(*names)
    report = report if report is not None else Rounds()
    island, unit = [*keys, "_island"], [*keys, "_island", "_chunk"]
    inner = StructType([*schema.fields, *[StructField(n, LongType()) for n in ("_island", "_chunk") if n not in names]])
    rows = materialise(rows, "fold-rows")
    before = F.lag("_chunk").over(Window.partitionBy(*island).orderBy("_chunk"))
    chunks = materialise(cut.select(*unit).distinct().withColumn("_before", before), "fold-chunks")
    report.chunks = chunks.count()

    def exits(folded: DataFrame, name: str) -> DataFrame:
        return folded.where(F.col("_exit").isNotNull()).select(*unit, F.col("_exit").alias(name))

    versions = [(materialise(fold_units(rows, unit, order, None, machine, inner), "fold-first"), None)]
    states = materialise(same_keys(chunks, exits(versions[0][0], "_left"), unit)
                         .withColumn("_used", F.lit(machine.dump(machine.new_state()))), "fold-states")
    while True:
        ends = states.select(*island, F.col("_chunk").alias("_before"), F.col("_left").alias("_entry"))
        open_ = materialise(same_keys(states.where(F.col("_before").isNotNull()), ends, [*island, "_before"])
                            .where(F.col("_entry") != F.col("_used")).select(*unit, "_entry"), "fold-open")
        many = open_.count()
        if not many:
            break
        report.refolded += many
        if report.rounds == rounds:
            report.serial = True
            first = open_.groupBy(*island).agg(F.min_by("_entry", "_chunk").alias("_entry"), F.min("_chunk").alias("_from"))
            rest = same_keys(rows, first.drop("_entry"), island).where(F.col("_chunk") >= F.col("_from")).drop("_from")
            again = materialise(fold_units(rest, island, order, first.drop("_from"), machine, inner), "fold-rest")
            versions.append((again, same_keys(chunks, first.select(*island, "_from"), island)
                             .where(F.col("_chunk") >= F.col("_from")).select(*unit)))
            break
        report.rounds += 1
        again = materialise(fold_units(_match(rows, open_, unit, "left_semi"), unit, order, open_, machine, inner), "fold-again")
        versions.append((again, open_.select(*unit)))
        renewed = same_keys(open_, exits(again, "_left"), unit).withColumnRenamed("_entry", "_used")
        states = materialise(_match(states, open_, unit, "left_anti").unionByName(
            same_keys(chunks, renewed, unit).select(*states.columns)), "fold-states")

    result = None
    for i, (folded, _) in enumerate(versions):  # of each chunk, what its last fold said
        last = folded.where(F.col("_exit").isNull())
        for _, replaced in versions[i + 1:]:
            last = _match(last, replaced, unit, "left_anti")
        result = last.select(*names) if result is None else result.unionByName(last.select(*names))
    return result

"""Operator 5: near-duplicates by SimHash, with candidates from the pigeonring principle.

The 64 bits of a fingerprint are `threshold + 1` segments in a ring. If two fingerprints differ in at most `threshold`
bits, then from some segment on every chain of l segments differs in at most l * threshold / (threshold + 1) bits: the
first in none, the first two in at most one, and so on. The join therefore is on the first segment and all values of
the second with at most one bit changed; longer chains and the full distance are checked on what it finds. One side
lists the changed values, the other side only itself, so a pair is met once for each start of a viable chain.

Equal fingerprints are one node, whatever the number of their documents; documents are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from logtide.llm.common import id_and_text, map_batches, stored, text_bytes
from logtide.llm.components import connected_components

BITS, SHINGLE, THRESHOLD, SEED = 64, 3, 3, 42
#: Shingles whose bits are counted at a time.
BLOCK = 50_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text as an unsigned number; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]
    return majority_bits(np.array(hashes, "<u8"))


def majority_bits(values: np.ndarray) -> int:
    """SimHash of 64-bit hashes (little-endian): the bits that more than half of them have set."""
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, len(values), BLOCK):
        block = values[at:at + BLOCK]
        set_in += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_batches(id_and_text(docs), work, "doc_id long, fp long")


def _masks(threshold: int) -> list[int]:
    """Bits of each segment of the ring."""
    n = threshold + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _chain_holds(difference: Column, start: int, masks: list[int], threshold: int) -> Column:
    """Every chain of segments from `start` keeps within its share of the threshold."""
    held, mask = F.lit(True), 0
    for length in range(1, len(masks) + 1):
        mask |= masks[(start + length - 1) % len(masks)]
        held = held & (F.bit_count(difference.bitwiseAND(F.lit(_signed(mask)))) <= length * threshold // len(masks))
    return held


def close_pairs(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): all pairs of different fingerprints of `nodes` (fp) that differ in at most `threshold` bits (1 to 7)."""
    masks = _masks(threshold)
    probes, targets = [], []
    for i in range(len(masks)):
        second = masks[(i + 1) % len(masks)]
        own = F.col("fp").bitwiseAND(F.lit(_signed(masks[i] | second)))
        flips = [0] + [1 << b for b in range(BITS) if second >> b & 1]
        key = lambda value, i=i: F.struct(F.lit(i).alias("start"), value.alias("key"))
        targets.append(key(own))
        probes += [key(own.bitwiseXOR(F.lit(_signed(flip)))) for flip in flips]
    left = nodes.select(F.col("fp").alias("a"), F.explode(F.array(*probes)).alias("k")).select("a", "k.start", "k.key")
    right = nodes.select(F.col("fp").alias("b"), F.explode(F.array(*targets)).alias("k")).select("b", "k.start", "k.key")
    difference = F.col("a").bitwiseXOR(F.col("b"))
    viable = F.coalesce(*[F.when(F.col("start") == i, _chain_holds(difference, i, masks, threshold)) for i in range(len(masks))])
    return (left.join(right, ["start", "key"]).where(F.col("a") < F.col("b"))
            .where(viable).where(F.bit_count(difference) <= threshold).select("a", "b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id that can be reached over fingerprints at most `threshold` apart.

    A null or empty text has fingerprint zero and is linked like any other. Null ids and repeated rows take part; a
    group in which every id is null has a null component. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, shingle), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = connected_components(close_pairs(nodes.select("fp"), threshold))
    rooted = (nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "first", F.coalesce("component", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), the fingerprint as 16 hexadecimal digits."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns: the one with the smallest id.

    `groups` has (doc_id, component_id) of every row, by default those of `near_duplicates`.

    Rows that repeat an id count as one document: the row with the smallest hash of the text stays. Rows without an id
    are kept only if no row of their group has one, and then one of equal texts stays.
    """
    groups = near_duplicates(docs) if groups is None else groups
    first = groups.where("doc_id = component_id OR component_id IS NULL").select("doc_id").distinct()
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("version"))
    kept = rows.join(first.select(F.col("doc_id").alias("first_id")), F.col("id").eqNullSafe(F.col("first_id")), "left_semi")
    # the join has dealt the rows by id already, so the ranking moves nothing
    by_id = Window.partitionBy("id", F.when(F.col("id").isNull(), F.col("version"))).orderBy("version")
    return kept.withColumn("place", F.row_number().over(by_id)).where("place = 1").select("row.*")

"""Near-duplicates of the pipeline: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are found by SimHash with the pigeonring of operator 5: fingerprints of the same shingles, linked by chains of segments
at 4 or fewer differing bits. Sets of similarity 0.8 differ in about 10 of 64 bits, where the segments have five bits
each and nearly every document meets every other, so a second search takes the rest: sets that share all minima of one band of a
MinHash signature. Its 32 bands of 5 hashes miss a pair of similarity 0.8 with probability (1 - 0.8^5)^32 = 3e-6, and closer
pairs more rarely still. Every candidate pair of either search is then decided on the shingles themselves.

Equal sets are one node. A bucket has the nodes of one band key, or of a fingerprint and those close to it. In each bucket the nodes are first compared with one that a hash draws, so
that a node meets different ones in its buckets. Buckets that these pairs leave in several components do not list their
other pairs: the members are alike, but most not enough. Buckets that share members are a group, and each set A of a group is written as what
sets it apart, D(A): the difference from the group's centre C, the shingles that more than half of its sets have. For any C the
difference of A and B is that of D(A) and D(B), so with n and d elements in A and D(A) two sets are similar if and only if

    s(A) + s(B) <= 18 |D(A) n D(B)|,        s(A) = 9 d - n.

Pairs whose sum is not positive are similar without a look, and hang together through the set of least s. All others must have as many
differences in common as the sum says; they meet on the rarest of these, by an exact prefix filter with classes of s.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from logtide.llm.common import map_batches, mix64, stored, text_bytes
from logtide.llm.components import connected_components
from logtide.llm.simhash import SEED, close_pairs, keep_one_of_each, majority_bits

SHINGLE, BANDS, ROWS = 5, 32, 5
#: The similarity, 4 / 5, as two whole numbers: decided without rounding.
SHARED, OF = 4, 5
#: Differing bits of the fingerprints that the pigeonring looks for; its joins are on 25 bits, with five they would be on 21.
CLOSE_BITS = 4
#: Nodes of a group that share a copy of its centre; classes of nodes by the differences they need in common.
GROUP_PART, CLASSES = 50, 16
#: Shingles that are hashed for the signature at a time.
BLOCK = 2_000
#: Rows of shingles that leave Python at a time.
LISTED = 100_000
_FACTORS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer than five words are one shingle, no words are none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    found = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        found = mix64(found ^ hashed[i:len(words) - size + 1 + i])
    return np.unique(found)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band, from the minima of its hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        np.minimum(least, (_FACTORS[:, None] * shingles[None, at:at + BLOCK]).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mix64(keys ^ column)
    return keys


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, version, node, n, fp, keys): hash, size and SimHash of the set of shingles, keys of the bands; none without words."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nodes, sizes, prints, keys = [], [], [], []
        for text in text_bytes(batch.column("text")):
            found = shingle_set(text)
            nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
            sizes.append(len(found))
            prints.append(majority_bits(found))
            keys.append(band_keys(found).view(np.int64) if len(found) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("version"), pa.array(np.array(nodes, np.uint64).view(np.int64)),
             pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "version", "node", "n", "fp", "keys"])

    return map_batches(_texts(docs), work, "doc_id long, version long, node long, n long, fp long, keys array<long>")


def close_nodes(nodes: DataFrame, threshold: int = CLOSE_BITS) -> DataFrame:
    """(node, n, key): for each fingerprint of `nodes` (node, n, fp) a bucket of its nodes and those of larger, close ones."""
    worded = nodes.where("n > 0").select("node", "n", "fp")
    pairs = stored(close_pairs(worded.select("fp").distinct(), threshold).distinct(), "jaccard-close")
    close = pairs.join(worded, pairs["b"] == worded["fp"]).select("node", "n", F.col("a").alias("fp"))
    return worded.unionByName(close).select("node", "n", F.xxhash64(F.lit("simhash"), "fp").alias("key"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles): the sets of the nodes of `wanted` (node, at_id, at_version), as bytes."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [shingle_set(t).tobytes() for t in text_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "shingles"])

    texts = _texts(docs)
    rows = texts.join(wanted, (texts["version"].eqNullSafe(wanted["at_version"])) & texts["doc_id"].eqNullSafe(wanted["at_id"]))
    return map_batches(rows.select("node", "text"), work, "node long, shingles binary").dropDuplicates(["node"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(OF * both >= SHARED * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return map_batches(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), work, "a long, b long")


def _sizes_allow(a: str, b: str):
    return F.least(a, b) * OF >= F.greatest(a, b) * SHARED


def similar_pairs(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes (node, n, fp, keys, at_id, at_version) that link all nodes of a group of similar ones."""
    banded = nodes.select("node", "n", F.explode("keys").alias("key")).unionByName(close_nodes(nodes))
    drawn = F.struct(F.xxhash64("key", "node"), "node", "n")
    shared = (banded.groupBy("key").agg(F.min(drawn).alias("head"), F.count("*").alias("many"))
              .where("many > 1").select("key", F.col("head.node").alias("head"), F.col("head.n").alias("head_n")))
    buckets = stored(banded.join(shared, "key"), "jaccard-buckets")
    wanted = buckets.select("node").distinct().join(nodes.select("node", "at_id", "at_version"), "node")
    sets = stored(_sets(docs, wanted), "jaccard-sets")
    first = buckets.where("node <> head").where(_sizes_allow("n", "head_n")).select(F.col("head").alias("a"), F.col("node").alias("b"))
    linked = stored(_similar(first.distinct(), sets), "jaccard-pairs")

    placed = (buckets.join(connected_components(linked), "node", "left")
              .select("key", "node", "n", "head", F.coalesce("component", "node").alias("part")))
    open_keys = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    rest = stored(placed.where("node <> head").join(open_keys, "key", "left_semi").select("key", "node", "n", "part"), "jaccard-open")
    # A chain of links through each bucket: its members are one group, with those of the buckets they share.
    hub = rest.groupBy("key").agg(F.min("node").alias("hub"))
    links = rest.join(hub, "key").select(F.col("hub").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    groups = (rest.select("node", "n", "part").distinct().join(connected_components(stored(links, "jaccard-group-links")), "node")
              .withColumnRenamed("component", "group"))
    return linked.unionByName(_similar(pairs_by_differences(stored(groups, "jaccard-groups"), sets), sets))


def differences(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, group, shingle, holders): D of each node of `nodes` (node, n, part, group), and how many of the group have it in theirs."""
    def listed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = [len(x.as_buffer()) // 8 for x in batch.column("shingles")]
        at = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        shingles = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")] or [np.zeros(0, np.int64)])
        for lo in range(0, len(shingles), LISTED):
            part = at.slice(lo, LISTED)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(part) for c in ("node", "group", "many")), pa.array(shingles[lo:lo + LISTED])],
                                             ["node", "group", "many", "shingle"])

    many = nodes.groupBy("group").agg(F.count("*").alias("many"))
    counted = nodes.join(many, "group").select("node", "group", "many")
    rows = stored(map_batches(counted.join(sets, "node"), listed, "node long, group long, many long, shingle long"), "jaccard-shingles")
    held = rows.groupBy("group", "shingle").agg(F.count("*").alias("held"), F.first("many").alias("many"))
    more = rows.join(held.where("2 * held <= many").select("group", "shingle", F.col("held").alias("holders")), ["group", "shingle"])
    # What a node lacks of the centre: a large group takes its centre in several copies, one for about GROUP_PART nodes.
    parts = F.ceil(F.col("many") / GROUP_PART).cast("int")
    centre = held.where("2 * held > many AND held < many").select(
        "group", "shingle", (F.col("many") - F.col("held")).alias("holders"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("copy"))
    spread = counted.select("node", "group", F.pmod(F.xxhash64("node"), parts).cast("int").alias("copy"))
    lacking = spread.join(centre, ["group", "copy"]).join(rows.select("node", "shingle"), ["node", "shingle"], "left_anti")
    names = ["node", "group", "shingle", "holders"]
    return more.select(*names).unionByName(lacking.select(*names))


def pairs_by_differences(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes (node, n, part, group) of a group and different parts; they and `part` link all similar ones."""
    apart = stored(differences(nodes, sets), "jaccard-differences")
    sizes = apart.groupBy("node").agg(F.count("*").alias("d"), F.count_if(F.col("holders") > 1).alias("common"))
    scored = nodes.join(sizes, "node", "left").select(
        "node", "n", "part", "group", F.coalesce("common", F.lit(0)).alias("common"), (F.coalesce("d", F.lit(0)) * (SHARED + OF) - F.col("n")).alias("s"))
    least = scored.groupBy("group").agg(F.min(F.struct("s", "node", "part")).alias("least"))
    scored = stored(scored.join(least, "group"), "jaccard-scored")
    sure = scored.where("least.node <> node AND least.part <> part AND least.s + s <= 0").select(
        F.least("node", "least.node").alias("a"), F.greatest("node", "least.node").alias("b"))

    # Others need at least one difference in common, and some partner for which theirs are enough.
    weight = 2 * (SHARED + OF)
    able = scored.where(F.col("common") * weight >= F.greatest(F.col("s") + F.col("least.s"), F.lit(1)))
    # Classes of s are as wide as a tenth or so of what differences can make up for in the group.
    width = able.groupBy("group").agg((F.greatest(F.lit(2), F.ceil(F.max("common") / CLASSES)) * weight).alias("width"))
    first = Window.partitionBy("node").orderBy("holders", "shingle")
    placed = (apart.where("holders > 1").withColumn("at", F.row_number().over(first) - 1).select("node", "shingle", "at")
              .join(able.select("node", "n", "part", "group", "common", "s"), "node").join(width, "group"))
    own = F.floor(F.col("s") / F.col("width"))
    low, high = F.floor((1 - F.col("s")) / F.col("width")), F.floor((F.col("common") * weight - F.col("s")) / F.col("width"))
    met = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(low, high)))
    needed = F.ceil(F.greatest(F.lit(1), F.col("s") + F.col("other") * F.col("width")) / weight)
    met = stored(met.where(F.col("at") <= F.col("common") - needed)
                 .select("node", "n", "part", "group", "shingle", "own", "other", "s", "common"), "jaccard-rare")

    def side(x: str, mine: str, its: str) -> DataFrame:
        return met.where(f"{mine} <= {its}").select("group", "shingle", F.col(mine).alias("low"), F.col(its).alias("high"),
                                                    *[F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "part", "s", "common")])

    both = side("x", "own", "other").join(side("y", "other", "own"), ["group", "shingle", "low", "high"]).where(
        F.expr("x_part <> y_part") & _sizes_allow("x_n", "y_n") & (F.col("x_s") + F.col("y_s") <= F.least("x_common", "y_common") * weight))
    found = both.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
    return found.unionByName(sure).distinct()


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, node, component_id): the smallest id that can be reached over pairs of similar documents.

    Texts without words are one group. Null ids and repeated rows take part; a group in which every id is null has a
    null component. An empty table gives an empty result.
    """
    marks = stored(signatures(docs), "jaccard")
    nodes = stored(marks.groupBy("node").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "version")).alias("at"),
                                             F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
                   .select("node", "first", F.col("at.doc_id").alias("at_id"), F.col("at.version").alias("at_version"), "n", "fp", "keys"),
                   "jaccard-nodes")
    groups = connected_components(similar_pairs(docs, nodes))
    rooted = nodes.join(groups, "node", "left").select("node", "first", F.coalesce("component", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(smallest, "root").select("node", "component_id")
    return marks.join(classes, "node").select("doc_id", "node", "component_id")


def keep_one_of_similar(docs: DataFrame) -> DataFrame:
    """One document of each group of similar ones, by the rules of `keep_one_of_each`."""
    return keep_one_of_each(docs, similar_documents(docs))

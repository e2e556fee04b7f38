"""Operator 3: exact removal of repeated byte strings by distributed prefix doubling.

A position is named by the string that starts at it; a round names longer strings by the pair of the name so far and the
name of what comes after it, sorts the pairs, gives equal pairs the same rank and drops what is unique. Ranks are only
compared for equality here, so a 64-bit hash serves as a name, and sorting brings equal pairs together.

Most positions are settled by one representative. Of the 32-byte strings in a window of `LENGTH` bytes the one with the
smallest hash is its anchor, which depends on nothing but the window. Successive windows mostly have the same anchor and
form a run; equal windows have equal anchors at equal places in them. So the rounds are:

1. up to 32 bytes, within a text: the name of every 32-byte string, and of whole runs (`LENGTH` to `LENGTH` + 68 bytes);
2. Spark sorts the pairs (anchor, run). An anchor that occurs once is unique: none of its windows repeats. Of equal pairs
   the first stays, in all others every window repeats. Runs that share an anchor with a different run go on;
3. 66 bytes: every window has 34 more bytes of its own before or after the anchor, so a run falls into windows that all
   have the 66 bytes up to the end of the anchor and windows that all have the 66 from its start. Spark sorts the pairs
   (66 bytes, part of the run) and decides as before;
4. of the parts that go on, Spark sorts the pairs (name of the first half, name of the second) of every window. The
   threshold is reached: all but the first of equal pairs repeat.

Every window is decided in one of the rounds, and all are compared on the input. About one run in 35 bytes is shuffled
once; windows are listed only for the parts of the last round. Texts are shuffled once, compressed, and all rounds that
need them read that shuffle. Before each sort, equal pairs of a batch are reduced to the first, and runs under frequent
anchors are spread by the name of the run, so a string that very many documents share stays small in every task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from logtide.llm.common import map_batches, mix64, stored, text_bytes

LENGTH, ANCHOR = 100, 32
#: Bytes worked on at a time; longer texts are cut into overlapping pieces.
PIECE = 1 << 20
#: Documents sampled for frequent anchors, and the share of them that makes an anchor frequent. This decides only where
#: rows are sorted, not what is found.
SAMPLED_DOCS, FREQUENT = 20_000, 0.001
MOST_FREQUENT = 10_000

BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each byte value, powers of the inverse, powers of the base)."""
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    size = PIECE + 8 * 1024

    def powers(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return values, powers(INVERSE), powers(BASE)


class Piece:
    """Names of the substrings of some bytes."""

    def __init__(self, raw: bytes):
        values, inverse, self.powers = _tables()
        data = np.frombuffer(raw, np.uint8)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * inverse[:len(data)], out=self.sums[1:])

    def names(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.powers[start])

    def all_names(self, length: int) -> np.ndarray:
        """Of every substring of one length, mixed less thoroughly: for choosing, not for comparing."""
        n = len(self.sums) - length
        x = (self.sums[length:] - self.sums[:n]) * self.powers[:n]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x


def pieces(texts: Sequence[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, offset, bytes) of about `PIECE` bytes; every window lies in exactly one piece."""
    group, size = [], 0
    for i, raw in enumerate(texts):
        for at in range(0, max(len(raw) - length + 1, 0), PIECE):
            part = raw[at:at + PIECE + length - 1]
            if size + len(part) > PIECE and group:
                yield group
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
    if group:
        yield group


def runs(group: list[tuple[int, int, bytes]], length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, place of the anchor, its name, name of the run) of every run of a group."""
    sizes = np.array([len(p[2]) for p in group])
    ends = np.cumsum(sizes)
    joined = Piece(b"".join(p[2] for p in group))
    width = length - anchor + 1
    keys = joined.all_names(anchor)
    keys &= np.uint64(0xFFFFFFFFFF000000 & (1 << 64) - 1)
    keys |= np.arange(len(keys), dtype=np.uint64)  # equal names: the leftmost
    least, reach = keys, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[:len(least) - (width - reach)], least[width - reach:])
    valid = np.ones(len(least), bool)
    for end in ends[:-1].tolist():
        valid[end - length + 1:end] = False
    at = np.flatnonzero(valid)
    chosen = (least[at] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start, chosen = at[first], chosen[first]
    piece = np.searchsorted(ends, start, "right")
    text = np.array([p[0] for p in group])[piece]
    offset = (np.array([p[1] for p in group]) - (ends - sizes))[piece]
    return (text, start + offset, count, chosen - start, joined.names(chosen, chosen + anchor),
            joined.names(start, start + count + length - 1))


def _order(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of a batch (id, version, ...) in order of id and version, nulls first."""
    ids, versions = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    return np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, versions[i])), np.int64)


def _in_order(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    """Order of the rows of a batch (id, version, text) and their texts."""
    order, texts = _order(batch), list(text_bytes(batch.column(2)))
    return order, [texts[i] or b"" for i in order]


def _firsts(*names: np.ndarray) -> np.ndarray:
    """True for the first of equal rows of names, in the order given."""
    key = names[0].copy()
    for other in names[1:]:
        key = mix64(key) ^ other
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    for name in names:
        same[1:] &= name[order][1:] == name[order][:-1]
    out = np.ones(len(key), bool)
    out[order] = ~same
    return out


RUN = "anchor long, name long, id long, version long, at long"
RUN_NAMES = [c.split()[0] for c in RUN.split(", ")]
#: `at` of a run: first window, number of windows, place of the anchor in the first window, and two flags.
COUNT_AT, PLACE_AT, FIELD = 13, 2, (1 << 11) - 1
FREQUENT_FLAG, SETTLED_FLAG = 2, 1


def _packed(start: np.ndarray, count: np.ndarray, place: np.ndarray, frequent: np.ndarray, settled: np.ndarray) -> np.ndarray:
    return start << 24 | count << COUNT_AT | place << PLACE_AT | frequent * FREQUENT_FLAG | settled


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return at >> 24, at >> COUNT_AT & FIELD, at >> PLACE_AT & FIELD, (at & FREQUENT_FLAG) > 0


def _run_batches(batch: pa.RecordBatch, row: np.ndarray, anchor: np.ndarray, name: np.ndarray, start: np.ndarray,
                 count: np.ndarray, place: np.ndarray, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of `RUN`, in order of document and position. What repeats in the batch is settled and dealt anywhere."""
    settled = ~_firsts(anchor, name)
    anywhere = mix64(anchor ^ np.arange(len(anchor), dtype=np.uint64) ^ mix64(start.astype(np.uint64)))
    anchor = np.where(settled, anywhere, np.where(frequent, anchor ^ mix64(name >> np.uint64(40)), anchor))
    at = _packed(start, count, place, frequent, settled)
    for i in range(0, len(row), 100_000):
        part = slice(i, i + 100_000)
        own = pa.array(row[part])
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[part].view(np.int64)), pa.array(name[part].view(np.int64)), batch.column(0).take(own),
             batch.column(1).take(own), pa.array(at[part])], RUN_NAMES)


def _all_runs(rows: DataFrame, frequent: np.ndarray, length: int, anchor: int) -> DataFrame:
    """All runs of all texts (id, version, text)."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        order, texts = _in_order(batch)
        found = [runs(group, length, anchor) for group in pieces(texts, length)]
        if found:
            text, start, count, place, gram, name = (np.concatenate(c) for c in zip(*found))
            yield from _run_batches(batch, order[text], gram, name, start, count, place, np.isin(gram, frequent))

    return map_batches(rows, work, RUN)


def _parts(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """The two parts of the runs in `open`, named by the bytes that all windows of a part have, and by all its bytes."""
    more = (length - anchor) // 2  # of length - anchor bytes around the anchor, one side has so many

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = []
        for i, raw, packed in _opened(batch):
            start, count, place, frequent = _unpacked(packed)
            at = start + place
            last = start + count - 1
            cut_at = at - more  # windows that start here or before have `more` bytes before the anchor
            for first, stop, low, high in ((start, np.minimum(last, cut_at), at - more, at + anchor),
                                           (np.maximum(start, cut_at + 1), last, at, at + anchor + (length - anchor - more))):
                some = first <= stop
                if some.any():
                    first, stop, low, high = (x[some] for x in (first, stop, low, high))
                    spans = ((low, high), (first, stop + length))
                    found.append((np.full(len(first), i), *_names(raw, spans, length * 3), first, stop - first + 1, at[some] - first, frequent[some]))
        if found:
            row, center, name, first, count, place, frequent = (np.concatenate(c) for c in zip(*found))
            yield from _run_batches(batch, row, center, name, first, count, place, frequent)

    return map_batches(rows, work, RUN)


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(row, text, runs) of the rows of a batch (id, version, packed, n_bytes, open) that have open runs, in order."""
    codec, listed = pa.Codec("zstd"), batch.column(4)
    for i in _order(batch).tolist():
        own = listed[i].values
        if own is not None and len(own):
            raw = codec.decompress(batch.column(2)[i].as_py(), decompressed_size=batch.column(3)[i].as_py(), asbytes=True)
            yield i, raw, np.unique(own.to_numpy(zero_copy_only=False))


def _names(raw: bytes, spans: Sequence[tuple[np.ndarray, np.ndarray]], reach: int) -> list[np.ndarray]:
    """Names of the substrings [low, high) of a text; substrings of one row lie within `reach` bytes."""
    least = np.minimum.reduce([low for low, _ in spans])
    out = [np.zeros(len(least), np.uint64) for _ in spans]
    for base in range(0, len(raw), PIECE):
        own = np.flatnonzero((least >= base) & (least < base + PIECE))
        if len(own):
            piece = Piece(raw[base:base + PIECE + reach])
            for names, (low, high) in zip(out, spans):
                names[own] = piece.names(low[own] - base, high[own] - base)
    return out


def _frequent_anchors(rows: DataFrame, length: int, anchor: int) -> np.ndarray:
    """Names of anchors that a sample of the documents has often, `MOST_FREQUENT` at most."""
    total = rows.count()
    share = min(1.0, SAMPLED_DOCS / max(total, 1))
    often = max(8, int(FREQUENT * min(total, SAMPLED_DOCS)))
    sampled = _all_runs(rows.sample(share, seed=7), np.zeros(0, np.uint64), length, anchor)
    found = (sampled.where(F.col("at").bitwiseAND(F.lit(SETTLED_FLAG)) == 0).groupBy("anchor").agg(F.count("*").alias("n"))
             .where(F.col("n") >= often).orderBy(F.desc("n"), "anchor"))
    return np.array([r["anchor"] for r in found.limit(MOST_FREQUENT).collect()], np.int64).view(np.uint64)


def _decided(found: DataFrame) -> DataFrame:
    """(id, version, at, repeats) of the runs that are not unique: those that repeat an earlier one, and those to go on."""
    order = Window.partitionBy("anchor").orderBy("name", "id", "version", "at")
    run = F.struct("id", "version", "at")
    ranked = (found.withColumn("before", F.lag("name").over(order)).withColumn("lead_name", F.first("name").over(order))
              .withColumn("lead_run", F.first(run).over(order)))
    second = (F.col("name") != F.col("before")) & (F.col("before") == F.col("lead_name"))
    settled = F.col("at").bitwiseAND(F.lit(SETTLED_FLAG)) != 0
    alone = F.col("at").bitwiseAND(F.lit(FREQUENT_FLAG)) != 0  # other runs of a frequent anchor are elsewhere: go on
    own, lead = (F.struct(r.alias("run"), F.lit(False).alias("repeats")) for r in (run, F.col("lead_run")))
    marks = (F.when(settled | (F.col("name") == F.col("before")), F.array(F.struct(run.alias("run"), F.lit(True).alias("repeats"))))
             .when(alone, F.array(own)).when(second, F.array(own, lead)).when(F.col("before").isNotNull(), F.array(own)))
    return ranked.where(marks.isNotNull()).select(F.explode(marks).alias("m")).select("m.run.*", "m.repeats")


WINDOWS = "first_half long, second_half long, id long, version long, at long"


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """The windows of the runs in `open` of each row, with the names of their halves; `at` holds the start and a flag."""
    half = length // 2
    names = [c.split()[0] for c in WINDOWS.split(", ")]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = []
        for i, raw, packed in _opened(batch):
            first, count, _, _ = _unpacked(packed)
            start = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found.append((np.full(len(start), i), start, *_names(raw, ((start, start + half), (start + half, start + length)), length)))
        if not found:
            return
        row, start, one, two = (np.concatenate(x) for x in zip(*found))
        settled = ~_firsts(one, two)
        one = np.where(settled, mix64(one ^ np.arange(len(one), dtype=np.uint64) ^ mix64(start.astype(np.uint64))), one)
        for at in range(0, len(start), 100_000):
            part = slice(at, at + 100_000)
            own = pa.array(row[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(one[part].view(np.int64)), pa.array(two[part].view(np.int64)), batch.column(0).take(own),
                 batch.column(1).take(own), pa.array(start[part] << 1 | settled[part])], names)

    return map_batches(rows, work, WINDOWS)


PACKED = "id long, version long, packed binary, n_bytes long"


def _pack(rows: DataFrame) -> DataFrame:
    """Texts as compressed bytes: they are shuffled by id and kept until the last round has read them."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for at in range(0, batch.num_rows, 2_000):
            part = batch.slice(at, 2_000)
            raw = [t or b"" for t in text_bytes(part.column(2))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([codec.compress(t, asbytes=True) for t in raw], pa.binary()),
                 pa.array(list(map(len, raw)), pa.int64())], ["id", "version", "packed", "n_bytes"])

    return map_batches(rows, work, PACKED)


def _unpack(batch: pa.RecordBatch) -> Iterator[bytes]:
    codec = pa.Codec("zstd")
    for packed, size in zip(batch.column(2), batch.column(3).to_pylist()):
        yield codec.decompress(packed.as_py(), decompressed_size=size, asbytes=True) if size else b""


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges covered by the ranges [start, stop), in order; ranges that touch are one."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def cut(raw: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[bytes, int]:
    """(bytes outside the ranges, number of ranges); ranges are apart and in order."""
    kept, at = [], 0
    for a, b in zip(start.tolist(), stop.tolist()):
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept), len(start)


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, packed, n_bytes, spans): every row with the byte ranges [start, stop) that repeat; null for none.

    `version` is a checksum of the text, and 0 throughout if every id occurs once.
    """
    if not 2 * ANCHOR <= length <= FIELD:
        raise ValueError(f"length must be between {2 * ANCHOR} and {FIELD}")
    ids, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    unique = docs.groupBy(ids.alias("id")).agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0
    version = F.lit(0).cast("long") if unique else F.coalesce(F.crc32(text), F.lit(0))
    rows = docs.select(ids.alias("id"), version.alias("version"), text.alias("text"))
    frequent = _frequent_anchors(rows, length, ANCHOR)
    marks = stored(_decided(_all_runs(rows, frequent, length, ANCHOR)), "suffix-runs")
    packed = _pack(rows)

    # plain keys instead of a null-safe comparison: what is gathered by them lies where the join needs it
    keys = [F.coalesce("id", F.lit(0)).alias("key"), F.col("id").isNull().alias("no_id"), F.col("version")]
    names = ["key", "no_id", "version"]
    keyed = packed.select("id", "packed", "n_bytes", *keys)

    def with_rows(found: DataFrame, value: str | Column, out: str) -> DataFrame:
        lists = found.groupBy(*keys).agg(F.collect_list(value).alias(out))
        return keyed.join(lists, names, "left").select("id", "version", "packed", "n_bytes", out)

    def opened(found: DataFrame) -> DataFrame:
        return with_rows(found.where("NOT repeats"), "at", "open")

    parts = _decided(_parts(opened(marks), length, ANCHOR))
    rank = F.row_number().over(Window.partitionBy("first_half", "second_half").orderBy("id", "version", "at"))
    start = F.shiftright("at", 1)
    late = (_windows(opened(parts), length).withColumn("rank", rank).where("at % 2 = 1 OR rank > 1")
            .select("id", "version", start.alias("start"), (start + length).alias("stop")))
    first = F.shiftright("at", 24)
    count = F.shiftright("at", COUNT_AT).bitwiseAND(F.lit(FIELD))
    whole = marks.unionByName(parts).where("repeats").select("id", "version", first.alias("start"), (first + count + (length - 1)).alias("stop"))
    return with_rows(whole.unionByName(late), F.struct("start", "stop"), "spans")


def suffix_dedup_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256).

    A null text is empty. Null ids come before all others. Rows with equal id and text count as one document and get the
    same result; different texts under one id are ordered by checksum. An empty table gives an empty result.
    """
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        lists = batch.column(4)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        every = lists.flatten()
        start, stop = (every.field(k).to_numpy(zero_copy_only=False) for k in range(2))
        for i, raw in enumerate(_unpack(batch)):
            a, b = ends[i], ends[i + 1]
            kept, n = cut(raw, *merged(start[a:b], stop[a:b])) if a < b else (raw, 0)
            out.append((len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = repeated_spans(docs, length).select("id", "version", "packed", "n_bytes", "spans")
    return map_batches(found, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

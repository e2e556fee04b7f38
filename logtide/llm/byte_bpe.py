"""Operator 13: byte-level BPE encoding and decoding with a table of ranks.

A pattern cuts the text into matches; inside a match, whose bytes start as single-byte tokens, the neighbours whose
joined bytes have the smallest rank are joined, the leftmost of equals first, until no neighbours have a rank.

Each match has a segment tree over its byte positions. The leaf of a live token's first byte holds the rank of the token
joined with the next one, with the position below it in the same integer; an inner node holds the smaller of its two
children, so the root names the leftmost pair of minimum rank. A merge changes three leaves (the pair, the token that
disappears, the neighbour on the left) and their paths: a match of n bytes costs n log n steps, whatever it looks like.

Text is cut before each run of white space, where no match of the pattern can go across; equal cuts and equal
matches are encoded once per process, in tables of bounded size. The trees of all new short matches of a batch are the
rows of one array, so that each round of merges is a few array operations; a long match has a tree of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from logtide.llm.common import BoundedTable, id_and_text, map_batches

#: Entries of the tables of encoded cuts and matches, per process; longer ones are encoded each time.
CUT_TABLE, MATCH_TABLE, LONGEST_KEPT = 200_000, 100_000, 64
#: Characters of text that are encoded together, and new matches whose trees are in memory at once.
TEXT_AT_ONCE, TREES_AT_ONCE = 2_000_000, 16_384
#: Leaves of the trees that are rows of an array; matches with more pairs have their own.
ROW_LEAVES = (8, 16, 32, 64)
#: Leaf of a position without a ranked pair; positions take the low bits.
POSITION_BITS = 40
POSITION = (1 << POSITION_BITS) - 1
NO_PAIR = 1 << 80

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(table: bytes) -> dict[bytes, int]:
    """Rank of each token from lines of base64 text, a blank and a number."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, table.splitlines())}


def merge(text: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one match after all merges; `longest` is the length of the longest token."""
    n = len(text)
    if n < 2:
        return [ranks[text]] if n else []
    leaves = n - 1
    tree = [0] * leaves
    for i in range(leaves):
        rank = ranks.get(text[i:i + 2])
        tree.append(NO_PAIR if rank is None else rank << POSITION_BITS | i)
    for node in range(leaves - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right

    after = list(range(1, n + 1))  # first byte of the next live token
    before = list(range(-1, n))  # first byte of the live token on the left; entry n is never read as a token

    def put(position: int, value: int) -> None:
        node = position + leaves
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            node >>= 1
            value = value if value < other else other
            if tree[node] == value:
                return
            tree[node] = value

    def pair(start: int) -> int:
        """Leaf of the token at `start` with its neighbour on the right."""
        middle = after[start]
        if middle == n or after[middle] - start > longest:
            return NO_PAIR
        rank = ranks.get(text[start:after[middle]])
        return NO_PAIR if rank is None else rank << POSITION_BITS | start

    while (best := tree[1]) != NO_PAIR:
        start = best & POSITION
        gone = after[start]
        end = after[start] = after[gone]
        before[end] = start
        if gone < leaves:
            put(gone, NO_PAIR)
        put(start, pair(start))
        if start:
            put(before[start], pair(before[start]))

    out, start = [], 0
    while start < n:
        out.append(ranks[text[start:after[start]]])
        start = after[start]
    return out


class PairTable:
    """Id of the token that two tokens make, by a hash table of all splits of all tokens, in arrays."""

    NONE = (1 << 31) - 1

    def __init__(self, ranks: dict[bytes, int]):
        known = [(ranks[t[:i]] << 32 | ranks[t[i:]], rank) for t, rank in ranks.items()
                 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = np.array(known, np.int64).reshape(-1, 2).T
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE, np.int64)
        slots = self._slots(keys)
        while len(keys):
            slot, first = np.unique(slots, return_index=True)
            first = first[self.keys[slot] < 0]
            self.keys[slots[first]], self.values[slots[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, slots = keys[left], values[left], slots[left] + 1 & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], self.NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slots[open_] = slots[open_] + 1 & self.mask
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def merge_rows(matches: list[bytes], leaves: int, pairs: PairTable, byte_ids: np.ndarray) -> list[bytes]:
    """`merge` for many matches of 2 to `leaves` + 1 bytes: their trees are the rows of one array."""
    n, width = len(matches), leaves + 1
    size = np.fromiter(map(len, matches), np.int64, n)
    raw = np.frombuffer(b"".join([m.ljust(width, b"\0") for m in matches]), np.uint8).reshape(n, width)
    token = byte_ids[raw]
    position = np.arange(width)
    live = position < size[:, None]
    tree = np.full((n, 2 * leaves), PairTable.NONE, np.int64)
    rows, at = np.nonzero(live[:, 1:])
    rank = pairs.of(token[rows, at], token[rows, at + 1])
    tree[rows, leaves + at] = np.where(rank == PairTable.NONE, rank, rank * width + at)
    half = leaves
    while half > 1:
        tree[:, half // 2:half] = np.minimum(tree[:, half:2 * half:2], tree[:, half + 1:2 * half:2])
        half //= 2
    after = np.tile(position + 1, (n, 1))
    before = np.tile(np.arange(-1, width), (n, 1))
    rows = np.arange(n)
    while len(rows := rows[tree[rows, 1] != PairTable.NONE]):
        made, start = np.divmod(tree[rows, 1], width)
        gone = after[rows, start]
        end = after[rows, gone]
        token[rows, start], live[rows, gone] = made, False
        after[rows, start], before[rows, end] = end, start
        # the pair on the right, the pair on the left, and the leaf of the token that is gone
        right, left = end < size[rows], start > 0
        r = np.concatenate([rows[right], rows[left]])
        a = np.concatenate([start[right], before[rows[left], start[left]]])
        rank = pairs.of(token[r, a], token[r, after[r, a]])
        value = np.where(rank == PairTable.NONE, rank, rank * width + a)
        closed, inner = ~right, gone < leaves
        none = np.full(int(closed.sum() + inner.sum()), PairTable.NONE)
        base = np.concatenate([r, rows[closed], rows[inner]]) * (2 * leaves)
        node = np.concatenate([a, start[closed], gone[inner]]) + leaves
        flat = tree.reshape(-1)
        flat[base + node] = np.concatenate([value, none])
        while node[0] > 1:  # all leaves are equally deep
            node >>= 1
            child = base + 2 * node
            flat[base + node] = np.minimum(flat[child], flat[child + 1])
    ids = token[live].astype("<u4").tobytes()
    ends = np.cumsum(live.sum(axis=1)) * 4
    return [ids[lo:hi] for lo, hi in zip([0, *ends.tolist()], ends.tolist())]


class ByteCodec:
    """Encoder and decoder for one table of ranks and one pattern, without special tokens.

    Every single byte must have a rank; a table without it is refused with a ValueError.
    """

    def __init__(self, table: bytes, pattern: str):
        self.ranks = read_ranks(table)
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("every byte needs a rank")
        self.longest = max(map(len, self.ranks))
        self.surface = dict(zip(self.ranks.values(), self.ranks))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = PairTable(self.ranks)
        self.matches = BoundedTable(self._encode_match, MATCH_TABLE)
        self.cuts = BoundedTable(self._encode_cut, CUT_TABLE)
        self._match = regex.compile(pattern)
        # A cut is safe only if the pattern keeps white space to the start of a match, or to a match of its own.
        self._cut = regex.compile(r"\s*\S+|\s+")
        self._run = re.compile(r"\s\s")

    def forget(self) -> None:
        self.cuts.forget()
        self.matches.forget()

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """`encode` of each text; what is new in them is encoded together."""
        cuts = [self._cuts(t) for t in texts]
        self._learn(set(chain.from_iterable(cuts)))
        for own in cuts:
            if not own or len(max(own, key=len)) <= LONGEST_KEPT:
                yield b"".join(map(self.cuts.__getitem__, own))
            else:
                yield b"".join([self.cuts[c] if len(c) <= LONGEST_KEPT else self._encode_cut(c) for c in own])

    def _cuts(self, text: str) -> list[str]:
        if not text:
            return []
        if self._run.search(text) or text[0] in " \n":
            return self._cut.findall(text)
        # every blank or line feed stands alone, so that each starts a cut
        first, *others = text.replace("\n", " \n").split(" ")
        return [first, *[c if c[:1] == "\n" else " " + c for c in others]]

    def _learn(self, cuts: set[str]) -> None:
        """Fill the tables with what they lack of `cuts`."""
        known, older = self.cuts, self.cuts.old
        new = [c for c in cuts if c not in known and c not in older and len(c) <= LONGEST_KEPT]
        split = list(map(self._match.findall, new))
        by_size: dict[int, list[str]] = {}
        for match in set(chain.from_iterable(split)):
            raw = match.encode()
            if raw not in self.ranks and match not in self.matches and match not in self.matches.old:
                leaves = next((n for n in ROW_LEAVES if len(raw) <= n + 1), 0)
                if leaves:
                    by_size.setdefault(leaves, []).append(match)
        for leaves, found in by_size.items():
            for at in range(0, len(found), TREES_AT_ONCE):
                some = found[at:at + TREES_AT_ONCE]
                for match, ids in zip(some, merge_rows([m.encode() for m in some], leaves, self.pairs, self.byte_ids)):
                    self.matches[match] = ids
        for cut, parts in zip(new, split):
            self.cuts.keep(cut, b"".join([self.matches[m] if len(m) <= LONGEST_KEPT else self._encode_match(m) for m in parts]))
        self.matches.shrink()

    def _encode_cut(self, cut: str) -> bytes:
        return b"".join([self.matches[m] if len(m) <= LONGEST_KEPT else self._encode_match(m) for m in self._match.findall(cut)])

    def _encode_match(self, match: str) -> bytes:
        raw = match.encode()
        known = self.ranks.get(raw)
        return array("I", [known] if known is not None else merge(raw, self.ranks, self.longest)).tobytes()

    def decode(self, ids: Sequence[int]) -> bytes:
        """Bytes of the ids; an id without a token raises a KeyError. They need not be UTF-8."""
        return b"".join(map(self.surface.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(table: bytes, pattern: str) -> ByteCodec:
    """One codec per process and table."""
    return ByteCodec(table, pattern)


def unpacked(ids: bytes) -> array:
    out = array("I")
    out.frombytes(ids)
    return out


def encode_documents(docs: DataFrame, table: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and decode them again: (doc_id, ids array<int>, decoded binary).

    A null text counts as empty and gives no ids. Rows are independent: repeated rows and ids, null ids and
    columns of any name are fine; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(table)  # one file, less than a megabyte

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value, pattern)
        for part in _slices(batch):
            ids = list(map(unpacked, own.encode_all([t or "" for t in part.column(1).to_pylist()])))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([x.tolist() for x in ids], pa.list_(pa.int32())),
                 pa.array([own.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return map_batches(id_and_text(docs, id_col, text_col), work, "doc_id long, ids array<int>, decoded binary",
                       lambda: codec(sent.value, pattern).forget())


def encoding_digests(docs: DataFrame, table: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of `encode_documents`, computed in the same pass: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value, pattern)
        for part in _slices(batch):
            counts, of_ids, of_text = [], [], []
            for raw in own.encode_all([t or "" for t in part.column(1).to_pylist()]):
                counts.append(len(raw) // 4)
                of_ids.append(hashlib.sha256(raw).hexdigest())
                of_text.append(hashlib.sha256(own.decode(unpacked(raw))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(id_and_text(docs, id_col, text_col), work, SCHEMA, lambda: codec(sent.value, pattern).forget())


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of rows with about `TEXT_AT_ONCE` characters, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // TEXT_AT_ONCE
    starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
    for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(lo, hi - lo)

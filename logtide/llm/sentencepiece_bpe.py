"""Operator 1: SentencePiece encoding and decoding of merge-type (BPE) models.

The encoder does not run the merges over the text. It uses that a split of a text into
pieces is the result of the merges if and only if every two neighbours are the result of
the merges of the two joined: an Aho-Corasick automaton gives the longest piece at each
position, a pair of neighbours is checked by merging it again (each pair once per process),
and a bit field remembers the positions from which no split goes on. Work is linear in the
text, whatever its length.

Text is cut beforehand where no merge can ever join the two sides: before a run of word
marks, if no piece has a mark after another character, and around line feeds, if no piece
has one. Equal cuts are encoded once per process, in a table of bounded size.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from logtide.llm.common import BoundedTable, id_and_text, map_batches

MARK = "▁"
#: Entries of the tables of encoded cuts, of their parts and of checked pairs, per process.
CUT_TABLE, PART_TABLE, PAIR_TABLE = 120_000, 40_000, 150_000
#: The first two where a process has the memory to itself, about 300 MB: a partition then meets few words twice as new ones.
WIDE_CUTS, WIDE_PARTS = 400_000, 200_000
#: Longer cuts are encoded each time.
LONGEST_KEPT = 64
NO_MERGE = float("-inf")
#: Characters without a piece are numbered from here, as pieces are by their ids; START stands before the first piece.
UNKNOWN, START = 1 << 21, (1 << 22) - 1

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceCodec:
    """Encoder and decoder for one model, given as the bytes of its file.

    Supported are merge-type models with byte fallback whose normaliser leaves the text as it is
    apart from marking spaces; others are refused with a ValueError. `cut_table` and `part_table` bound the
    entries kept; they change the speed, never the ids.
    """

    def __init__(self, model: bytes, cut_table: int = CUT_TABLE, part_table: int = PART_TABLE):
        from sentencepiece import sentencepiece_model_pb2 as layout

        proto = layout.ModelProto()
        proto.ParseFromString(model)
        rules, kind = proto.normalizer_spec, layout.ModelProto.SentencePiece
        types = [piece.type for piece in proto.pieces]
        if (proto.trainer_spec.model_type != layout.TrainerSpec.BPE or rules.precompiled_charsmap
                or rules.remove_extra_whitespaces or not rules.escape_whitespaces
                or proto.trainer_spec.treat_whitespace_as_suffix or proto.denormalizer_spec.precompiled_charsmap
                or kind.USER_DEFINED in types or kind.UNUSED in types or types.count(kind.BYTE) != 256):
            raise ValueError("only BPE models with byte fallback and without normalisation are supported")
        self.prefix = MARK if rules.add_dummy_prefix else ""
        self.pieces = [piece.piece for piece in proto.pieces]
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, types)) if t == kind.NORMAL}
        self.score = {p: proto.pieces[i].score for p, i in self.ids.items()}
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        for i, (piece, t) in enumerate(zip(self.pieces, types)):
            if t == kind.BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif t == kind.CONTROL:
                self.surface.append(b"")
            elif t == kind.UNKNOWN:
                self.surface.append((proto.trainer_spec.unk_surface or " ⁇ ").encode())
            else:
                self.surface.append(piece.replace(MARK, " ").encode())
        self.is_byte = [t == kind.BYTE for t in types]
        self.control = {i for i, t in enumerate(types) if t == kind.CONTROL}
        self.decimal = [str(i) for i in range(len(self.pieces))]

        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        #: Longest piece that is a proper prefix of a piece, -1 for none.
        self.shorter = [-1] * len(self.pieces)
        for piece, i in self.ids.items():
            self.shorter[i] = next((self.ids[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), -1)

        self.cut_at_marks = all(MARK not in piece.lstrip(MARK) for piece in self.ids)
        self.cut_at_lines = self.cut_at_marks and all("\n" not in piece for piece in self.ids)
        #: Two characters that stand together in some piece; no merge ever joins others.
        self.joined = {piece[i - 1:i + 1] for piece in self.ids for i in range(1, len(piece))}
        self.length = [len(piece) for piece in self.pieces]
        self.cuts = BoundedTable(self._encode_cut, cut_table)
        self.parts = BoundedTable(self._split, part_table)
        self.pairs = BoundedTable(self._pair_holds, PAIR_TABLE)
        self._runs = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+")

    def forget(self) -> None:
        """Empty the tables of texts; checked pairs stay, there are fewer of them."""
        self.cuts.forget()
        self.parts.forget()

    # -- encoding ---------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text, without begin and end ids."""
        if not text:
            return []
        cuts = self._cut(text)
        if len(max(cuts, key=len)) > LONGEST_KEPT:
            return list(chain.from_iterable(self._encode_cut(c) if len(c) > LONGEST_KEPT else self.cuts[c] for c in cuts))
        return list(chain.from_iterable(map(self.cuts.__getitem__, cuts)))

    def _cut(self, text: str) -> Sequence[str]:
        """Parts to encode; one that does not start with a line feed stands for itself after a mark."""
        if not self.cut_at_lines or not self.prefix:
            return ["\r" + self.prefix + text.replace(" ", MARK)]
        if "  " in text or MARK in text or text[0] == " ":
            whole = self.prefix + text.replace(" ", MARK)
            return [x[1:] if x[0] == MARK else x for x in self._runs.findall(whole)]
        return text.replace("\n", " \n").split(" ") if "\n" in text else text.split(" ")

    def _encode_cut(self, cut: str) -> tuple[int, ...]:
        if cut[:1] == "\r" and (not self.cut_at_lines or not self.prefix):
            return self._split(cut[1:])
        text = cut if cut[:1] == "\n" else MARK + cut
        if cut.isalpha():
            return self._split(text)
        joined = self.joined
        ends = [i for i in range(1, len(text)) if text[i - 1:i + 1] not in joined]
        if not ends:
            return self._split(text)
        starts, out = [0, *ends], []
        for part in map(text.__getitem__, map(slice, starts, [*ends, len(text)])):
            out.extend(self.parts[part] if len(part) <= LONGEST_KEPT else self._split(part))
        return tuple(out)

    def _split(self, text: str) -> tuple[int, ...]:
        """Backtracking over the longest pieces; numbers from `UNKNOWN` on stand for characters without a piece."""
        size, length, shorter, pairs = len(text), self.length, self.shorter, self.pairs
        # later matches from one start are longer, so the longest stays
        longest = {end - value[0]: value[1] for end, value in self.automaton.iter(text)}
        failed = bytearray(size // 8 + 1)
        chosen: list[int] = []
        at, before = 0, START
        token = longest.get(-1, -1)
        while at < size:
            if token < 0:
                token = UNKNOWN + ord(text[at])
            while True:
                end = at + (length[token] if token < UNKNOWN else 1)
                if not failed[end >> 3] >> (end & 7) & 1 and pairs[before << 22 | token]:
                    chosen.append(token)
                    at, before = end, token
                    token = longest.get(end - 1, -1)
                    break
                token = shorter[token] if token < UNKNOWN else -1
                while token < 0:  # no split goes on from here: take the piece before back
                    failed[at >> 3] |= 1 << (at & 7)
                    token = chosen.pop()
                    at -= length[token] if token < UNKNOWN else 1
                    before = chosen[-1] if chosen else START
                    token = shorter[token] if token < UNKNOWN else -1
        if not chosen or max(chosen) < UNKNOWN:
            return tuple(chosen)
        out: list[int] = []
        for token in chosen:
            out.extend([token] if token < UNKNOWN else [self.byte_ids[b] for b in chr(token - UNKNOWN).encode()])
        return tuple(out)

    def _pair_holds(self, pair: int) -> bool:
        """Do the merges of the two joined end with exactly these two?"""
        wanted = [self.pieces[t] if t < UNKNOWN else chr(t - UNKNOWN) for t in (pair >> 22, pair & (1 << 22) - 1) if t != START]
        joined = "".join(wanted)
        return (len(wanted) == 1 or joined not in self.score) and self._merge(joined) == wanted

    def _merge(self, text: str) -> list[str]:
        """The merges themselves: the best score first, the leftmost of equals."""
        parts, score = list(text), self.score
        scores = [score.get(a + b, NO_MERGE) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > NO_MERGE:
            i = scores.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score.get(parts[i - 1] + parts[i], NO_MERGE)
            if i < len(scores):
                scores[i] = score.get(parts[i] + parts[i + 1], NO_MERGE)
        return parts

    # -- decoding ---------------------------------------------------------------

    def decode(self, ids: Sequence[int]) -> str:
        """Text of the ids: the first mark goes, bytes that are no UTF-8 become replacement characters."""
        try:  # control ids are empty, but end a run of byte ids
            text = b"".join(map(self.surface.__getitem__, ids)).decode() if self.control.isdisjoint(ids) else self._decode_bytes(ids)
        except UnicodeDecodeError:
            text = self._decode_bytes(ids)
        if self.prefix:
            for i in ids:
                if self.surface[i]:
                    return text[1:] if self.pieces[i][0] == MARK else text
        return text

    def _decode_bytes(self, ids: Sequence[int]) -> str:
        """One replacement character for each byte of a run of byte ids that starts no character."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                size = next((n for n in (1, 2, 3, 4) if _is_character(bytes(run[at:at + n]))), 0)
                out.append(bytes(run[at:at + size]).decode() if size else "�")
                at += size or 1
            run.clear()

        for i in ids:
            if self.is_byte[i]:
                run += self.surface[i]
            else:
                flush()
                out.append(self.surface[i].decode())
        flush()
        return "".join(out)


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=2)
def codec(model: bytes, cut_table: int = CUT_TABLE, part_table: int = PART_TABLE) -> PieceCodec:
    """One codec per process, model and sizes."""
    return PieceCodec(model, cut_table, part_table)


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Pause the search for reference cycles: the codec makes none, and its tables are large to walk again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and decode them again: (doc_id, ids array<int>, decoded string).

    A null text counts as empty and gives no ids. Rows are independent: repeated rows and ids, null ids and
    columns of any name are fine; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one file, about half a megabyte

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value)
        for part in _slices(batch):
            with _no_cycles():
                ids = [own.encode(t or "") for t in part.column(1).to_pylist()]
                decoded = pa.array([own.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), decoded], ["doc_id", "ids", "decoded"])

    return map_batches(id_and_text(docs, id_col, text_col), work, "doc_id long, ids array<int>, decoded string",
                       lambda: codec(sent.value).forget())


def encoding_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text",
                     cut_table: int = WIDE_CUTS, part_table: int = WIDE_PARTS) -> DataFrame:
    """Digests of `encode_documents`, computed in the same pass: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value, cut_table, part_table)
        for part in _slices(batch):
            counts, of_ids, of_text = [], [], []
            with _no_cycles():
                for text in part.column(1).to_pylist():
                    ids = own.encode(text or "")
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
                    of_text.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(id_and_text(docs, id_col, text_col), work, SCHEMA, lambda: codec(sent.value, cut_table, part_table).forget())


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)

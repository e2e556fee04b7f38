"""Operator 12: phrase collocation mining on sorted count streams.

A phrase is frequent only if each part of it is, so counts are taken length by length: a pass over the texts counts the phrases
of n words whose two parts of n - 1 words may be frequent. A filter of a fixed number of bits says which may be; it
never denies a frequent one, and what it lets through in error falls to the exact counts.

The counts then lie in two orders, as in external estimation of language models. In prefix order (words from the left) the first
parts of a phrase stand before it and its extensions to the right behind it; in suffix order (words from the right) the
same holds for its last parts and its extensions to the left. One pass in lockstep over all lengths of an order, with a stack of at most
four open phrases, joins each phrase with the counts of all its parts on that side and with the largest extension. No
table is built by key. An order is cut into ranges at sampled splitters, whole phrases being the keys, so a range may
begin inside a frequent prefix; the few rows that are parts of a splitter are shown to the ranges they reach into.

A longer candidate that holds a phrase has an extension of the phrase by one word inside it, which is at least as frequent,
so the largest extension by one word decides whether a phrase is dropped.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from logtide.llm.common import map_batches, mix64, small_batches, stored

LONGEST, LEAST, TOP = 4, 30, 2_000
#: A score is this times a / (l + r); a phrase goes if an extension has this share, in percent, of its occurrences.
SCALE, SHARE = 2_000_000, 80
NO_LANG = "und"
#: Bits of the filter of frequent phrases, and positions per phrase.
FILTER_BITS, FILTER_KEYS = 1 << 26, 2
#: Rows of an order in one range, and sampled keys per range.
RANGE_ROWS, RANGE_SAMPLE = 100_000, 30
#: Texts that are split together, in bytes.
TEXT_AT_ONCE = 8_000_000

BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2


class Words:
    """The words of some texts: distinct words, their number at each place, language and piece of each place."""

    def __init__(self, texts: pa.Array, langs: np.ndarray):
        texts = texts.cast(pa.large_binary())
        data = np.frombuffer(b"".join([t + b"\n" for t in texts.to_pylist()]), np.uint8)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        data = _LOWER[data]
        kind = _KIND[data]
        inside = kind == 0
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, stops = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
        spelled = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
        coded = spelled.dictionary_encode()
        self.distinct = coded.dictionary.cast(pa.string())
        self.word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.piece = np.cumsum(kind == 2)[starts] if len(starts) else np.zeros(0, np.int64)
        self.lang = langs[np.searchsorted(ends, starts, side="right")] if len(starts) else np.zeros(0, np.int64)

    def hashes(self, lang_hashes: np.ndarray, n: int) -> np.ndarray:
        """Hash of the language and the `n` words from each place on; those at the end are of no phrase."""
        if not len(self.word):
            return np.zeros(0, np.uint64)
        of_word = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.distinct.to_pylist()), np.uint64, len(self.distinct))[self.word]
        out = lang_hashes[self.lang]
        for i in range(n):
            out = mix64(out ^ np.roll(of_word, -i))
        return out


def phrase_hash(lang: str, words: list[str]) -> int:
    """What `Words.hashes` computes, for one phrase."""
    out = np.array([xxhash.xxh64_intdigest(lang)], np.uint64)
    for w in words:
        out = mix64(out ^ np.uint64(xxhash.xxh64_intdigest(w)))
    return int(out[0])


def _bits(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for i in range(FILTER_KEYS):
        yield (hashes >> np.uint64(i * 32)) % np.uint64(bits)


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.flatnonzero(np.diff(np.cumsum(sizes) // TEXT_AT_ONCE, prepend=-1)).tolist()
    for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(lo, hi - lo)


def phrase_counts(texts: DataFrame, n: int, least: int, parts: np.ndarray | None, bits: int) -> DataFrame:
    """(lang, phrase, f) of the phrases of `n` words that occur `least` times or more in `texts` (text, lang).

    `parts` is the filter of the frequent phrases of n - 1 words, None for single words.
    """
    sent = texts.sparkSession.sparkContext.broadcast(parts)  # FILTER_BITS bits

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in _batches(batch):
            langs = part.column("lang").dictionary_encode()
            names = langs.dictionary.to_pylist()
            words = Words(part.column("text"), langs.indices.to_numpy(zero_copy_only=False).astype(np.int64))
            at = np.arange(max(0, len(words.word) - n + 1))
            at = at[words.piece[at] == words.piece[at + n - 1]]
            if sent.value is not None and len(at):
                hashes = words.hashes(np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names)), n - 1)
                maybe = np.ones(len(hashes), bool)
                for bit in _bits(hashes, bits):
                    maybe &= (sent.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                at = at[maybe[at] & maybe[at + 1]]
            # a number for each (language, words so far), exact at every length
            code = words.lang[at]
            for i in range(n):
                code = np.unique(code * len(words.distinct) + words.word[at + i], return_inverse=True)[1] if len(at) else code
            _, first, count = np.unique(code, return_index=True, return_counts=True)
            where = at[first]
            spelled = [words.distinct.take(pa.array(words.word[where + i])) for i in range(n)]
            phrase = pc.binary_join_element_wise(*spelled, " ") if n > 1 else spelled[0]
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(words.lang[where])).cast(pa.string()), phrase.cast(pa.string()), pa.array(count.astype(np.int64))],
                ["lang", "phrase", "f"])

    counted = map_batches(texts, work, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return counted.where(F.col("f") >= least) if n > 1 else counted


def frequent_filter(phrases: DataFrame, bits: int) -> np.ndarray:
    """Bits of the hashes of (lang, phrase), joined from all tasks; the driver gets `bits` / 64 numbers at most."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hashes = np.fromiter((phrase_hash(lang, p.split(" ")) for lang, p in zip(*(c.to_pylist() for c in batch.columns))),
                             np.uint64, batch.num_rows)
        found = np.unique(np.concatenate(list(_bits(hashes, bits))))
        yield pa.RecordBatch.from_arrays([pa.array((found >> np.uint64(6)).astype(np.int64)),
                                          pa.array((np.uint64(1) << (found & np.uint64(63))).view(np.int64))], ["cell", "mask"])

    cells = map_batches(phrases.select("lang", "phrase"), work, "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask"))
    table = cells.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[table.column("cell").to_numpy()] = table.column("mask").to_numpy()
    return out.view(np.uint8)


# -- the two orders ---------------------------------------------------------------


def _splitters(rows: DataFrame, range_rows: int) -> list[tuple[str, list[str]]]:
    """Keys at about equal steps of the order: as many as there are ranges, from a sample of as many keys per range."""
    many = rows.count()
    ranges = -(-many // range_rows)
    if ranges < 2:
        return []
    share = min(1.0, ranges * RANGE_SAMPLE / many)
    drawn = F.pmod(F.xxhash64("lang", "key"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    sample = sorted((r["lang"], tuple(r["key"])) for r in rows.where(drawn).select("lang", "key").collect())
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


def _dealt(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    """Add the range of each row; rows that are parts of a splitter are also shown to the ranges they reach into."""
    sent = rows.sparkSession.sparkContext.broadcast(splitters)
    reach: dict[tuple, list[int]] = {}
    for i, (lang, key) in enumerate(splitters, 1):
        for size in range(1, len(key)):
            reach.setdefault((lang, key[:size]), []).append(i)
    shown = rows.sparkSession.sparkContext.broadcast(reach)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        take, ranges, guest, parted = [], [], [], []
        for i, (lang, key) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist())):
            own, others = (lang, tuple(key)), ()
            home = bisect_right(sent.value, own)
            if own in shown.value:
                others = [r for r in shown.value[own] if r != home]
            take += [i] * (1 + len(others))
            ranges += [home, *others]
            guest += [False] + [True] * len(others)
            parted += [bool(others)] * (1 + len(others))
        out = batch.take(pa.array(take, pa.int64()))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(ranges, pa.int32()), pa.array(guest, pa.bool_()), pa.array(parted, pa.bool_())],
                                         [*out.schema.names, "range", "guest", "parted"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", range int, guest boolean, parted boolean"
    return map_batches(rows, work, schema)


def lockstep(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`rows` (lang, key array<string>, f, ...) with the counts of all first parts of each key and of its largest extension.

    Adds `parts` (f of the first 1, 2, ... words of the key, without the key itself) and `extension` (the largest f of the keys with
    one more word, 0 if there are none). Every first part of a key must be a row itself.
    """
    splitters = _splitters(rows, range_rows)
    dealt = _dealt(rows, splitters)
    ordered = (dealt.repartition(len(splitters) + 1, "range") if splitters else dealt.repartition(1))
    ordered = ordered.sortWithinPartitions("range", "lang", "key")
    small_batches(rows.sparkSession)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[list] = []  # [range, lang, key, f, extension, values, guest, parted]

        def close(out: list) -> None:
            *_, f, extension, values, guest, parted = open_.pop()
            out.append((*values, [e[3] for e in open_], extension, guest, parted))

        for batch in batches:
            out: list[tuple] = []
            columns = [c.to_pylist() for c in batch.columns]
            at = {name: columns[i] for i, name in enumerate(batch.schema.names)}
            for row, values in enumerate(zip(*(at[name] for name in names))):
                place, lang, key, f = at["range"][row], at["lang"][row], at["key"][row], at["f"][row]
                while open_ and (open_[-1][0] != place or open_[-1][1] != lang or open_[-1][2] != key[:len(open_[-1][2])]
                                 or len(open_[-1][2]) >= len(key)):
                    close(out)
                if open_ and len(open_[-1][2]) == len(key) - 1 and not at["guest"][row]:
                    open_[-1][4] = max(open_[-1][4], f)
                open_.append([place, lang, key, f, 0, values, at["guest"][row], at["parted"][row]])
            yield from _rows(out, schema)
        out = []
        while open_:
            close(out)
        yield from _rows(out, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = StructType([*rows.schema.fields, *StructType.fromDDL("parts array<bigint>, extension bigint, guest boolean, parted boolean").fields])
    schema = to_arrow_schema(wanted)
    done = ordered.mapInArrow(run, wanted)
    if not splitters:
        return done.drop("guest", "parted")
    done = stored(done, "collocations-order")
    # A row that several ranges have seen keeps its own parts and the largest of the extensions.
    once = done.where("parted").groupBy("lang", "key").agg(
        *[F.max_by(c, ~F.col("guest")).alias(c) for c in [*names, "parts"] if c not in ("lang", "key")], F.max("extension").alias("extension"))
    return done.where("not parted").drop("guest", "parted").unionByName(once)


def _rows(out: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang",
                 bits: int = FILTER_BITS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All phrases that stay, unranked: (lang, phrase, a, l, r, n, score), for phrases of 2 to `longest` words.

    A null text has no words; a null language is `und`, together with rows that say so. Repeated rows count each time;
    other columns, whatever their names, are not read. No phrase frequent enough, or no rows, gives an empty result.
    """
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"))
    words = stored(phrase_counts(texts, 1, least, None, bits), "collocations-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [words.where(F.col("f") >= least)]
    for n in range(2, longest + 1):
        parts = frequent_filter(levels[-1], bits)
        levels.append(stored(phrase_counts(texts, n, least, parts, bits), f"collocations-{n}"))
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.unionByName(level)
    in_prefix_order = lockstep(rows.select("lang", F.split("phrase", " ", -1).alias("key"), "f"), range_rows)
    turned = in_prefix_order.select("lang", F.reverse("key").alias("key"), "f", F.col("parts").alias("firsts"), F.col("extension").alias("right"))
    both = lockstep(stored(turned, "collocations-prefix"), range_rows)
    phrases = both.where((F.size("key") > 1) & (F.greatest("right", "extension") * 100 < F.col("f") * SHARE))
    # Cut k: the first k words and the rest; the lowest score and then the smallest k count.
    cuts = F.transform(F.sequence(F.lit(1), F.size("key") - 1), lambda k: F.struct(
        k.alias("k"), F.element_at("firsts", k).alias("l"), F.element_at("parts", F.size("key") - k).alias("r")))
    scored = phrases.withColumn("cut", F.explode(cuts)).select(
        "lang", F.array_join(F.reverse("key"), " ").alias("phrase"), F.col("f").alias("a"), "cut.k", "cut.l", "cut.r")
    # Decimals: the product of a count may pass 64 bits.
    score = F.expr(f"cast({SCALE} as decimal(10, 0)) * cast(a as decimal(20, 0)) div cast(l + r as decimal(20, 0))")
    lowest = (scored.withColumn("score", score).groupBy("lang", "phrase", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    return lowest.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocation_report(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """The first `top` phrases of each language by score, occurrences and bytes of the phrase."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (collocations(docs, longest, least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


ORACLE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
grams AS (
    SELECT lang, w[i:i + size - 1] AS key FROM split, range(1, 5) s(size), LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)),
counts AS MATERIALIZED (SELECT lang, key, count(*) AS f FROM grams GROUP BY lang, key HAVING count(*) >= 30),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
cuts AS (
    SELECT c.lang, c.key, c.f AS a, k, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * c.f // (l.f + r.f) AS BIGINT) AS score
    FROM (SELECT lang, key, f, unnest(range(1, len(key))) AS k FROM counts WHERE len(key) > 1) c
    JOIN counts l ON l.lang = c.lang AND l.key = c.key[1:k] JOIN counts r ON r.lang = c.lang AND r.key = c.key[k + 1:len(c.key)]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, key ORDER BY score, k) = 1),
inside AS (
    SELECT lang, key[i:i + size - 1] AS key, max(f) AS f
    FROM (SELECT lang, key, f, size, unnest(range(1, len(key) - size + 2)) AS i FROM counts, range(2, 4) s(size) WHERE len(key) > size)
    GROUP BY ALL),
ranked AS (
    SELECT x.lang, x.key, x.a, x.l, x.r, x.score, array_to_string(x.key, ' ') AS phrase
    FROM lowest x LEFT JOIN inside i ON i.lang = x.lang AND i.key = x.key WHERE coalesce(100 * i.f < 80 * x.a, TRUE))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM ranked JOIN totals USING (lang) QUALIFY rank <= 2000
"""

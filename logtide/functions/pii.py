"""Redaction of personal data with built-in regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pattern and replacement of each type, applied in this order. `(?U)` gives
# word, digit and space classes their Unicode meaning.
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
_HEX = "[0-9a-fA-F]{1,4}"
PATTERNS = {
    "credit_card": (
        r"(?U)\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"
        r"|\b(?:4[0-9]{3}|5[1-5][0-9]{2}|3[47][0-9]|6(?:011|5[0-9]{2}))(?:[-\s][0-9]{4}){3}\b"
        r"|\b3[47][0-9]{2}[-\s][0-9]{6}[-\s][0-9]{5}\b",
        "[CC REDACTED]",
    ),
    "email": (
        r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
        "[EMAIL REDACTED]",
    ),
    "phone": (
        r"(?U)(?<!\w)(?:(?:\+?1[-.\s]?)?(?:\(\d{3}\)|\d{3})[-.\s]\d{3}[-.\s]\d{4}"
        r"|\+1[-.\s]\d{3}[-.\s]\d{3}[-.\s]\d{4})(?!\d)",
        "[PHONE REDACTED]",
    ),
    "ipv4": (rf"(?U)\b(?:{_OCTET}\.){{3}}{_OCTET}\b", "[IPv4 REDACTED]"),
    "ipv6": (
        rf"(?:(?:{_HEX}:){{7}}{_HEX}"
        rf"|(?:{_HEX}:){{1,7}}:"
        rf"|:(?::{_HEX}){{1,7}}"
        rf"|(?:{_HEX}:){{1,6}}:{_HEX}"
        rf"|(?:{_HEX}:){{1,5}}(?::{_HEX}){{1,2}}"
        rf"|(?:{_HEX}:){{1,4}}(?::{_HEX}){{1,3}}"
        rf"|(?:{_HEX}:){{1,3}}(?::{_HEX}){{1,4}}"
        rf"|(?:{_HEX}:){{1,2}}(?::{_HEX}){{1,5}}"
        rf"|{_HEX}:(?::{_HEX}){{1,6}})",
        "[IPv6 REDACTED]",
    ),
}


# Cheap tests that every match of the pattern must pass. Most texts hold no personal data and
# skip the expensive pattern.
GUARDS = {
    "credit_card": "[0-9]{4}",
    "email": "@",
    "phone": r"(?U)\d{3}[-.\s]\d{4}",
    "ipv4": r"(?U)\d\.\d",
    "ipv6": "::|[0-9a-fA-F]:[0-9a-fA-F]{1,4}:",
}


# What `\b` and `\s` are to engines that read them as ASCII.
_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def plain_pattern(pattern: str) -> str:
    """A pattern of RE2, as SQL has it, with the same matches in Spark: ASCII edges and spaces, and `$` only at the very end."""
    return pattern.replace(r"\b", _EDGE).replace(r"\s", r"\t\n\f\r ").replace("($|", r"(\z|")


def replace_matches(text: Column, name: str, patterns: dict[str, tuple[str, str]] = PATTERNS) -> Column:
    pattern, label = patterns[name]
    return F.when(text.rlike(GUARDS[name]), F.regexp_replace(text, pattern, label)).otherwise(text)


def count_matches(text: Column, name: str) -> Column:
    found = F.regexp_count(text, F.lit(PATTERNS[name][0]))
    return F.when(text.rlike(GUARDS[name]), found).otherwise(F.lit(0))


def _clean_array(records: Column, texts: list[str], others: list[str]) -> Column:
    """Array of structs with the text fields redacted and `_n`, the replacements made.

    Two passes over the array per pattern: inside a pass the text is a plain value, so the test and the replacement do not
    repeat the earlier patterns, and matches are counted only where the replacement has changed something.
    """
    def apply(array: Column, name: str) -> Column:
        def replaced(r: Column) -> Column:
            return F.struct(*[r[f].alias(f) for f in [*texts, *others, "_n"]], *[replace_matches(r[f], name).alias(f"_new_{f}") for f in texts])

        def counted(r: Column) -> Column:
            n = r["_n"]
            for f in texts:
                n = n + F.when(r[f] != r[f"_new_{f}"], F.regexp_count(r[f], F.lit(PATTERNS[name][0]))).otherwise(0)
            return F.struct(*[r[f"_new_{f}"].alias(f) for f in texts], *[r[f].alias(f) for f in others], n.alias("_n"))

        return F.transform(F.transform(array, replaced), counted)

    out = F.transform(records, lambda r: F.struct(
        *[r[f].alias(f) for f in [*texts, *others]], F.lit(0).alias("_n")))
    for name in PATTERNS:
        out = apply(out, name)
    return out


def _clean_text(text: Column) -> Column:
    return _clean_array(F.array(F.struct(text.alias("text"))), ["text"], [])[0]


def scrub_text(text: Column) -> Column:
    return _clean_text(text)["text"]


def scrub_count(text: Column) -> Column:
    """Replacements made by `scrub_text`: each pattern counts on the text left by the earlier ones."""
    return _clean_text(text)["_n"]


def scrub_column(df: DataFrame, text: str, out: str, count_out: str, patterns: dict[str, tuple[str, str]] = PATTERNS) -> DataFrame:
    """Add the redacted text and the replacement count, one projection per pattern.

    Other `patterns` have the same names, so that the same guards hold; a replacement may put back groups as `$1`.
    """
    staged = df.withColumn(out, F.col(text)).withColumn(count_out, F.lit(0))
    for name, (_, replacement) in patterns.items():
        label = re.sub(r"\$\d", "", replacement)
        # The pattern runs once: what it replaced is the number of labels that were not there before.
        staged = staged.withColumn("_redacted", replace_matches(F.col(out), name, patterns)).withColumns({
            out: F.col("_redacted"),
            count_out: F.col(count_out) + _labels(F.col("_redacted"), label) - _labels(F.col(out), label),
        })
    return staged.drop("_redacted")


def _labels(text: Column, label: str) -> Column:
    """Occurrences of a label in a text."""
    rest = F.replace(text, F.lit(label), F.lit(""))
    return F.coalesce(((F.length(text) - F.length(rest)) / len(label)).cast("int"), F.lit(0))


def count_by_type(text: Column) -> dict[str, Column]:
    """Matches of each type on the original text."""
    return {name: count_matches(text, name).alias(name) for name in PATTERNS}


def _sum_n(array: Column) -> Column:
    return F.coalesce(F.aggregate(array, F.lit(0), lambda acc, r: acc + r["_n"]), F.lit(0))


def _without_n(array: Column, fields: list[str]) -> Column:
    return F.transform(array, lambda r: F.struct(*[r[f].alias(f) for f in fields]))


def scrub_nested(df: DataFrame, lists: dict[str, tuple[list[str], list[str]]], maps: list[str], count: str) -> DataFrame:
    """Redact lists of structs (text fields, other fields) and the values of maps in place; `count` is the replacements made.

    Every text is read once: the clean lists and the counts come from one column that holds both.
    """
    staged = {name: _clean_array(F.col(name), *fields) for name, fields in lists.items()}
    for name in maps:
        entries = F.transform(F.map_entries(name), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("text")))
        staged[name] = _clean_array(entries, ["text"], ["key"])
    total = F.lit(0)
    for name in staged:
        total = total + _sum_n(F.col(f"_clean_{name}"))
    clean = {name: _without_n(F.col(f"_clean_{name}"), [*texts, *others]) for name, (texts, others) in lists.items()}
    for name in maps:
        clean[name] = F.map_from_entries(_without_n(F.col(f"_clean_{name}"), ["key", "text"]))
    cleaned = df.withColumns({f"_clean_{n}": c for n, c in staged.items()}).withColumns({count: total, **clean})
    return cleaned.drop(*[f"_clean_{n}" for n in staged])


def scrub_records(records: Column, texts: list[str], others: list[str]) -> Column:
    """Array of structs with the text fields redacted and the other fields as they are."""
    return _without_n(_clean_array(records, texts, others), [*texts, *others])


def count_records(records: Column, texts: list[str]) -> Column:
    return _sum_n(_clean_array(records, texts, []))


def scrub_map(values: Column) -> Column:
    """Map with every value redacted; keys stay."""
    entries = F.transform(F.map_entries(values), lambda e: F.struct(e["key"], e["value"].alias("text")))
    clean = scrub_records(entries, ["text"], ["key"])
    return F.map_from_entries(F.transform(clean, lambda r: F.struct(r["key"], r["text"])))


def count_map(values: Column) -> Column:
    return count_records(F.transform(F.map_values(values), lambda x: F.struct(x.alias("text"))), ["text"])


# The event columns that may hold raw text. The owner is left as it is.
EVENT_COLUMNS = ("log_samples", "top_log_samples", "correlated_anomalies", "recent_deployments")


def scrub_events(events: DataFrame, columns: tuple[str, ...] = EVENT_COLUMNS,
                 count: str = "pii_scrub_count") -> DataFrame:
    """Redact every text field of the list columns and add the replacements to `count`."""
    fields, staged = {}, {}
    for name in columns:
        if name in events.columns:
            kinds = events.schema[name].dataType.elementType.fields
            fields[name] = [f.name for f in kinds]
            texts = [f.name for f in kinds if f.dataType.typeName() == "string"]
            others = [f for f in fields[name] if f not in texts]
            staged[name] = _clean_array(F.col(name), texts, others)
    total = F.coalesce(F.col(count), F.lit(0))
    for name in staged:
        total = total + _sum_n(F.col(f"_clean_{name}"))
    cleaned = events.withColumns({f"_clean_{n}": c for n, c in staged.items()}).withColumns({
        count: total, **{n: _without_n(F.col(f"_clean_{n}"), fields[n]) for n in staged}})
    return cleaned.drop(*[f"_clean_{n}" for n in staged])


def audit(df: DataFrame, text: str) -> DataFrame:
    """Matches by type over all rows, on the original text: (type, matches)."""
    sums = df.agg(*[F.sum(c).cast("bigint").alias(n) for n, c in count_by_type(F.col(text)).items()])
    return sums.unpivot([], list(PATTERNS), "type", "matches")

"""Small scalar helpers used across the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(value: Column) -> Column:
    return value.isNull() | ~value.rlike(r"\S")


def first_present(*candidates: Column, default: str = "") -> Column:
    """First candidate that is neither null nor blank."""
    return F.coalesce(*[F.when(c.rlike(r"\S"), c) for c in candidates], F.lit(default))


def pick(value: Column, table: Mapping[str, str], default: Column | None = None) -> Column:
    """Literal look-up table as a CASE expression."""
    expr = None
    for key, result in table.items():
        expr = F.when(value == key, result) if expr is None else expr.when(value == key, result)
    return expr.otherwise(default) if default is not None else expr


def percent_change(observed: Column, baseline: Column) -> Column:
    """Signed change in percent of the baseline's size; null on a zero baseline."""
    return F.when(baseline != 0, (observed - baseline) / F.abs(baseline) * 100)


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with milliseconds and a Z suffix."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_iso(text: Column) -> Column:
    return F.try_to_timestamp(text)


def daily_index(prefix: str, ts: Column) -> Column:
    """Name of the daily index (UTC day of the timestamp)."""
    return F.concat(F.lit(prefix), F.date_format(ts, "yyyy.MM.dd"))


def message_key(message: Column, chars: int) -> Column:
    """Grouping key for error messages: cut to `chars`, null when blank."""
    return F.when(~is_blank(message), F.substring(message, 1, chars))


def normalise_path(path: Column) -> Column:
    """Collapse UUIDs and numeric segments so that paths group together."""
    uuid = "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    return F.regexp_replace(F.regexp_replace(path, uuid, "{id}"), r"/\d+", "/{id}")


def number_text(value: Column) -> Column:
    """Shortest decimal text of a double, positional between 1e-4 and 1e16."""
    plain = value.cast("string")
    digits = F.regexp_replace(plain.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    positional = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    mantissa = F.regexp_replace(F.split_part(plain, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(plain, F.lit("E"), F.lit(2)).try_cast("int")
    sign = F.when(power < 0, "-").otherwise("+")
    scientific = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    size = F.abs(value)
    return (
        F.when(~plain.contains("E"), plain)
        .when((size >= 1e-4) & (size < 1e16), positional)
        .otherwise(scientific)
    )


def rounded_text(value: Column) -> Column:
    """Whole-number text, ties to even; small negatives keep their sign."""
    whole = F.bround(value, 0).cast("bigint")
    return F.when((value < 0) & (whole == 0), F.lit("-0")).otherwise(whole.cast("string"))

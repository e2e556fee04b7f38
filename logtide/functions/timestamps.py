"""Tolerant timestamp parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtide.functions.scalars import is_blank

# Epoch numbers above this are milliseconds, otherwise seconds.
MILLIS_ABOVE = 1e12


def parse_timestamp(text: Column) -> Column:
    """Timestamp from epoch numbers or date texts; null when nothing matches.

    Date texts are ISO-8601 or `yyyy-MM-dd HH:mm:ss` with a point or comma before the
    fraction and an optional zone; texts without a zone are read as UTC. All of them go
    through one cast, which gives null instead of raising.
    """
    number = F.when(text.rlike(r"^[0-9.]+$"), text.try_cast("double"))
    epoch_ms = F.when(number > MILLIS_ABOVE, number).otherwise(number * 1000).cast("bigint")
    # The plain cast would also read bare times and years, so ask for a full date first.
    dated = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), text)
    pointed = F.regexp_replace(dated, r"^(\S{10} \d{2}:\d{2}:\d{2}),", "$1.")
    return F.coalesce(F.timestamp_millis(epoch_ms), F.try_to_timestamp(pointed))


def event_time(text: Column, ingest_time: Column) -> Column:
    """Parsed time, or the ingest time for missing and unreadable texts."""
    return F.coalesce(F.when(~is_blank(text), parse_timestamp(text)), ingest_time)

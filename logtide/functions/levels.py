"""Log level expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtide.schema import COLLECTOR_LEVELS, LEVEL_SCAN_ORDER, LEVEL_SEVERITY, LEVEL_SPELLINGS


def canonical_level(raw: Column) -> Column:
    """One of the six known levels; anything else, null included, is UNKNOWN."""
    entries = [F.lit(x) for level, spellings in LEVEL_SPELLINGS.items() for s in spellings for x in (s, level)]
    return F.coalesce(F.try_element_at(F.create_map(*entries), F.upper(F.trim(raw))), F.lit("UNKNOWN"))


def severity_num(level: Column) -> Column:
    """Numeric rank of a canonical level."""
    entries = [F.lit(x) for pair in LEVEL_SEVERITY.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), level), F.lit(0))


def is_at_least(level: Column, minimum: str) -> Column:
    return severity_num(level) >= LEVEL_SEVERITY[minimum]


def is_error(level: Column) -> Column:
    return level.isin("ERROR", "CRITICAL")


def collector_level(raw: Column) -> Column:
    """Collector-side spelling: short forms are mapped, unknown levels stay upper-cased."""
    upper = F.upper(raw)
    expr = None
    for short, level in COLLECTOR_LEVELS.items():
        expr = F.when(upper == short, level) if expr is None else expr.when(upper == short, level)
    return expr.otherwise(upper)


def level_in_text(text: Column) -> Column:
    """First level word found in free text, by priority; null when there is none."""
    upper = F.upper(text)
    return F.coalesce(*[
        F.when(upper.rlike(f"(?s)(^|[^A-Z]){word}([^A-Z]|$)"), F.lit(word))
        for word in LEVEL_SCAN_ORDER
    ])

"""Registered queries and their SQL counterparts.

Each family module defines `QUERIES` (name to function of session and table folder) and
`ORACLE` (name to DuckDB SQL over the same tables). Names start with the operator id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    return {name: query for family in _families() for name, query in family.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for family in _families() for name, sql in family.ORACLE.items()}


def _families() -> list:
    from logtide.catalog import (
        alerts, baselines, context, io, monitoring, parsing, reading, reports, windows,
    )

    return [parsing, io, windows, baselines, alerts, context, reports, reading, monitoring]

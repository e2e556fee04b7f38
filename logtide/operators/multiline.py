"""Reassembly of multi-line records such as stack traces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.operators.chunks import running_max_before


@dataclass(frozen=True)
class MultilineRules:
    start: str
    continuation: tuple[str, ...]


# Line patterns.
JAVA_STACK = MultilineRules(
    start=r"^(\d{4}-\d{2}-\d{2}|[A-Z]{3,8}[\s:]|\[\d)",
    continuation=(r"^\s+at ", r"^\s+\.\.\. \d+ more", r"^Caused by:", r"^\t"),
)
PYTHON_STACK = MultilineRules(
    start=r"^(\d{4}-\d{2}-\d{2}|Traceback)",
    continuation=(r"^  File ", r"^\w+Error:", r"^\w+Exception:", r"^\s{4}"),
)


def assemble(lines: DataFrame, rules: MultilineRules = JAVA_STACK, source: str = "source_file",
             line_no: str = "line_no", line: str = "line", chunk_lines: int = 100_000) -> DataFrame:
    """One row per record: (source, first_line, n_lines, log).

    A continuation line joins the record opened by the nearest earlier line that is not a
    continuation, if that line matches the start pattern; all other lines stand alone.
    """
    text = F.col(line)
    joins = text.rlike("|".join(f"(?:{p})" for p in rules.continuation))
    opens = text.rlike(rules.start)
    marked = lines.withColumn("_joins", joins)
    # (line number, opens a record) of every line that is not a continuation.
    anchor = F.when(~F.col("_joins"), F.struct(F.col(line_no).alias("n"), opens.alias("opens")))
    chunk = F.floor(F.col(line_no) / chunk_lines)
    staged = running_max_before(marked, [source], [line_no], chunk, anchor, "_anchor")
    attached = F.col("_joins") & F.coalesce(F.col("_anchor.opens"), F.lit(False))
    owner = F.when(attached, F.col("_anchor.n")).otherwise(F.col(line_no))
    return (
        staged.select(source, owner.alias("first_line"), F.col(line_no).alias("_n"),
                      text.alias("_line"))
        .groupBy(source, "first_line")
        .agg(F.count("*").alias("n_lines"),
             F.array_sort(F.collect_list(F.struct("_n", "_line"))).alias("_lines"))
        .select(source, "first_line", "n_lines",
                F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n").alias("log"))
    )

"""What a task holds beside the heap: Python workers and Arrow batches."""

from __future__ import annotations

import pyarrow as pa

from logtide.llm.common import map_batches
from logtide.llm.line_dedup import drop_repeated_lines


def test_texts_are_cleaned_once(make_docs):
    """A second evaluation for the filter would start a second worker for each task."""
    docs = drop_repeated_lines(make_docs([(1, "a\nb\nc"), (2, "a\nb\nc"), (3, "d")]))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted(r.doc_id for r in docs.collect()) == [1, 3]


def test_long_rows_come_in_small_batches(spark):
    def sizes(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows = spark.range(200).selectExpr("id", "repeat('x', 200000) AS text").coalesce(1)
    found = [r.n for r in map_batches(rows, sizes, "n long").collect()]
    assert sum(found) == 200 and max(found) * 200_000 < 10_000_000

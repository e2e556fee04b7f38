"""Tables that streams write: repeated batches and ties."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from logtide.operators.windows import service_windows
from logtide.settings import WindowSettings
from logtide.sources.writers import archive_batch, latest_rows
from logtide.streaming.jobs import window_batch

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_repeated_archive_batch_adds_nothing(spark, tmp_path):
    path, rows = str(tmp_path / "archive"), [(f"m{i}", T0 + timedelta(minutes=i)) for i in range(200)]
    messages = spark.createDataFrame(rows, "value string, timestamp timestamp")
    body = archive_batch(path, F.col("timestamp"), records=50)
    first, second = messages.where("value < 'm5'"), messages.where("value >= 'm5'")
    for batch_id, batch in [(0, first), (1, second), (1, second), (0, first)]:
        body(batch, batch_id)
    back = spark.read.text(path)
    assert sorted(r.value for r in back.collect()) == sorted(v for v, _ in rows)
    files = {r.file: r.n for r in back.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).collect()}
    assert max(files.values()) <= 50 and all("/year=2024/month=01/day=01/hour=" in f and "/batch=" in f for f in files)


def test_upsert_ties_have_one_winner(spark):
    rows = [("k", 1, "a"), ("k", 1, "b"), ("k", 0, "z"), (None, 1, None), (None, 1, "c")]
    for seed in range(3):
        frame = spark.createDataFrame(rows, "k string, seq int, v string").orderBy(F.rand(seed))
        assert {(r.k, r.v) for r in latest_rows(frame, ["k"], ["seq"]).collect()} == {("k", "b"), (None, None)}


def test_window_batches_in_parts_equal_the_whole(spark, tmp_path):
    """Cells that change are added up again with those of earlier batches, whatever a repeated batch does."""
    from logtide.functions.levels import is_error
    from logtide.functions.scalars import message_key
    from logtide.operators.windows import window_cells

    settings = WindowSettings(size=3_600)
    rows = [(f"s{i % 3}", T0 + timedelta(minutes=i * 7 % 600), ["INFO", "ERROR", "WARNING", "CRITICAL"][i % 4], None if i % 5 == 0 else i * 3 % 40,
             "" if i % 7 == 0 else "prod", f"failed {i % 9}") for i in range(500)]
    logs = spark.createDataFrame(rows, "service string, event_time timestamp, level string, latency_ms bigint, env string, message string")
    said = F.when(is_error(F.col("level")), message_key(F.col("message"), 200))
    body, seen = window_batch(str(tmp_path), settings, final=False), None
    for batch_id, part in enumerate([rows[:200], rows[200:210], rows[210:]]):
        part = spark.createDataFrame(part, logs.schema)
        seen = part if seen is None else seen.unionByName(part)
        changed = window_cells(part, 3_600, said=said).select("service", "window_start", "latency_ms", "env", "said")
        cells = window_cells(seen, 3_600, said=said)
        keys = [cells[c].eqNullSafe(changed[c]) for c in changed.columns]
        for _ in range(2):  # update mode hands on the new totals of what changed
            body(cells.join(changed, keys, "left_semi"), batch_id)
    names = ["service", "window_start", "request_volume", "error_count", "p50_latency_ms", "p99_latency_ms", "avg_latency_ms", "env", "top_errors"]
    got = spark.read.parquet(f"{tmp_path}/windows").select(*names).collect()
    assert sorted(map(str, got)) == sorted(map(str, service_windows(logs, settings).select(*names).collect()))

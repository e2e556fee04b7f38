"""The parts of a stream's input lie in as many files as they have rows for: one file is one task's work."""

from __future__ import annotations

from logtide.catalog import io


def test_a_part_is_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "FILE_ROWS", 10)
    seen = []
    path = f"{tmp_path}/in"
    io.in_batches([spark.range(n).coalesce(1) for n in (95, 5)], path,
                  lambda: seen.append((len(list((tmp_path / "in").glob("part-*"))), spark.read.parquet(path).count())))
    assert seen == [(10, 95), (11, 100)]

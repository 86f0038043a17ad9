"""Files that a batch leaves in the store of articles."""

import os

import pytest

from newsdesk.streaming import ingest


@pytest.mark.parametrize(("days", "least", "most"), [(50, 50, 50), (1, 2, 4), (3, 3, 6)])
def test_a_day_is_not_spread_over_all_tasks(spark, tmp_path, days, least, most):
    """Many days: a file each. Few days: their rows still go to several tasks."""
    rows = spark.range(0, days * 200, 1, 8).selectExpr("cast(id as string) id", f"timestamp_seconds(1767225600 + id % {days} * 86400) published_at")
    store = ingest.Store(spark, str(tmp_path / "articles"), ingest.ddl(rows))
    store.write(rows, 0, days)
    store.write(rows, 0, days)  # again: in place of its own rows
    files = [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")]
    assert least <= len(files) <= most
    assert store.read(1767225600, 1767225600 + days * 86400, 0).count() == days * 200

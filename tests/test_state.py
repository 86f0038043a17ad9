"""Streams that keep state, over several runs from one checkpoint."""

import datetime as dt

from pyspark.sql import functions as F

from newsdesk.operators import summaries
from newsdesk.streaming import ingest, state

BASE = dt.datetime(2026, 3, 1)


def summary(slug, hour, title="t"):
    return (slug, title, "r", "p", "c", BASE + dt.timedelta(hours=hour))


def test_summaries_expire_and_survive_a_restart(spark, tmp_path):
    """Four runs of one stream: newer summaries replace older ones, late ones count for nothing, expired ones leave the state."""
    runs = [
        [summary("a", 0), summary("b", 1, "first"), summary("b", 1, "second"), summary(None, 2), summary("c", 3)],
        [summary("a", 40, "again"), summary("d", 41)],
        [summary("e", 80)],
        [summary("late", 2), summary("f", 200)],
    ]
    source, changes, at = (str(tmp_path / x) for x in ("in", "changes", "state"))
    seen = []
    for rows in runs:
        spark.createDataFrame(rows, ingest.CACHE).coalesce(1).write.mode("append").parquet(source)
        seen += [r for r in rows if r[0]]
        made = spark.readStream.schema(ingest.CACHE).parquet(source)
        state.run_stream(state.keep_summaries(made, 72), changes, at)
        now = max(r[5] for r in seen)
        cache = spark.createDataFrame([r for r in seen if r[0] != "late"], ingest.CACHE)
        want = sorted(map(tuple, summaries.prune_cache(summaries.newest(cache), F.lit(now), 72).select("slug", *summaries.FIELDS, "cached_at").collect()))
        got = sorted(map(tuple, state.summaries_in_state(spark, at).collect()))
        assert got == want, rows
    log = {(r.slug, r.titulo, r.kept) for r in spark.read.parquet(changes).collect()}
    assert ("b", "second", True) in log and ("b", "second", False) in log and not any(slug == "late" for slug, _, _ in log) and ("a", "t", False) not in log


def test_late_articles_show_in_the_metrics_only(spark, tmp_path):
    schema = "id string, source string, published_at timestamp"
    article = lambda k, hour: (str(k), f"s{k % 2}", BASE + dt.timedelta(hours=hour))
    runs = [[article(k, k) for k in range(30)], [article(100, 60), article(101, 1)], [article(102, 200)]]
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "state"))
    late = 0
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = state.run_stream(state.volume_stream(spark.readStream.schema(schema).parquet(source), "6 hours"), out, at)
        late += state.late_rows(query)
    # the watermark stood at hour 23 when article 101 (hour 1) came: windows that had ended by then don't count it
    everyone = spark.createDataFrame([r for rows in runs for r in rows], schema)
    each = everyone.select("id", "source", F.window("published_at", "48 hours", "4 hours").alias("w"))
    timely = each.where((F.col("id") != "101") | (F.col("w.end") > F.lit(BASE + dt.timedelta(hours=23))))
    want = timely.groupBy(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "source").count()
    want = sorted(map(tuple, want.where(F.col("window_end") <= F.lit(BASE + dt.timedelta(hours=194))).collect()))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want and len(want) > 20 and late == 5

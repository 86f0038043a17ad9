"""Queries against their SQL twins on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["normalize_urls", "strip_html", "strip_caption", "date_labels", "dedupe_articles", "niche_filter", "similar_pairs", "entity_guard", "cluster_scope_flags", "stream_summaries", "top_stories", "resolve_summaries", "edition_rows", "topic_hubs", "newsletter", "social_text", "validate_intros", "editorial_unknown_names", "scored_pool", "url_inventory", "feed_items", "edition_archive", "written_editions", "editorial_archive", "summary_state", "stories", "json_ld_pages", "cluster_components", "stream_timely"]


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("documents", "pages", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert got == want


def test_no_python_and_no_cross_join_in_the_ranking(spark):
    plan = entry.queries()["top_stories"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

"""Editions as a stream of batches against the plain build: results, what a batch reads, batches that are run again."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from test_build import PARAMS, SF, Plain, shown, stamp

from newsdesk.operators import articles as art
from newsdesk.plans import adapter, archive_queries
from newsdesk.sources.archive import Versions
from newsdesk.streaming import ingest

tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
STEP = 4 * 3600
responses = lambda rows: archive_queries._answers(rows)[1]


def at(seconds):
    return dt.datetime.fromtimestamp(seconds)


class PlainStream:
    """The stream's rules, batch by batch, over the plain build."""

    def __init__(self, plain):
        self.plain, self.known, self.cache, self.last, self.days = plain, set(), {}, None, {}

    def batch(self, rows):
        times = [r.published_at.timestamp() for r in rows]
        first, last = -(-(min(times) - 3600) // STEP) * STEP, max(times) // STEP * STEP
        if self.last is not None:
            first, last = min(first, self.last + STEP), max(last, self.last)
        self.known |= {r.id for r in rows}
        fresh = {}
        for k in range(int((last - first) // STEP) + 1):
            run = at(first + k * STEP)
            found, made = self.plain.edition(run, self.cache, self.known)
            if found:
                self.days[(run - dt.timedelta(hours=3)).date()] = {(stamp(run), *key): s for key, s in found.items()}
            fresh |= made
        self.cache = {k: v for k, v in (self.cache | fresh).items() if v[0] >= at(last) - dt.timedelta(hours=72)}
        self.last = last

    def editions(self):
        return {k: s for day in self.days.values() for k, s in day.items()}


@tables
def test_stream_editions_is_the_plain_build(spark):
    """The registered query: the whole table arrives in one batch."""
    adapter.start()
    articles = adapter.firsts(spark, SF)
    stream = PlainStream(Plain(articles))
    stream.batch(articles.collect())
    got = archive_queries.stream_editions(spark, SF).collect()
    assert len(got) > 10 and shown(got) == stream.editions()


@tables
def test_batches_against_the_plain_build(spark, tmp_path):
    """Five batches, one of them late; then a batch that is run again, and one without articles, change nothing."""
    adapter.start()
    articles = adapter.firsts(spark, SF).cache()
    stream = PlainStream(Plain(articles))
    run = ingest.edition_builder(*(str(tmp_path / x) for x in ("articles", "editions", "state")), responses, PARAMS)
    late = "item_rank between 20 and 24"
    parts = [f"item_rank < 60 and not ({late})", "item_rank between 60 and 99", late, "item_rank between 100 and 170", "item_rank > 170"]
    written = lambda: shown(archive_queries._shown(spark.read.parquet(str(tmp_path / "editions"))).collect())
    state = Versions(spark, str(tmp_path / "state"), ingest.CACHE)
    kept = lambda: sorted(map(tuple, state.before(99)[0].collect()))
    for number, part in enumerate(parts):
        run(articles.where(part), number)
        stream.batch(articles.where(part).collect())
        assert written() == stream.editions(), number
        assert {r[0]: (r[5], *r[1:5]) for r in kept()} == stream.cache and stream.cache
    once, summaries = written(), kept()
    run(articles.where(parts[4]), 4)
    run(articles.limit(0), 5)
    assert written() == once and kept() == summaries


def test_a_batch_reads_its_days_alone(spark, tmp_path):
    """Over batches of a day each, rows read and summaries kept stay flat."""
    base = dt.datetime(2026, 3, 1)
    run = ingest.edition_builder(*(str(tmp_path / x) for x in ("articles", "editions", "state")), responses, PARAMS)
    docs = spark.createDataFrame([(k, f"ention {chr(97 + k % 26) * 3} numero{k}x. Resto do texto {k}", f"src{k % 3}", "pt") for k in range(60)], "doc_id long, text string, source string, lang string")
    articles = art.items_to_articles(adapter.items_of(docs)).withColumn("published_at", F.timestamp_seconds(F.lit(int(base.timestamp())) + F.col("item_rank") * 7200)).cache()
    state = Versions(spark, str(tmp_path / "state"), ingest.CACHE)
    read, kept = [], []
    for number in range(5):
        run(articles.where(f"item_rank between {number * 12} and {number * 12 + 11}"), number)
        note = state.manifest()[number]
        read.append(note["rows_read"])
        kept.append(note["summaries"])
    assert max(read[3:]) - min(read[3:]) <= 2 and max(read) < 60
    assert max(kept[3:]) - min(kept[3:]) <= 6 and sorted(state.manifest()) == list(range(5))


def test_versions(spark, tmp_path):
    state = Versions(spark, str(tmp_path), "slug string", keep=2)
    assert state.before(0)[1] == {} and state.before(0)[0].count() == 0
    for k in range(5):
        state.write(spark.createDataFrame([(f"s{k}",)], "slug string"), k, {"k": k})
    assert sorted(state.manifest()) == [2, 3, 4] and state.before(4)[0].first().slug == "s3" and state.before(4)[1] == {"k": 3}
    assert len(os.listdir(tmp_path / "version")) == 3

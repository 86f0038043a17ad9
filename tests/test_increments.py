"""Catalog and topics by deltas against one rebuild."""

import datetime as dt
import random

from pyspark.sql import functions as F

from newsdesk.operators import catalog, topics
from newsdesk.operators.increments import StoryIndex

SCHEMA = "date date, section string, section_rank int, story_rank int, slug string, titulo string, updated_at timestamp"
NAMES = ("Maria Souza", "Porto Alegre", "Rio Grande", "Enchente no Sul", "José Lima")


def edition(day, rng, stories=6):
    """Home and a section; stories stay over days, under titles that change."""
    date, rows = dt.date(2026, 3, day), []
    for k in range(stories):
        n = max(0, day - rng.randrange(3)) * 10 + rng.randrange(4)
        title = f"{rng.choice(NAMES)} e {rng.choice(NAMES)} {day if rng.random() < 0.5 else ''}".strip()
        row = (f"s{n}", title, dt.datetime(2026, 3, day, rng.randrange(24)))
        if row[0] not in {r[4] for r in rows}:
            rows += [(date, "home", 0, k + 1, *row)] + [(date, "geral", 1, k + 1, row[0], row[1] + " ali", row[2])] * (k % 2)
    return rows


def test_editions_one_by_one_are_one_rebuild(spark, tmp_path):
    """Six editions one by one; one of them is withdrawn and replaced later, one is withdrawn for good, one is applied twice."""
    rng = random.Random(9)
    index = StoryIndex(spark, str(tmp_path), SCHEMA, buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    archive = {}

    def check():
        rows = frame([r for day in archive.values() for r in day])
        last = max(archive)
        whole = catalog.catalog(rows.withColumn("is_current", F.dayofmonth("date") == last)).drop("is_current")
        bridge = topics.topic_stories(whole.select("slug", "titulo", "updated_at").withColumn("story_rank", -F.col("updated_at").cast("long")))
        for got, want in ((index.catalog(), whole), (index.topics(), topics.build_topics(bridge))):
            got, want = sorted(map(tuple, got.select(*want.columns).collect())), sorted(map(tuple, want.collect()))
            assert got == want and len(want) > 1

    days = [*range(1, 7)]
    for day in days:
        archive[day] = edition(day, rng)
        index.apply(frame(archive[day]))
    check()
    old, archive[3] = archive[3], edition(3, rng)
    index.apply(frame(archive[3]), frame(old))
    gone = archive.pop(6)
    index.apply(frame([]), frame(gone))
    index.apply(frame(archive[5]), frame(archive[5]))
    check()

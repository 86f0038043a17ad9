"""The periodic job as a stream: items in, deduplicated articles and editions out."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.operators import summaries
from newsdesk.operators.articles import dedupe_by_url, items_to_articles
from newsdesk.operators.build import build, last_of_day
from newsdesk.operators.graph import checkpoint
from newsdesk.params import Params
from newsdesk.sources.archive import Versions, write_editions

ddl = lambda rows: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
CACHE = "slug string, titulo string, resumo string, por_que_importa string, categoria string, cached_at timestamp"


def stream_articles(items: DataFrame, window: str = "48 hours", ahead_hours: int = 1) -> DataFrame:
    """Articles of a stream of items, each id once within the window.

    Items dated more than `ahead_hours` after they were fetched go before the watermark sees them: one of them
    would move it and drop good ones. State is bounded by the watermark.
    """
    articles = items_to_articles(items)
    timely = articles.where(F.col("published_at").cast("double") <= F.col("fetched_at").cast("double") + 3600 * ahead_hours)
    return timely.withWatermark("published_at", window).dropDuplicatesWithinWatermark(["id"])


def sliding_volume(articles: DataFrame, length: str = "48 hours", step: str = "4 hours") -> DataFrame:
    """(window_start, window_end, source, n): articles per sliding window and source; works on streams and tables."""
    counted = articles.groupBy(F.window("published_at", length, step), "source").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "source", "n")


class Store:
    """Articles by publication day (UTC) and batch. Reading some days lists and reads these alone, however long the history is."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def write(self, rows: DataFrame, number: int, days: int = 1) -> None:
        """Under the batch's number: a batch that is written again replaces its own rows. A day goes to one task, or, where
        the batch has fewer `days` than there are tasks, to as many as share them: not to a file in each."""
        rows = rows.withColumns({"day": F.to_date("published_at"), "batch": F.lit(number).cast("long")})
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(tasks, "day", F.pmod(F.xxhash64("id"), F.lit(math.ceil(tasks / max(1, days)))))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.path)

    def read(self, first: float, last: float, number: int) -> DataFrame:
        """Articles published from `first` to `last` (in seconds), of the batches up to `number`."""
        hadoop, n = self.spark._jvm.org.apache.hadoop.fs, 24 * 3600
        days = (dt.date.fromordinal(719163 + k) for k in range(math.floor(first / n), math.floor(last / n) + 1))  # 719163: 1970-01-01
        paths = [f"{self.path}/day={d}" for d in days]
        fs = hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = [at for at in paths if fs.exists(hadoop.Path(at))]
        if not there:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, day date, batch long").option("basePath", self.path).parquet(*there)
        at = F.col("published_at").cast("double")
        return rows.where((F.col("batch") <= number) & (at >= first) & (at <= last)).drop("day", "batch")


def edition_builder(articles_path: str, editions_path: str, state_path: str, responses: Callable[[DataFrame], DataFrame], p: Params = Params()) -> Callable[[DataFrame, int], None]:
    """A `build` for start_editions(). Each batch's articles join the store. The runs that are due by the newest article
    seen and have not been built, or that an article of the batch reaches, are built from the articles of their windows
    and replace their days in the archive. The summaries are a table in versions: the state after a batch is the one
    before it and what the batch generated, pruned to `prune_hours` before the last due run. So a batch reads the days
    that it reaches and the stories of the last days, and a batch that is run again changes nothing.

    responses: from articles to (slug, summary fields).
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, step = batch.sparkSession, 3600 * p.cluster.every_hours
        window, ahead = 3600 * p.cluster.window_hours, 3600 * p.cluster.ahead_hours
        state, store = Versions(spark, state_path, CACHE), Store(spark, articles_path, ddl(batch))
        at = F.col("published_at").cast("double")
        oldest, newest = batch.agg(F.min(at), F.max(at)).first()  # two values
        store.write(batch, number, 1 if oldest is None else math.ceil((newest - oldest) / (24 * 3600)) + 1)
        if oldest is None:
            return
        cache, before = state.before(number)
        last = max(math.floor(newest / step) * step, before.get("last", -math.inf))
        first = math.ceil((oldest - ahead) / step) * step
        if before:
            first = min(first, before["last"] + step)
        stored = store.read(first - window, last + ahead, number)
        known = checkpoint(dedupe_by_url(stored))
        found = build(known, cache, responses(known), p, first, last)
        write_editions(last_of_day(found.rows), editions_path)
        both = cache.unionByName(summaries.generated(found.resolved, F.col("edition_ts")))
        kept = summaries.prune_cache(summaries.newest(both), F.timestamp_seconds(F.lit(last)), p.summary.prune_hours)
        state.write(kept, number, {"first": first, "last": last, "rows_read": stored.count(), "summaries": kept.count()})

    return run


def start_editions(articles: DataFrame, build: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs `build` on each micro-batch of whatever has arrived, then stops. `build` must be idempotent: write editions
    with write_editions() and the cache keyed by slug."""
    return articles.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Catalog and topics kept up to date by the story rows that editions add and withdraw, without reading the archive again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.operators.graph import checkpoint
from newsdesk.operators.topics import build_topics, topic_stories
from newsdesk.params import Lexicon

BRIDGE = "topic_slug string, story_slug string, label string, story_rank long, at int, updated_at timestamp"
TOPICS = "slug string, label string, n_stories long, first_seen struct<story_rank: bigint, at: int>, indexable boolean"


class Buckets:
    """A table in `n` partitions by the hash of a key, of which some are read and replaced at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, n: int):
        self.spark, self.path, self.schema, self.key, self.n = spark, path.rstrip("/"), schema, key, n
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _bucket(self, key: str) -> F.Column:
        return F.pmod(F.xxhash64(key), F.lit(self.n)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of (key): at most `n` numbers."""
        return sorted(r[0] for r in keys.select(self._bucket(self.key)).distinct().collect())

    def read(self, ids: list[int] | None = None) -> DataFrame:
        there = [at for at in (f"{self.path}/bucket={k}" for k in (range(self.n) if ids is None else ids)) if self._fs.exists(self._hadoop.Path(at))]
        if not there:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(f"{self.schema}, bucket int").option("basePath", self.path).parquet(*there).drop("bucket")

    def replace(self, rows: DataFrame, ids: list[int]) -> DataFrame:
        """Makes `rows` the content of the buckets `ids`."""
        rows = checkpoint(rows)  # it is made of what it replaces
        full = rows.withColumn("bucket", self._bucket(self.key))
        full.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for k in set(ids) - {r[0] for r in full.select("bucket").distinct().collect()}:  # buckets that have lost all rows
            self._fs.delete(self._hadoop.Path(f"{self.path}/bucket={k}"), True)
        return rows


class StoryIndex:
    """The catalog (one row a slug: the newest edition's, home before sections) and the topics of its titles.

    It keeps all versions of a story by slug, the chosen one, the stories of each topic, and each topic's row, in buckets;
    a delta reads and replaces the buckets of the slugs and topics that it changes. A delta applied again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, lexicon: Lexicon = Lexicon(), buckets: int = 64):
        """schema: of edition rows (DDL), with slug, date, section, section_rank, story_rank, titulo and updated_at."""
        self.lexicon = lexicon
        self.versions = Buckets(spark, f"{path}/versions", schema, "slug", buckets)
        self.stories = Buckets(spark, f"{path}/stories", schema, "slug", buckets)
        self.bridge = Buckets(spark, f"{path}/bridge", BRIDGE, "topic_slug", buckets)
        self.all_topics = Buckets(spark, f"{path}/topics", TOPICS, "slug", buckets)

    def apply(self, added: DataFrame, withdrawn: DataFrame | None = None) -> None:
        """added: whole edition days; withdrawn: what the archive held of days that these replace, or that are gone."""
        names = self.versions.read([]).columns
        added = checkpoint(added.select(*names))
        withdrawn = added.limit(0) if withdrawn is None else withdrawn.select(*names)
        places = checkpoint(added.select("slug", "date").unionByName(withdrawn.select("slug", "date")).distinct())
        slugs = places.select("slug").distinct()
        ids = self.versions.touched(slugs)
        if not ids:
            return
        versions = self.versions.read(ids).join(places, ["slug", "date"], "left_anti").unionByName(added)
        versions = self.versions.replace(versions, ids).join(slugs, "slug", "left_semi")
        order = F.struct((-F.unix_date("date")).alias("a"), (F.col("section") != "home").alias("b"), "section_rank", "story_rank")
        rest = [c for c in names if c != "slug"]
        new = checkpoint(versions.groupBy("slug").agg(F.min_by(F.struct(*rest), order).alias("row")).select("slug", "row.*").select(*names))
        before = self.stories.read(ids)
        old = checkpoint(before.join(slugs, "slug", "left_semi"))
        self.stories.replace(before.join(slugs, "slug", "left_anti").unionByName(new), ids)
        self._topics(old, new)

    def _topics(self, old: DataFrame, new: DataFrame) -> None:
        said = lambda rows: rows.select("slug", "titulo", "updated_at")
        gone, come = (self._bridge(one.exceptAll(other)) for one, other in ((said(old), said(new)), (said(new), said(old))))
        topics = checkpoint(gone.select("topic_slug").unionByName(come.select("topic_slug")).distinct())
        ids = self.bridge.touched(topics)
        if not ids:
            return
        bridge = self.bridge.read(ids).join(gone, ["topic_slug", "story_slug"], "left_anti")
        bridge = self.bridge.replace(bridge.join(come, ["topic_slug", "story_slug"], "left_anti").unionByName(come), ids)
        counted = build_topics(bridge.join(topics, "topic_slug", "left_semi"), least=1)
        rest = self.all_topics.read(ids).join(topics.select(F.col("topic_slug").alias("slug")), "slug", "left_anti")
        self.all_topics.replace(rest.unionByName(counted), ids)

    def _bridge(self, stories: DataFrame) -> DataFrame:
        return checkpoint(topic_stories(stories.withColumn("story_rank", -F.col("updated_at").cast("long")), self.lexicon))

    def catalog(self) -> DataFrame:
        return self.stories.read()

    def topics(self, least: int = 2) -> DataFrame:
        return self.all_topics.read().where(F.col("n_stories") >= least)

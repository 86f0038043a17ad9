"""Landed feed files as tables of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MEDIA = "array<struct<_url:string,_medium:string,_type:string>>"
RSS = (
    "title string, link string, pubDate string, description string, `content:encoded` string, enclosure struct<_url:string,_type:string>, "
    f"`media:content` {_MEDIA}, `media:thumbnail` struct<_url:string>"
)
ATOM = ("title string, link array<struct<_href:string,_rel:string>>, updated string, published string, summary string, content string")
ITEMS = (
    "feed_rank int, item_rank long, source string, fetched_at timestamp, title string, link string, isoDate string, pubDate string, contentSnippet string, "
    "content string, summary string, enclosure struct<url:string,type:string>, mediaContent array<struct<url:string,medium:string,type:string>>, mediaThumbnail struct<url:string>"
)


def read_rss(spark: SparkSession, path: str, fetched_at: F.Column) -> DataFrame:
    """Items of RSS files; UTF-8. The file's name says which feed it is, see with_sources()."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(RSS).load(path)
    return raw.select(
        F.input_file_name().alias("file"),
        fetched_at.alias("fetched_at"),
        "title",
        "link",
        F.lit(None).cast("string").alias("isoDate"),
        "pubDate",
        F.col("description").alias("contentSnippet"),
        F.coalesce("content:encoded", "description").alias("content"),
        F.lit(None).cast("string").alias("summary"),
        F.col("enclosure").cast("struct<url:string,type:string>").alias("enclosure"),
        F.col("media:content").cast("array<struct<url:string,medium:string,type:string>>").alias("mediaContent"),
        F.col("media:thumbnail").cast("struct<url:string>").alias("mediaThumbnail"),
    )


def read_atom(spark: SparkSession, path: str, fetched_at: F.Column) -> DataFrame:
    """Entries of Atom files, in the columns of read_rss(); the link without a rel or with rel=alternate."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path)
    link = F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    return raw.select(
        F.input_file_name().alias("file"),
        fetched_at.alias("fetched_at"),
        "title",
        link.alias("link"),
        F.coalesce("published", "updated").alias("isoDate"),
        F.lit(None).cast("string").alias("pubDate"),
        F.coalesce("summary", "content").alias("contentSnippet"),
        "content",
        "summary",
        F.lit(None).cast("struct<url:string,type:string>").alias("enclosure"),
        F.lit(None).cast("array<struct<url:string,medium:string,type:string>>").alias("mediaContent"),
        F.lit(None).cast("struct<url:string>").alias("mediaThumbnail"),
    )


def with_sources(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds source, feed_rank and item_rank. sources: (feed_rank, name, file_name); item_rank is the order in the file."""
    name = F.element_at(F.split("file", "/"), -1)
    listed = sources.select(F.col("feed_rank"), F.col("name").alias("source"), F.col("file_name"))
    rows = items.withColumn("item_rank", F.monotonically_increasing_id()).withColumn("file_name", name)
    return rows.join(F.broadcast(listed), "file_name").drop("file", "file_name")  # a list of feeds

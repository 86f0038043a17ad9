"""The driver's tables as feed items, articles, stories and editions.

Documents stand for feed items: the title is the text up to the first full stop or line break, every tenth item
shares the URL of the one before it, items are five minutes apart. The text is invented, so the word lists are too.
twins.py says the same in SQL.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.functions import dates, text
from newsdesk.operators import articles as art
from newsdesk.operators import editions
from newsdesk.params import Lexicon
from newsdesk.shared import shared_dir

LEXICON = Lexicon(
    standalone=("ention", "eeau", "elle"),
    ambiguous=("eaux", "edin", "heer"),
    damage=("inst", "hast", "ates"),
    stopwords=("the", "and", "that", "was", "for", "with", "this", "are", "from", "tion", "ing"),
)
CATEGORIES = ("Enchente", "Acidente de trânsito", "Geral", "Incêndio", " ")
START = 1704067200  # 2024-01-01


_kept: dict[tuple[str, str], DataFrame] = {}


def start() -> None:
    """A query begins: nothing is kept from the one before."""
    _kept.clear()


def kept(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Within a query, a table that many branches read is computed once and written to the shared folder."""

    @functools.wraps(make)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (make.__name__, sf_dir)
        if key not in _kept:
            rows, at = make(spark, sf_dir), f"{shared_dir(spark)}/news-{uuid.uuid4().hex}/{make.__name__}"
            rows.write.option("compression", "zstd").parquet(at)
            _kept[key] = spark.read.schema(rows.schema).parquet(at)
        return _kept[key]

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang")


def spread(rows: DataFrame) -> DataFrame:
    """A table of few files may be read by one task alone; its rows go to all cores before work on their texts."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * len(rows.inputFiles()) < cores else rows


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_of(spread(documents(spark, sf_dir)))


def items_of(docs: DataFrame) -> DataFrame:
    """Works on a stream of documents too."""
    d = F.col("doc_id")
    pub = F.timestamp_seconds(F.lit(START) + d * 300)
    iso = F.when(d % 13 == 5, "no date").when(d % 7 != 3, F.date_format(pub, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    image = lambda kind, end: F.concat(F.lit(f"https://img.example.com/{kind}"), d.cast("string"), F.lit(end))
    return docs.select(
        F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("feed_rank"),
        d.alias("item_rank"),
        "source",
        F.timestamp_seconds(F.lit(START + 600) + d * 300).alias("fetched_at"),
        F.regexp_extract("text", r"^[^.\n]*", 0).alias("title"),
        F.concat(F.lit("https://www.news.example.com/n/"), (d - (d % 10 == 9).cast("int")).cast("string"), F.lit("/?utm_source="), "source", F.lit("#t")).alias("link"),
        iso.alias("isoDate"),
        dates.rfc1123(pub).alias("pubDate"),
        F.col("text").alias("contentSnippet"),
        F.when(d % 11 == 0, F.concat(F.lit('<p><IMG class="a" src="'), image("h", ".gif"), F.lit('"></p>'))).alias("content"),
        F.lit(None).cast("string").alias("summary"),
        F.when(d % 5 == 0, F.struct(image("e", ".png?w=1").alias("url"), F.lit(None).cast("string").alias("type"))).alias("enclosure"),
        F.when(d % 3 == 0, F.array(F.struct(image("t", ".txt").alias("url"), F.lit("document").alias("medium"), F.lit(None).cast("string").alias("type")), F.struct(image("m", "").alias("url"), F.lit("image").alias("medium"), F.lit(None).cast("string").alias("type")))).alias("mediaContent"),
        F.when(d % 17 == 0, F.struct(image("n", ".jpg").alias("url"))).alias("mediaThumbnail"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return art.items_to_articles(items(spark, sf_dir))


@kept
def firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return art.dedupe_by_url(articles(spark, sf_dir))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as members of clusters: one cluster for each edition day and hundredth of an article's number."""
    from pyspark.sql import Window

    key = ["date", "bucket"]
    rows = firsts(spark, sf_dir).withColumn("date", dates.edition_date(F.col("published_at"))).withColumn("bucket", F.col("item_rank") % 100 % 7)
    order = Window.partitionBy(*key).orderBy(F.col("published_at").desc(), "id")
    rows = rows.withColumn("member_rank", F.row_number().over(order))
    oldest = Window.partitionBy(*key).orderBy("published_at", "norm_url")
    return rows.withColumn("is_anchor", F.row_number().over(oldest) == 1)


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every first article is a story of its day; every third is in the next day's edition again, retitled."""
    from pyspark.sql import Window

    n = F.col("item_rank")
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (n % 5 + 1).cast("int"))
    once = firsts(spark, sf_dir).select(
        F.col("id").alias("slug"),
        F.substring(F.sha1(F.concat(F.lit("c"), "id").cast("binary")), 1, 16).alias("cluster_id"),
        F.col("title").alias("titulo"),
        F.col("description").alias("resumo"),
        F.when(n % 4 == 0, "").otherwise(F.substring("description", 1, 120)).alias("por_que_importa"),
        category.alias("categoria"),
        text.category_slug(category).alias("categoria_slug"),
        F.array(F.struct(F.col("source").alias("name"), F.col("url"))).alias("sources"),
        "image_url",
        F.col("published_at").alias("updated_at"),
        dates.edition_date(F.col("published_at")).alias("date"),
        n.alias("n"),
    )
    again = once.where("n % 3 = 0").withColumn("date", F.date_add("date", 1)).withColumn("titulo", F.concat("titulo", F.lit(" (2)")))
    order = Window.partitionBy("date").orderBy(F.col("updated_at").desc(), "slug")
    return once.unionByName(again).withColumn("rank", F.row_number().over(order)).drop("n")


@kept
def edition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edition rows of all days; the last day is current."""
    rows = editions.edition_rows(stories(spark, sf_dir), "date")
    last = rows.agg(F.max("date").alias("last"))
    return rows.join(F.broadcast(last)).withColumn("is_current", F.col("date") == F.col("last")).drop("last")  # one row

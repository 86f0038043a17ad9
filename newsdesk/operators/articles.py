"""Feed items to articles: projection, image, first occurrence, niche filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.functions import text
from newsdesk.functions.dates import parse_date
from newsdesk.functions.urls import article_id, normalize_url
from newsdesk.params import Lexicon

# What an image's URL ends in, and where an HTML image has its URL.
IMAGE = r"(?i)\.(jpe?g|png|webp|gif|avif)(\?|$)"
IMG_SRC = r"(?i)<img[^>]+src=[\"']([^\"']+)[\"']"


def extract_image() -> Column:
    """The item's thumbnail, else its first image among the media, the enclosure and the HTML."""
    given = lambda url: F.nullif(url, F.lit(""))
    shows = lambda m: given(m["url"]).isNotNull() & (
        F.coalesce(m["medium"] == "image", F.lit(False)) | F.coalesce(m["type"].startswith("image/"), F.lit(False)) | m["url"].rlike(IMAGE)
    )
    enclosed = F.col("enclosure.url")
    is_image = F.coalesce(F.col("enclosure.type").startswith("image/"), F.lit(False)) | enclosed.rlike(IMAGE)
    html = F.coalesce("content", "summary", F.lit(""))
    return F.coalesce(
        given(F.col("mediaThumbnail.url")),
        F.get(F.filter("mediaContent", shows), F.lit(0))["url"],
        F.when(is_image, given(enclosed)),
        given(F.regexp_extract(html, IMG_SRC, 1)),
    )


def items_to_articles(items: DataFrame, most: int = 600) -> DataFrame:
    """One article for each item with a title and a link; other columns of the items stay out."""
    snippet = F.coalesce("contentSnippet", "summary", "content", "title", F.lit(""))
    rows = items.select(
        text.trim(F.coalesce("link", F.lit(""))).alias("url"),
        "source",
        text.strip_html(F.coalesce("title", F.lit(""))).alias("title"),
        text.strip_html(snippet).alias("body"),
        extract_image().alias("image_url"),
        parse_date(F.col("isoDate"), F.col("pubDate"), F.col("fetched_at")).alias("published_at"),
        "fetched_at",
        "feed_rank",
        "item_rank",
    ).where("url != '' and title != ''")
    rows = rows.withColumn("body", text.strip_caption(F.col("body"))).withColumn("norm_url", normalize_url(F.col("url")))
    return rows.select(
        article_id(F.col("norm_url"), normalised=True).alias("id"),
        "url",
        "norm_url",
        "source",
        "title",
        text.truncate(F.col("body"), most).alias("description"),
        "image_url",
        "published_at",
        "fetched_at",
        "feed_rank",
        "item_rank",
    )


def dedupe_by_url(articles: DataFrame) -> DataFrame:
    """The first occurrence of each id, by feed and item order. An aggregate: copies combine before the shuffle."""
    rest = [c for c in articles.columns if c != "id"]
    first = F.min_by(F.struct(*rest), F.struct("feed_rank", "item_rank"))
    return articles.groupBy("id").agg(first.alias("row")).select("id", "row.*")


def first_by_window(rows: DataFrame, key: list, order: list) -> DataFrame:
    """First row of each key in the given order, for narrow rows."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def with_niche_flags(articles: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds standalone, ambiguous and damage: whether the folded title and description hold a term of the list; and
    `edges`: the front and back of that text, as long as a term that goes on in another text can reach into it."""
    hay = text.fold(F.concat_ws(" ", "title", "description"))
    flags = articles.withColumn("_hay", hay)
    for name in ("standalone", "ambiguous", "damage"):
        flags = flags.withColumn(name, text.contains_any(F.col("_hay"), getattr(lexicon, name)))
    reach = longest(lexicon) - 1
    return flags.withColumn("edges", F.struct(F.left("_hay", F.lit(reach)).alias("front"), F.right("_hay", F.lit(reach)).alias("back"))).drop("_hay")


def longest(lexicon: Lexicon) -> int:
    """Characters of the longest term that clusters are searched for, 2 at least."""
    return max(2, *map(len, (*lexicon.standalone, *lexicon.damage)))


def filter_niche(articles: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Articles with a standalone term, or an ambiguous one backed by a damage term."""
    return with_niche_flags(articles, lexicon).where("standalone or (ambiguous and damage)").drop("standalone", "ambiguous", "damage", "edges")

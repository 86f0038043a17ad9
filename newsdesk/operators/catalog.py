"""The archive of editions as a catalog of stories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edition_stories(rows: DataFrame, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Distinct stories of each edition by slug, home first."""
    rest = [c for c in rows.columns if c not in (*keys, "slug")]
    order = F.struct((F.col("section") != "home").alias("a"), "section_rank", "story_rank")
    return rows.groupBy(*keys, "slug").agg(F.min_by(F.struct(*rest), order).alias("row")).select(*keys, "slug", "row.*")


def catalog(rows: DataFrame) -> DataFrame:
    """One row per slug: the current edition's version, else the newest edition's, home before sections.

    rows: edition rows with date and is_current. An aggregate, so re-publications combine before the shuffle.
    """
    rest = [c for c in rows.columns if c != "slug"]
    order = F.struct((~F.col("is_current")).alias("a"), (-F.unix_date("date")).alias("b"), (F.col("section") != "home").alias("c"), "section_rank", "story_rank")
    return rows.groupBy("slug").agg(F.min_by(F.struct(*rest), order).alias("row")).select("slug", "row.*")


def categories(rows: DataFrame) -> DataFrame:
    """(categoria_slug, label): the label of the newest edition that has the category."""
    sections = rows.where("section != 'home'")
    order = F.struct((~F.col("is_current")).alias("a"), (-F.unix_date("date")).alias("b"), F.col("section_rank"))
    return sections.groupBy(F.col("section").alias("categoria_slug")).agg(F.min_by("section_label", order).alias("label"))


def latest_per(stories: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` newest stories of each `key`, with their rank; ties by slug."""
    order = Window.partitionBy(key).orderBy(F.col("updated_at").desc_nulls_last(), "slug")
    return stories.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def related(stories: DataFrame, most: int = 6) -> DataFrame:
    """(slug, related_slug, rank): the newest other stories of a story's category.

    Each category's `most` + 1 newest are joined to its stories: linear in the stories, whatever a category's size.
    """
    top = latest_per(stories, "categoria_slug", most + 1).select("categoria_slug", F.col("slug").alias("related_slug"), F.col("rank").alias("r"))
    listed = top.groupBy("categoria_slug").agg(F.array_sort(F.collect_list(F.struct("r", "related_slug"))).alias("top"))
    rows = stories.select("slug", "categoria_slug").join(listed, "categoria_slug")
    others = F.slice(F.filter("top", lambda x: x["related_slug"] != F.col("slug")), 1, most)
    return rows.select("slug", F.posexplode(others).alias("at", "x")).select("slug", "x.related_slug", (F.col("at") + 1).alias("rank"))


def first_image(stories: DataFrame, key: str, order: str) -> DataFrame:
    """(key, image_url): the share image of a list, its first story's that has one."""
    return stories.where("image_url is not null").groupBy(key).agg(F.min_by("image_url", order).alias("image_url"))

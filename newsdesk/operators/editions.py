"""Stories, sections and editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.functions import text
from newsdesk.params import FALLBACK_CATEGORY


def story_sources(members: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, sources): one (name, url) per source name, the anchor's first, then in member order. members has is_anchor."""
    order = F.struct((~F.col("is_anchor")).alias("later"), F.col("member_rank").alias("rank"))
    firsts = members.groupBy(*keys, "source").agg(F.min(F.struct(order.alias("o"), F.col("url"))).alias("m"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("m.o"), F.col("source").alias("name"), F.col("m.url").alias("url"))))
    return firsts.groupBy(*keys).agg(F.transform(listed, lambda x: F.struct(x["name"].alias("name"), x["url"].alias("url"))).alias("sources"))


def story_image(members: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, image_url): the anchor's image, else the first member's that has one."""
    has = F.col("image_url").isNotNull()
    return members.groupBy(*keys).agg(F.min_by("image_url", F.when(has, F.struct(~F.col("is_anchor"), F.col("member_rank")))).alias("image_url"))


def to_stories(resolved: DataFrame, stats: DataFrame, sources: DataFrame, images: DataFrame) -> DataFrame:
    """Story rows of clusters: summary, category slug, sources, image, last update."""
    keys = ["edition_ts", "slug"]
    rows = resolved.join(stats.select(*keys, "cluster_id", F.col("latest_at").alias("updated_at")), keys).join(sources, keys).join(images, keys, "left")
    return rows.withColumn("categoria_slug", text.category_slug(F.col("categoria")))


def promote_imaged(stories: DataFrame, key: str, order: str = "rank") -> DataFrame:
    """If an edition's first story has no image, its first story with one moves to the top; the others keep their order."""
    whole = Window.partitionBy(key)
    first = F.min(F.when(F.col("image_url").isNotNull(), F.col(order))).over(whole)
    rows = stories.withColumn("_first", first)
    new = F.row_number().over(Window.partitionBy(key).orderBy((F.col(order) != F.coalesce("_first", F.lit(-1))).cast("int"), order))
    return rows.withColumn(order, new).drop("_first")


def sections(stories: DataFrame, key: str, order: str = "rank") -> DataFrame:
    """Story rows with their section: category slug, the label of its first story, section_rank (size, then first
    appearance) and story_rank within it."""
    per = stories.groupBy(key, "categoria_slug").agg(
        F.count("*").alias("section_size"), F.min_by("categoria", order).alias("section_label"), F.min(order).alias("_first")
    )
    per = per.withColumn("section_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("section_size").desc(), "_first"))).drop("_first")
    rows = stories.join(per, [key, "categoria_slug"])
    return rows.withColumn("story_rank", F.row_number().over(Window.partitionBy(key, "categoria_slug").orderBy(order)))


def edition_rows(stories: DataFrame, key: str, home: int = 10, order: str = "rank") -> DataFrame:
    """Long form of editions: section 'home' (the first `home` stories, image promoted) and every category's section."""
    keep = [c for c in stories.columns if c != order]
    top = promote_imaged(stories.where(F.col(order) <= home), key, order)
    home_rows = top.select(*keep, F.lit("home").alias("section"), F.lit(None).cast("string").alias("section_label"), F.lit(0).alias("section_rank"), F.col(order).alias("story_rank"))
    by_section = sections(stories, key, order).select(*keep, F.col("categoria_slug").alias("section"), "section_label", "section_rank", "story_rank")
    return home_rows.unionByName(by_section)


def with_scope(clusters: DataFrame) -> DataFrame:
    """Adds in_scope: a cluster whose summary's category is the catch-all stays only with a damage or standalone term;
    one without a summary stays."""
    catch_all = F.coalesce(F.col("categoria") == FALLBACK_CATEGORY, F.lit(False))
    return clusters.withColumn("in_scope", ~catch_all | F.col("damage") | F.col("standalone"))


def misaligned(title: Column, member_tokens: Column, stopwords) -> Column:
    """Whether a story's title shares no token with its members' titles; false for a title without tokens."""
    own = text.tokens(title, stopwords)
    return (F.size(own) > 0) & ~F.arrays_overlap(own, member_tokens)


def complete_editions(rows: DataFrame, key: str = "date") -> DataFrame:
    """Rows of editions that have a home story; the others are not to be written."""
    return rows.join(rows.where("section = 'home'").select(key).distinct(), key, "left_semi")

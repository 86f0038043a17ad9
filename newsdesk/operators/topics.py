"""Topic hubs: names and phenomena that several stories share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk.functions import text
from newsdesk.operators.catalog import latest_per
from newsdesk.params import Lexicon


def phenomena_in(title: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Labels of the phenomena that the folded title mentions; several may hit."""
    found = F.array(*[F.struct(F.lit(m).alias("match"), F.lit(label).alias("label")) for m, label in lexicon.phenomena])
    return F.transform(F.filter(found, lambda x: F.contains(text.fold_plain(title), x["match"])), lambda x: x["label"])


def is_valid_topic(phrase: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Distinctive: a word besides connectors, not a generic term, and four characters or more if it is one word."""
    words = F.transform(F.filter(F.split(phrase, f"{text.WS}+"), lambda w: w != ""), text.slugify)
    both = F.struct(F.filter(words, lambda w: ~w.isin(*lexicon.connectors)).alias("telling"), text.slugify(phrase).alias("slug"))

    def holds(x: Column) -> Column:
        telling, slug, one = x["telling"], x["slug"], F.get(x["telling"], F.lit(0))
        alone = (F.char_length(one) >= 4) & ~one.isin(*lexicon.generic)
        return (F.size(telling) > 0) & (slug != "") & ~slug.isin(*lexicon.generic) & ((F.size(telling) > 1) | alone)

    return F.get(F.transform(F.array(both), holds), F.lit(0))  # so that both are computed once


def topic_candidates(title: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Valid topic phrases of a title: capitalised runs, then phenomena."""
    both = F.concat(text.capitalised_runs(title, lexicon.connectors), phenomena_in(title, lexicon))
    return F.filter(both, lambda p: is_valid_topic(p, lexicon))


def topic_stories(stories: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """(topic_slug, story_slug, label, story_rank, at, updated_at): the first phrase of each topic in each story.

    stories: (slug, titulo, updated_at, story_rank), story_rank being the catalog order.
    """
    # title-wide work stays narrow; the struct keeps the phrase's place for the tie rules
    each = stories.select("slug", "updated_at", "story_rank", F.posexplode(topic_candidates(F.col("titulo"), lexicon)).alias("at", "label"))
    each = each.withColumn("topic_slug", text.slugify(F.col("label")))
    first = F.min_by(F.struct("label", "story_rank", "at", "updated_at"), "at")
    return each.groupBy("topic_slug", F.col("slug").alias("story_slug")).agg(first.alias("x")).select("topic_slug", "story_slug", "x.*")


def build_topics(bridge: DataFrame, least: int = 2, index_at: int = 4) -> DataFrame:
    """(slug, label, n_stories, first_seen, indexable): topics of at least `least` stories.

    The label is the longest phrase, the earliest of equals (by slug within a rank). first_seen orders topics of one size.
    """
    label = F.min_by("label", F.struct(-F.char_length("label"), "story_rank", "story_slug", "at"))
    rows = bridge.groupBy(F.col("topic_slug").alias("slug")).agg(
        label.alias("label"), F.count_distinct("story_slug").alias("n_stories"), F.min(F.struct("story_rank", "at")).alias("first_seen")
    )
    return rows.where(F.col("n_stories") >= least).withColumn("indexable", F.col("n_stories") >= index_at)


def topics_of_story(bridge: DataFrame, topics: DataFrame) -> DataFrame:
    """(story_slug, topic_slug, label): a story's topics that are hubs."""
    return bridge.select("story_slug", "topic_slug").join(topics.select(F.col("slug").alias("topic_slug"), "label", "n_stories", "first_seen"), "topic_slug")


def pending_intros(topics: DataFrame, intros: DataFrame, version: int, most: int = 3, force: bool = False) -> DataFrame:
    """The strongest indexable topics without an intro of this prompt version; of all topics with `force`."""
    rows = topics.where("indexable")
    if not force:
        rows = rows.join(intros.where(F.col("prompt_version") == version).select("slug"), "slug", "left_anti")
    return rows.orderBy(F.col("n_stories").desc(), "first_seen").limit(most)


def intro_requests(topics: DataFrame, bridge: DataFrame, stories: DataFrame, most: int = 10) -> DataFrame:
    """(slug, label, request): the `most` newest stories of each topic as numbered blocks."""
    listed = bridge.select("topic_slug", F.col("story_slug").alias("slug")).join(stories.select("slug", "titulo", "resumo", "por_que_importa", "updated_at"), "slug")
    why = text.blank_to_null(F.coalesce("por_que_importa", F.lit("")))
    why = F.coalesce(F.concat(F.lit(" Por que importa: "), why), F.lit(""))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "titulo", F.lit("\n"), "resumo", why)
    rows = latest_per(listed, "topic_slug", most).withColumn("block", block)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n")
    return topics.select("slug", "label").join(rows.groupBy(F.col("topic_slug").alias("slug")).agg(joined.alias("request")), "slug")


def story_corpus(stories: DataFrame, key: str) -> DataFrame:
    """(key, corpus): folded texts, categories and source names of the stories of a key."""
    names = F.array_join(F.transform("sources", lambda s: s["name"]), " ")
    said = F.concat_ws(" ", "titulo", "resumo", "por_que_importa", "categoria", names)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("story_rank", said.alias("said")))), lambda x: x["said"]), " ")
    return stories.groupBy(key).agg(joined.alias("corpus")).withColumn("corpus", text.fold_plain(F.col("corpus")))

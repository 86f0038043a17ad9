"""Editions from articles: filter, clusters, ranking, summaries, scope gate, stories, sections, audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.functions import dates, text
from newsdesk.operators import articles as art
from newsdesk.operators import clusters, editions, ranking, summaries
from newsdesk.operators.graph import checkpoint
from newsdesk.params import Params

_CLUSTER = ("edition_ts", "cluster_seq")
_STORY = ("edition_ts", "slug")


@dataclass
class Build:
    """What a run makes: edition rows (with edition_ts and date), the resolved summaries, and the stories whose title
    shares no term with their articles'."""

    rows: DataFrame
    resolved: DataFrame
    misaligned: DataFrame


def pool_members(articles: DataFrame, p: Params = Params(), first: float | None = None, last: float | None = None) -> DataFrame:
    """Articles of the ranked clusters of every run instant, from `first` to `last` (in seconds) if given: the article, edition_ts, cluster_seq, member_rank, is_anchor,
    slug, rank and the cluster's stats. Clusters with equal scores go in the order they were begun."""
    niche = checkpoint(art.with_niche_flags(art.filter_niche(articles, p.lexicon), p.lexicon))
    windowed = clusters.windows_of(niche, p.cluster)
    if first is not None:
        windowed = windowed.where(F.col("edition_ts").cast("double") >= first)
    if last is not None:
        windowed = windowed.where(F.col("edition_ts").cast("double") <= last)
    labels = checkpoint(clusters.cluster_greedy(niche, windowed, p.lexicon, p.cluster))
    found = labels.join(niche, "id")
    stats = clusters.cluster_stats(found, _CLUSTER)
    stats = stats.withColumn("score", F.round(ranking.score(F.col("edition_ts"), p.rank), 9))
    pool = ranking.ranked(stats, "edition_ts", ["cluster_seq"], p.rank.pool)
    anchors = clusters.cluster_anchor(found, _CLUSTER)
    members = found.join(pool, list(_CLUSTER)).join(anchors, list(_CLUSTER))
    return members.withColumn("is_anchor", F.col("id") == F.col("slug"))


def build(articles: DataFrame, cache: DataFrame, responses: DataFrame, p: Params = Params(), first: float | None = None, last: float | None = None) -> Build:
    """Editions of every run instant that an article's window reaches, from `first` to `last` (in seconds) if given.

    articles: see items_to_articles, each id once. cache: (slug, summary fields, cached_at); responses: (slug, summary
    fields). A run whose gate leaves nothing has no rows, so nothing is written for it.
    """
    members = checkpoint(pool_members(articles, p, first, last))
    stats = members.groupBy(*_STORY, "rank", "cluster_id", "latest_at").agg(F.first("cluster_seq").alias("cluster_seq"))
    pool = stats.join(summaries.cluster_corpus(members, _STORY), list(_STORY))
    resolved = summaries.resolve(pool, cache, responses, summaries.fallback_summary(members, _STORY), F.col("edition_ts"), p.summary)
    resolved = checkpoint(resolved)
    scoped = editions.with_scope(resolved.join(clusters.scope_flags(members, _STORY, p.lexicon), list(_STORY))).where("in_scope")
    order = Window.partitionBy("edition_ts").orderBy("rank")
    scoped = scoped.withColumn("rank", F.row_number().over(order)).drop("damage", "standalone", "in_scope")
    stories = editions.to_stories(scoped, stats, editions.story_sources(members, _STORY), editions.story_image(members, _STORY))
    stories = checkpoint(stories)
    rows = editions.edition_rows(stories, "edition_ts", p.rank.home)
    rows = editions.complete_editions(rows, "edition_ts").withColumn("date", dates.edition_date(F.col("edition_ts")))
    words = F.array_distinct(F.flatten(F.collect_list(text.tokens(F.col("title"), p.lexicon.stopwords))))
    said = members.groupBy(*_STORY).agg(words.alias("_words"))
    home = rows.where("section = 'home'").select(*_STORY, "titulo").join(said, list(_STORY))
    return Build(rows, resolved, home.where(editions.misaligned(F.col("titulo"), F.col("_words"), p.lexicon.stopwords)).drop("_words"))


def last_of_day(rows: DataFrame) -> DataFrame:
    """The edition that stands for each day: its last run's."""
    last = rows.groupBy("date").agg(F.max("edition_ts").alias("edition_ts"))
    return rows.join(last, ["date", "edition_ts"])

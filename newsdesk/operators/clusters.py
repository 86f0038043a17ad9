"""Articles that tell the same story, per edition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.functions import text
from newsdesk.operators.articles import longest
from newsdesk.operators.graph import checkpoint, connected_components
from newsdesk.operators.greedy import greedy_in_waves, greedy_whole
from newsdesk.operators.vectors import guard_entities, similar_pairs, term_freq
from newsdesk.params import ClusterParams, Lexicon


def explode_windows(articles: DataFrame, p: ClusterParams = ClusterParams()) -> DataFrame:
    """One row for each edition whose window holds the article: published between `window_hours` before the run and
    `ahead_hours` after it, both inclusive. Run instants are multiples of `every_hours`; equi-keys, no range join."""
    step, t = 3600 * p.every_hours, F.col("published_at").cast("double")
    first = F.ceil((t - 3600 * p.ahead_hours) / step).cast("long")
    last = F.floor((t + 3600 * p.window_hours) / step).cast("long")
    return articles.where("published_at is not null").withColumn("edition_ts", F.explode(F.sequence(first, last))).withColumn(
        "edition_ts", F.timestamp_seconds(F.col("edition_ts") * step)
    )


def vectors_of(articles: DataFrame, lexicon: Lexicon, p: ClusterParams) -> DataFrame:
    """(id, terms, weights, entities): narrow rows to cluster by; an article with an empty vector has none."""
    each = F.array_sort(F.collect_list(F.struct("term", "weight")))
    vectors = term_freq(articles, lexicon.stopwords, p.title_weight).groupBy("id").agg(each.alias("v"))
    named = articles.select("id", text.named_entities(F.col("title")).alias("entities"))
    return vectors.join(named, "id").select("id", F.col("v.term").alias("terms"), F.col("v.weight").alias("weights"), "entities")


def windows_of(articles: DataFrame, p: ClusterParams = ClusterParams()) -> DataFrame:
    """explode_windows() of what the clustering needs of an article: its texts stay below."""
    return explode_windows(articles.select("id", "published_at", "feed_rank", "item_rank"), p)


def cluster_greedy(articles: DataFrame, windows: DataFrame, lexicon: Lexicon, p: ClusterParams = ClusterParams()) -> DataFrame:
    """(edition_ts, id, cluster_seq, member_rank): the order-dependent clustering, exact, editions in parallel.

    articles: each id once; windows: see windows_of(), all editions or some. An edition of at most `max_group_rows`
    articles is one group; larger ones are settled in waves, see greedy_in_waves().
    """
    rows = windows.select("edition_ts", "id", "published_at", (F.col("feed_rank") * (1 << 40) + F.col("item_rank")).alias("ingest"))
    vectors = checkpoint(vectors_of(articles, lexicon, p))
    sizes = rows.groupBy("edition_ts").count()
    large = checkpoint(sizes.where(F.col("count") > p.max_group_rows).select("edition_ts"))
    if large.isEmpty():
        return greedy_whole(rows.join(vectors, "id"), p)
    found = greedy_whole(rows.join(large, "edition_ts", "left_anti").join(vectors, "id"), p)
    return found.unionByName(greedy_in_waves(rows.join(large, "edition_ts", "left_semi").join(vectors, "id"), p))


def cluster_components(articles: DataFrame, windows: DataFrame, lexicon: Lexicon, p: ClusterParams = ClusterParams()) -> DataFrame:
    """(edition_ts, id, component): the order-free variant. Articles linked by similarity and the entity guard, joined
    transitively; it may merge more than the greedy clustering."""
    vectors = checkpoint(term_freq(articles, lexicon.stopwords, p.title_weight))
    entities = articles.select("id", text.named_entities(F.col("title")).alias("entities"))
    # articles of one edition are at most a window apart: they share a stretch of this length or the next one
    stretch = F.floor(F.col("published_at").cast("double") / (3600 * (p.window_hours + p.ahead_hours)))
    near = articles.where("published_at is not null").select("id", F.explode(F.array(stretch, stretch + 1)).alias("stretch"))
    pairs = similar_pairs(vectors.join(near, "id"), p.threshold, ("stretch",)).drop("stretch").dropDuplicates(["a", "b"])
    pairs = guard_entities(pairs, entities, p.high_cosine)
    when = windows.select("edition_ts", "id")
    both = pairs.select("a", "b").join(when.withColumnRenamed("id", "a"), "a").join(when.withColumnRenamed("id", "b"), ["edition_ts", "b"])
    found = connected_components(both.select("edition_ts", "a", "b"), "edition_ts")
    known = vectors.select("id").distinct()
    return when.join(known, "id").join(found, ["edition_ts", "id"], "left").select("edition_ts", "id", F.coalesce("component", "id").alias("component"))


def cluster_stats(members: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, cluster_id, latest_at, source_count, n_articles) of clusters given as rows of articles."""
    ids = F.array_join(F.sort_array(F.collect_list("id")), "|")
    return members.groupBy(*keys).agg(
        F.substring(F.sha1(ids.cast("binary")), 1, 16).alias("cluster_id"),
        F.max("published_at").alias("latest_at"),
        F.count_distinct("source").alias("source_count"),
        F.count("*").alias("n_articles"),
    )


def cluster_anchor(members: DataFrame, keys: tuple[str, ...], *columns: str) -> DataFrame:
    """The oldest article of each cluster, the smallest normalised URL on ties; its id is the story's slug."""
    late = F.coalesce("published_at", F.lit("9999-12-31 00:00:00").cast("timestamp"))
    row = F.min_by(F.struct("id", *columns), F.struct(late, F.col("norm_url")))
    return members.groupBy(*keys).agg(row.alias("anchor")).select(*keys, "anchor.*").withColumnRenamed("id", "slug")


def scope_flags(members: DataFrame, keys: tuple[str, ...], lexicon: Lexicon) -> DataFrame:
    """(keys, damage, standalone): whether the folded texts of a cluster's members, joined in order by spaces, hold such a
    term (see with_niche_flags).

    A term lies within a text or across a seam. At a seam only the fronts and backs of the texts count, as far as a term
    reaches; each text adds a character and a space at least, so half as many texts before it are enough.
    """
    reach = longest(lexicon) - 1
    before = F.collect_list("edges.back").over(Window.partitionBy(*keys).orderBy("member_rank").rowsBetween(-reach, -1))
    seam = F.concat(F.right(F.array_join("_before", " "), F.lit(reach)), F.lit(" "), "edges.front")
    rows = members.withColumn("_before", before).withColumn("_seam", F.when(F.size("_before") > 0, seam))
    holds = lambda name: F.bool_or(F.col(name) | F.coalesce(text.contains_any(F.col("_seam"), getattr(lexicon, name)), F.lit(False))).alias(name)
    return rows.groupBy(*keys).agg(holds("damage"), holds("standalone"))

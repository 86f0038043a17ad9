"""Weighted term vectors as rows, and pairs of similar ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.functions import text
from newsdesk.operators.allpairs import all_pairs
from newsdesk.operators.graph import checkpoint


def term_freq(articles: DataFrame, stopwords, title_weight: int = 3, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, term, weight): occurrences in the title count `title_weight` times, in the description once."""
    side = lambda c, w: F.transform(text.tokens(F.coalesce(c, F.lit("")), stopwords), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    both = F.concat(side("title", title_weight), side("description", 1))
    return articles.select(*keys, F.inline(both)).groupBy(*keys, "term").agg(F.sum("w").cast("long").alias("weight"))


def term_lists(articles: DataFrame, stopwords, title_weight: int = 3) -> DataFrame:
    """(id, terms, weights, entities) of articles, each id once, without a shuffle: a term has a weight for each occurrence,
    which all_pairs() sums."""
    of = lambda c: text.tokens(F.coalesce(c, F.lit("")), stopwords)
    rows = articles.select("id", of("title").alias("t"), of("description").alias("d"), text.named_entities(F.col("title")).alias("entities"))
    weights = F.concat(F.array_repeat(F.lit(title_weight).cast("long"), F.size("t")), F.array_repeat(F.lit(1).cast("long"), F.size("d")))
    return rows.select("id", F.concat("t", "d").alias("terms"), weights.alias("weights"), "entities")


def _terms(left: DataFrame, right: DataFrame, key: list[str], heavy: int, cell_pairs: int) -> DataFrame:
    """(key, term, df, rank, grid) of the terms on both sides: how frequent, the place among the `heavy` most frequent
    ones (null for the others), and the side of the square of cells that the term's pairs are split over."""
    df = right.groupBy(*key, "term").agg(F.count("*").alias("df"))
    asks = df.withColumn("asks", F.col("df")) if left is right else df.join(left.groupBy(*key, "term").agg(F.count("*").alias("asks")), [*key, "term"])
    grid = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("df") * F.col("asks") / cell_pairs)).cast("int"))
    terms = asks.select(*key, "term", "df", grid.alias("grid"))
    most = Window.partitionBy(*key).orderBy(F.col("df").desc(), "term")  # each task keeps its own most frequent ones
    top = terms.withColumn("rank", F.row_number().over(most)).where(F.col("rank") <= heavy).select(*key, "term", "rank")
    return terms.join(top, [*key, "term"], "left")


def _listed(vectors: DataFrame, terms: DataFrame, key: list[str], heavy: int) -> DataFrame:
    """A row a vector: n (a number), norm, terms from the rarest on, the dense weights of the heavy terms and the share of
    the norm that they have."""
    known = vectors.join(terms, [*key, "term"], "left")
    each = F.when(F.col("df").isNotNull(), F.struct("df", "term", "weight", "rank", "grid"))
    rows = known.groupBy(*key, "id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.array_sort(F.collect_list(each)).alias("terms"))
    rows = rows.withColumn("heavy", F.filter("terms", lambda t: t["rank"].isNotNull()))
    of = lambda r: F.coalesce(F.get(F.filter("heavy", lambda t: t["rank"] == r), F.lit(0))["weight"], F.lit(0))
    size = F.sqrt(F.aggregate("heavy", F.lit(0).cast("long"), lambda s, t: s + t["weight"] * t["weight"]))
    rows = rows.withColumns({"dense": F.transform(F.sequence(F.lit(1), F.lit(heavy)), of), "share": size / F.col("norm")})
    return checkpoint(rows.drop("heavy").withColumn("n", F.monotonically_increasing_id()))


def _index(rows: DataFrame, key: list[str], threshold: float, is_left: bool) -> DataFrame:
    """Rows to meet by: all light terms with their weights, as shares of the norm; of the heavy terms, rarest first, those
    behind which the rest could still reach the threshold alone, without a weight. Each in the cells of its half of the
    term's square."""
    light = F.filter("terms", lambda t: t["rank"].isNull())
    heavy = F.filter("terms", lambda t: t["rank"].isNotNull())
    left = lambda i: F.sqrt(F.aggregate(F.slice(heavy, i + 1, F.size(heavy)), F.lit(0).cast("long"), lambda s, t: s + t["weight"] * t["weight"]))
    reach = F.filter(F.transform(heavy, lambda t, i: F.struct(t["term"].alias("term"), F.lit(0).cast("long").alias("weight"), t["grid"].alias("grid"), left(i).alias("left"))), lambda t: t["left"] >= (threshold - 1e-9) * F.col("norm"))
    narrow = lambda c: F.transform(c, lambda t: F.struct(t["term"].alias("term"), t["weight"].alias("weight"), t["grid"].alias("grid")))
    out = rows.select(*key, "n", "norm", "share", F.inline(F.concat(narrow(light), narrow(reach))))
    own, other = F.pmod(F.xxhash64("n"), F.col("grid").cast("long")), F.explode(F.sequence(F.lit(0), F.col("grid") - 1))
    out = out.withColumn("own", own).withColumn("other", other)
    cell = F.col("own") * F.col("grid") + F.col("other") if is_left else F.col("other") * F.col("grid") + F.col("own")
    side = "a" if is_left else "b"
    return out.select(*key, "term", cell.alias("cell"), F.col("n").alias(f"n{side}"), (F.col("weight") / F.col("norm")).alias(f"w{side}"), F.col("share").alias(f"share_{side}"))


def cosine_join(left: DataFrame, right: DataFrame, threshold: float, group: tuple[str, ...] = (), heavy: int = 32, cell_pairs: int = 1 << 20) -> DataFrame:
    """(group, a, b, similarity) of vectors (group, id, term, weight) whose cosine reaches the threshold, within a group.
    With itself as `right`, a side is joined once with each other id: a < b.

    The products of light terms are summed where vectors meet in an inverted index. A pair stays if the sum and the
    norms of both heavy parts, which bound what is left, can reach the threshold; only then the heavy parts, short dense
    arrays, are multiplied. Pairs that share heavy terms alone meet under the first of them that can matter. A term of
    many vectors is split over a square of cells of at most about `cell_pairs` pairs each. Exact at any threshold.
    """
    key, same = [*group], left is right
    terms = checkpoint(_terms(left, right, key, heavy, cell_pairs))
    one = _listed(left, terms, key, heavy)
    other = one if same else _listed(right, terms, key, heavy)
    met = _index(one, key, threshold, True).join(_index(other, key, threshold, False), [*key, "term", "cell"])
    met = met.where("na < nb") if same else met
    met = met.select(*key, "na", "nb", (F.col("wa") * F.col("wb")).alias("part"), (F.col("share_a") * F.col("share_b")).alias("rest"))
    pairs = met.repartition("na").groupBy(*key, "na", "nb").agg(F.sum("part").alias("light"), F.max("rest").alias("rest"))  # hardly a pair meets twice in a task
    pairs = pairs.where(F.col("light") + F.col("rest") >= threshold - 1e-9)
    of = lambda rows, x: rows.select(F.col("n").alias(f"n{x}"), F.col("id").alias(x), F.col("dense").alias(f"d{x}"), F.col("norm").alias(f"norm_{x}"))
    pairs = pairs.join(of(one, "a"), "na").join(of(other, "b"), "nb")
    heavy_dot = F.aggregate(F.zip_with("da", "db", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    similarity = F.col("light") + heavy_dot / (F.col("norm_a") * F.col("norm_b"))
    a, b = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) if same else ("a", "b")
    return pairs.select(*key, a, b, similarity.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def similar_pairs(vectors: DataFrame, threshold: float, group: tuple[str, ...] = ()) -> DataFrame:
    """(group, a, b, similarity), a < b, of ids whose cosine reaches the threshold, within a group: see cosine_join();
    without groups, see all_pairs()."""
    if not group and threshold > 0:
        lists = vectors.groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("v"))
        return all_pairs(lists.select("id", F.col("v.term").alias("terms"), F.col("v.weight").alias("weights")), threshold)
    vectors = checkpoint(vectors)
    return cosine_join(vectors, vectors, threshold, group)


def guard_entities(pairs: DataFrame, entities: DataFrame, high: float = 0.50) -> DataFrame:
    """Pairs that stay: similar enough by themselves, or not both with names, or with a name in common. entities: (id, entities)."""
    ea = entities.select(F.col("id").alias("a"), F.col("entities").alias("ea"))
    eb = entities.select(F.col("id").alias("b"), F.col("entities").alias("eb"))
    apart = (F.size("ea") > 0) & (F.size("eb") > 0) & ~F.arrays_overlap("ea", "eb")
    return pairs.join(ea, "a").join(eb, "b").where((F.col("similarity") >= high) | ~apart).drop("ea", "eb")

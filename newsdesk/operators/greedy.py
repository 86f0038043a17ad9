"""The order-dependent clustering of editions, whole or in waves."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.operators.vectors import cosine_join
from newsdesk.params import ClusterParams
from newsdesk.shared import Folder

LABELS = "edition_ts timestamp, id string, cluster_seq long, member_rank long"
_CLUSTER = "edition_ts timestamp, cluster_seq long, size long, terms array<string>, weights array<long>, entities array<string>"


class Clusters:
    """Clusters in the order in which they were begun; each is the sum of its members' vectors.

    The sums are held by term, so that one pass over an article's terms gives its products with all clusters.
    """

    def __init__(self, p: ClusterParams):
        self.p = p
        self.sums: dict[str, dict[int, float]] = {}
        self.terms: list[list[str]] = []
        self.squares: list[float] = []
        self.names: list[set] = []
        self.sizes: list[int] = []

    def add(self, terms: Iterable[str], weights: Iterable[int], entities: Iterable[str], size: int) -> None:
        """A cluster that is already there."""
        g = len(self.sizes)
        self.terms.append(list(terms))
        self.squares.append(float(sum(int(w) * int(w) for w in weights)))
        self.names.append(set(entities))
        self.sizes.append(size)
        for t, w in zip(terms, weights, strict=True):
            self.sums.setdefault(t, {})[g] = float(w)

    def join(self, terms: Iterable[str], weights: Iterable[int], entities: Iterable[str]) -> int:
        """Puts an article into the most similar cluster (the cosine with its sum), or begins one."""
        weights = [float(w) for w in weights]
        norm = sum(w * w for w in weights) ** 0.5
        dots: dict[int, float] = {}
        for t, w in zip(terms, weights, strict=True):
            for g, s in self.sums.get(t, {}).items():
                dots[g] = dots.get(g, 0.0) + w * s
        best, most = None, self.p.threshold
        for g, dot in dots.items():
            similarity = dot / (norm * self.squares[g] ** 0.5)
            if similarity > most or similarity == most and (best is None or g > best):
                best, most = g, similarity
        own = set(entities)
        if best is not None and most < self.p.high_cosine and own and self.names[best] and not own & self.names[best]:
            best = None
        if best is None:
            best = len(self.sizes)
            self.add((), (), (), 0)
        for t, w in zip(terms, weights, strict=True):
            by = self.sums.setdefault(t, {})
            old = by.get(best, 0.0)
            if not old:
                self.terms[best].append(t)
            self.squares[best] += (old + w) ** 2 - old**2
            by[best] = old + w
        self.names[best] |= own
        self.sizes[best] += 1
        return best


def greedy_whole(rows: DataFrame, p: ClusterParams) -> DataFrame:
    """LABELS of editions that are one group each. rows: (edition_ts, id, published_at, ingest, terms, weights, entities)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["published_at", "ingest"], ascending=[False, True], kind="stable")
        found, labels, ranks = Clusters(p), [], []
        for row in zip(pdf["terms"], pdf["weights"], pdf["entities"], strict=True):
            labels.append(found.join(*row))
            ranks.append(found.sizes[labels[-1]] - 1)
        return pdf[["edition_ts", "id"]].assign(cluster_seq=labels, member_rank=ranks)

    return rows.groupBy("edition_ts").applyInPandas(run, LABELS)


def _settle(p: ClusterParams):
    """One wave of an edition: clusters as they stood before it, then its articles in order. Labels, and the clusters that changed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["is_article", "place"])
        seeds, articles = pdf[~pdf["is_article"]], pdf[pdf["is_article"]]
        found, numbers = Clusters(p), [int(n) for n in seeds["cluster_seq"]]
        for *row, size in zip(seeds["terms"], seeds["weights"], seeds["entities"], seeds["size"], strict=True):
            found.add(*row, int(size))
        fresh, changed, out = int(articles["begun"].iloc[0]), set(), []
        at = articles["edition_ts"].iloc[0]
        for name, *row in zip(articles["id"], articles["terms"], articles["weights"], articles["entities"], strict=True):
            g = found.join(*row)
            if g == len(numbers):
                numbers.append(fresh)
                fresh += 1
            changed.add(g)
            out.append((at, name, numbers[g], found.sizes[g] - 1, None, [], [], []))
        for g in sorted(changed):
            out.append((at, None, numbers[g], None, found.sizes[g], found.terms[g], [int(found.sums[t][g]) for t in found.terms[g]], sorted(found.names[g])))
        return pd.DataFrame(out, columns=["edition_ts", "id", "cluster_seq", "member_rank", "size", "terms", "weights", "entities"]).astype({"member_rank": "Int64", "size": "Int64"})

    return run


def greedy_in_waves(rows: DataFrame, p: ClusterParams) -> DataFrame:
    """What greedy_whole gives, for editions of any size; no group has more than `max_group_rows` articles and clusters.

    Editions are settled in waves of half as many articles, newest first. What an article of a wave may join is a
    cluster of the same wave or one that some article of the wave reaches as it stands before it: a cluster that none
    reaches is not joined, so it doesn't change and is never reached. A similarity join of the wave with the sums of all
    clusters finds those that count; they and the wave's articles are one group, which gives labels and new versions of
    the clusters it changed. A wave that reaches too many clusters is cut at the article from which on they don't fit;
    of a single article that does, the most similar clusters are enough.
    """
    spark, work, most = rows.sparkSession, Folder(rows.sparkSession, "waves"), p.max_group_rows
    order = Window.partitionBy("edition_ts").orderBy(F.col("published_at").desc(), "ingest")
    placed = rows.withColumn("place", F.row_number().over(order).cast("long") - 1).drop("published_at", "ingest")
    placed = work.write(placed.withColumn("wave", F.floor(F.col("place") / max(1, most // 2))), "articles", "wave")
    last = placed.agg(F.max("wave")).first()[0]  # one value
    known, done = spark.createDataFrame([], _CLUSTER), []  # paths
    kinds = f"{LABELS}, size long, terms array<string>, weights array<long>, entities array<string>"
    inverted = lambda rows, name: rows.select("edition_ts", F.col(name).alias("id"), F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("weights").alias("weight"))))
    for wave in range(0 if last is None else last + 1):
        todo = placed.where(F.col("wave") == wave).drop("wave")
        while True:
            begun = known.groupBy("edition_ts").agg(F.count("*").alias("begun"))
            hits = cosine_join(inverted(todo, "id"), inverted(known, "cluster_seq"), p.threshold, ("edition_ts",)) if done else spark.createDataFrame([], "edition_ts timestamp, a string, b long, similarity double")
            hits = hits.join(todo.select("edition_ts", F.col("id").alias("a"), "place"), ["edition_ts", "a"])
            first = F.min(F.struct("place", (-F.col("similarity")).alias("unlike")))
            reached = work.write(hits.groupBy("edition_ts", F.col("b").alias("cluster_seq")).agg(first.alias("first")).select("edition_ts", "cluster_seq", "first.*"), "reached")
            counted = todo.select("edition_ts", "place").unionByName(reached.select("edition_ts", "place"))
            so_far = F.count("*").over(Window.partitionBy("edition_ts").orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
            fits = F.max(F.when(F.col("so_far") <= most, F.col("place")))
            cut = counted.withColumn("so_far", so_far).groupBy("edition_ts").agg(F.coalesce(fits, F.min("place")).alias("cut"))
            cut = work.write(cut, "cut")
            best = Window.partitionBy("edition_ts").orderBy("place", "unlike", F.col("cluster_seq").desc())
            seeds = reached.join(cut, "edition_ts").where("place <= cut").withColumn("nth", F.row_number().over(best)).where(F.col("nth") < most)
            seeds = known.join(seeds.select("edition_ts", "cluster_seq"), ["edition_ts", "cluster_seq"])
            seeds = seeds.select("*", F.lit(False).alias("is_article"), F.col("cluster_seq").alias("place"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("begun"))
            now = todo.join(cut, "edition_ts").where("place <= cut").drop("cut").join(begun, "edition_ts", "left").withColumn("begun", F.coalesce("begun", F.lit(0).cast("long")))
            now = now.select("*", F.lit(True).alias("is_article"), F.lit(None).cast("long").alias("cluster_seq"), F.lit(None).cast("long").alias("size"))
            found = work.write(now.unionByName(seeds).groupBy("edition_ts").applyInPandas(_settle(p), kinds), "settled")
            done.append(found.written_at)
            changed = found.where("id is null").select("edition_ts", "cluster_seq", "size", "terms", "weights", "entities")
            newer = work.write(known.join(changed, ["edition_ts", "cluster_seq"], "left_anti").unionByName(changed), "clusters")
            left = todo.join(cut, "edition_ts").where("place > cut").drop("cut")
            more = not left.isEmpty()
            left = work.write(left, "left") if more else None
            work.drop(reached, cut, *[x for x in (known, todo) if hasattr(x, "written_at")])
            known, todo = newer, left
            if not more:
                break
    found = spark.read.schema(kinds).parquet(*done) if done else spark.createDataFrame([], kinds)
    return found.where("id is not null").select("edition_ts", "id", "cluster_seq", "member_rank")

"""Connected components of a pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.shared import shared_dir


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder of spark.checkpoint.dir; sets one where there is none, as in tests."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def connected_components(pairs: DataFrame, group: str, most_rounds: int = 50) -> DataFrame:
    """(group, id, component) for ids in `pairs` (group, a, b): the smallest id that is reachable.

    Labels spread along edges and jump to their label's label, so rounds grow with the logarithm of a chain's
    length. An unfinished result is an error, never a truncated one.
    """
    edges = pairs.select(group, "a", "b").unionByName(pairs.select(group, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = checkpoint(edges)
    labels = checkpoint(edges.groupBy(group, F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(most_rounds):
        named = labels.select(group, F.col("id").alias("b"), F.col("component").alias("near"))
        seen = edges.join(named, [group, "b"]).groupBy(group, F.col("a").alias("id")).agg(F.min("near").alias("near"))
        spread = labels.join(seen, [group, "id"]).select(group, "id", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        jump = spread.select(group, F.col("id").alias("component"), F.col("component").alias("far"))
        new = spread.join(jump, [group, "component"], "left").select(group, "id", F.coalesce("far", "component").alias("component"), "before")
        new = checkpoint(new)
        labels = new.drop("before")
        if new.where("component != before").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

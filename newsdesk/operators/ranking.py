"""Scores of clusters and the ranked pool of each edition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.params import RankParams


def recency(latest_at: Column, now: Column, half_life_hours: float = 10.0) -> Column:
    """1 at the run instant, halved every `half_life_hours`; 0 without a date."""
    age = F.greatest(F.lit(0.0), (now.cast("double") - latest_at.cast("double")) / 3600)
    return F.when(latest_at.isNotNull(), F.pow(F.lit(2.0), -age / half_life_hours)).otherwise(F.lit(0.0))  # greatest() skips nulls


def score(now: Column, p: RankParams = RankParams()) -> Column:
    return p.source_weight * F.col("source_count") + p.recency_weight * recency(F.col("latest_at"), now, p.half_life_hours)


def ranked(clusters: DataFrame, key: str, ties: list, most: int) -> DataFrame:
    """The `most` best-scored clusters of each `key`, with their rank from 1; `ties` breaks equal scores."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), *ties)
    return clusters.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after every run of `[\\x20\\x09-\\x0D]` became one space. Copies are
combined in three steps, each of which groups by the digest *and* the full normalised text: inside each task
(Spark's partial aggregation), inside a salt of the digest, and over the salts. However many copies a text has,
a step sends one row per task or per salt. Built-in functions only.

Defined cases: a null text counts as empty; a null doc_id never wins against another id and a group of null ids
keeps null (`kept` then holds for each of its rows); rows that share the winning doc_id and text all stay; other
columns stay, except those with the name of a new one, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm.common import WS, Scratch, quoted, skew_join, table


def normalised(text: F.Column) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def winners(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, keep_id, group_size) from rows of (doc_id, norm, digest)."""
    salted = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "norm", "salt")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    )
    whole = salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    clash = F.raise_error(F.lit("two texts share a SHA-256 digest"))
    return (
        whole.groupBy("digest")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count("*").alias("texts"))
        .select("digest", "keep_id", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(clash).alias("group_size"))
    )


def exact_dedup(docs: DataFrame, salts: int = 16) -> DataFrame:
    """`docs` with keep_id, group_size, kept and text_sha256."""
    names = [c for c in docs.columns if c.lower() not in ("keep_id", "group_size", "kept", "text_sha256")]
    rows = docs.select(F.struct(*map(quoted, names)).alias("row"), F.col("doc_id"), normalised(F.col("text")).alias("norm"))
    rows = rows.withColumn("digest", F.sha2("norm", 256))
    found = Scratch(docs.sparkSession, "exact-dedup").write(winners(rows.select("doc_id", "norm", "digest"), salts), "winners")
    out = skew_join(rows.select("row", "digest"), found, ["digest"], "group_size", docs.count())
    return out.select(
        *[quoted("row", c).alias(c) for c in names],
        F.col("found.keep_id").alias("keep_id"),
        F.col("found.group_size").alias("group_size"),
        F.col("row.doc_id").eqNullSafe(F.col("found.keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""

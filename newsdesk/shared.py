"""The folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own in local mode, else an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (at or "/tmp/checkpoints/newsdesk").rstrip("/")


class Folder:
    """Tables of one job in the shared folder. A written table cuts the lineage; drop() deletes those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, rows: DataFrame, name: str, *partition: str) -> DataFrame:
        self.n += 1
        at = f"{self.at}/{self.n:04d}-{name}"
        rows.write.option("compression", "zstd").partitionBy(*partition).parquet(at)
        schema = [f for f in rows.schema if f.name not in partition] + [f for f in rows.schema if f.name in partition]
        out = self.spark.read.schema(type(rows.schema)(schema)).parquet(at)
        out.written_at = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        for rows in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(rows.written_at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

"""Helpers that the training-text operators share: reading, scratch tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: `[\x20\x09-\x0D]`: the white space that the contracts name, and what bytes.split() splits on.
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(*path: str) -> F.Column:
    """A column by its name, whatever characters that has, or a field of one."""
    return F.col(".".join("`" + name.replace("`", "``") + "`" for name in path))


def without(rows: DataFrame, *names: str) -> DataFrame:
    """`rows` less some columns; DataFrame.drop() fails beside a column with a dot in its name."""
    return rows.select(*[quoted(c) for c in rows.columns if c.lower() not in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode, else an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "/tmp/checkpoints/newsdesk"
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


class Scratch:
    """Intermediate tables of one job, written as Parquet to the shared folder.

    A written table cuts the lineage: losing an executor later costs at most the step under way.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.there: dict[int, DataFrame] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        at = f"{self.root}/{self.n:03d}-{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out.scratch_path = at
        self.there[self.n] = out
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in dfs:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gone = {df.scratch_path for df in dfs}
        self.there = {n: df for n, df in self.there.items() if df.scratch_path not in gone}

    def drop_since(self, n: int, *keep: DataFrame) -> None:
        """Delete what was written after the first `n` tables, but for those that later steps read."""
        stay = {df.scratch_path for df in keep}
        self.drop(*[df for k, df in self.there.items() if k > n and df.scratch_path not in stay])


def with_fields(rows: DataFrame, more: str, without: tuple[str, ...] = ()) -> T.StructType:
    """The schema of `rows`, less some columns, and the fields of a DDL string."""
    return T.StructType([f for f in rows.schema.fields if f.name not in without] + T.StructType.fromDDL(more).fields)


def map_in_arrow(rows: DataFrame, run, schema: T.StructType) -> DataFrame:
    """DataFrame.mapInArrow(), which fails on a column with a dot in its name: such columns travel under another one."""
    travels = {c: f"_column_{i}" for i, c in enumerate(rows.columns) if "." in c or "`" in c}
    kinds = T.StructType([T.StructField(travels.get(f.name, f.name), f.dataType) for f in schema.fields])
    found = rows.toDF(*[travels.get(c, c) for c in rows.columns]).mapInArrow(run, kinds)
    return found.toDF(*schema.names)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of `batches`, in pieces of about `most` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows with equal keys, from batches that are sorted by the key.

    Each table yielded holds one or more whole groups; only a group that straddles batches is carried over.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            same = all(batch.column(k)[0].equals(last.column(k)[0]) and batch.column(k)[-1].equals(last.column(k)[0]) for k in key)
            if same:
                held.append(batch)
                continue
        whole = pa.Table.from_batches([*held, batch]).combine_chunks()
        cut = group_starts(whole, key)[-1]
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(rows: pa.Table, key: list[str]) -> np.ndarray:
    """Row numbers at which a new key begins, in rows sorted by it."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for k in key:
        v = rows.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)



def skew_join(rows: DataFrame, lookup: DataFrame, key: list[str], weight: str, total: int, hot_share: float = 1e-3) -> DataFrame:
    """`rows` left-joined with `lookup` (at most one row a key), whose column `weight` says how many rows have that key.

    Keys with more than `hot_share` of the `total` rows are looked up by broadcast: there are at most 1 / hot_share
    of them. Their rows, spread by a hash, pass through the join that serves the other keys. The looked-up columns
    come as one struct `found`, null where the key has no entry.
    """
    least = max(2.0, hot_share * total)
    values = F.struct(*[c for c in lookup.columns if c not in key])
    hot = F.broadcast(lookup.where(F.col(weight) > least).select(*key, values.alias("hot")))
    cold = lookup.where(F.col(weight) <= least).select(F.struct(*key, F.lit(0).cast("long").alias("spread")).alias("cold_key"), values.alias("cold"))
    out = rows.join(hot, key, "left")
    spread = F.when(F.col("hot").isNull(), F.lit(0)).otherwise(F.lit(1) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)))
    out = out.withColumn("cold_key", F.struct(*key, spread.cast("long").alias("spread")))
    return out.join(cold, "cold_key", "left").withColumn("found", F.coalesce("hot", "cold")).drop("cold_key", "hot", "cold")


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, counted: DataFrame, hot_share: float = 1e-3) -> DataFrame:
    """`rows` joined with `lookup` (one row a key at most, of any size); counted: a written table with the keys of `rows`.

    A key with more than `hot_share` of the rows, of which there are at most 1 / hot_share, is salted: its rows are dealt
    over as many copies of its entry as it has such shares.
    """
    share = max(2.0, hot_share * counted.count())
    hot = counted.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > share)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("n") / share).cast("int").alias("copies")))
    salt = F.when(F.col("copies").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("copies")).cast("int"))
    many = lookup.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    return rows.join(hot, key, "left").withColumn("salt", salt).drop("copies").join(many, [key, "salt"]).drop("salt")

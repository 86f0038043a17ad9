"""Near-duplicate detection: banded MinHash with sequential Bayesian verification (after Satuluri and Parthasarathy, 2012).

Documents with equal shingle sets are one *class* from the first step on. Classes get signatures of
`ROWS * BANDS` min-wise hashes; those that agree in a whole band share a bucket. A candidate pair's signatures are
compared a batch of hashes at a time; after each batch the pair is dropped when, under a uniform prior, the
posterior probability that its similarity reaches the threshold is below `MISS`. Survivors are verified exactly on
their full shingle sets. Links of verified pairs are joined into components.

Buckets of any size are handled without listing their pairs or capping them: see bucket_links.

A pair at similarity 0.8 shares no bucket with probability (1 - 0.8^5)^30 = 7e-6, and less above.

Defined cases: a document without words or text has an empty set, is linked with nothing and is its own component;
with fewer words than a shingle has, the whole sequence is the one shingle; a null doc_id counts after all others;
rows with the same doc_id are told apart by their shingle sets; repeated rows are linked; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm.bucket_links import BucketLinks, Similarity
from newsdesk.llm.common import Scratch, skew_join, slices, spread_join, table
from newsdesk.llm.words import mix, shingles, word_hashes

U = np.uint64
ROWS, BANDS = 5, 30
HASHES = ROWS * BANDS
BATCH = 30
MISS = 1e-6

_I = np.arange(1, HASHES + 1, dtype=U)
_FLIP = (mix(_I * U(0x9E3779B97F4A7C15)) >> U(32)).astype(np.uint32)
_SCALE = (mix(_I * U(0xC2B2AE3D27D4EB4F)) >> U(32)).astype(np.uint32) | np.uint32(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) of 16 bits; every set has an element."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    base = (np.concatenate(sets) >> U(32)).astype(np.uint32)
    out = np.empty((HASHES, len(sets)), np.uint32)
    for i in range(HASHES):
        out[i] = np.minimum.reduceat((base ^ _FLIP[i]) * _SCALE[i], starts)
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16).T


def set_hash(found: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    two = [int(mix(found ^ U(k)).sum(dtype=U)) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return tuple(x - (1 << 64) if x >> 63 else x for x in two)


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = shingles(*word_hashes(batch.column("text"), lower=True)[:2], size)
            full = [s for s in sets if len(s)]
            signed = iter(signatures(full)) if full else iter(())
            sigs = [next(signed).tobytes() if len(s) else None for s in sets]
            keys = [set_hash(s) for s in sets]
            columns = [batch.column("doc_id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
            yield pa.record_batch([*columns, pa.array(sigs, pa.binary())], ["doc_id", "h", "n_shingles", "k1", "k2", "sig"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(U)
        key = np.broadcast_to(np.arange(BANDS, dtype=U), rows.shape[:2])
        for k in range(ROWS):
            key = key * U(0xC2B2AE3D27D4EB4F) + rows[:, :, k]
        node = np.repeat(batch.column("node").to_numpy(), BANDS)
        yield pa.record_batch([pa.array(mix(key).ravel().view(np.int64)), pa.array(node)], ["key", "node"])


@functools.cache
def least_matches(threshold: float, miss: float) -> np.ndarray:
    """After each batch, the fewest matches that leave the pair a posterior probability of `miss` at least."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        density = np.exp(m * np.log(s) + (n - m) * np.log1p(-s) - (m * np.log((m + 0.5) / (n + 1)) + (n - m) * np.log((n - m + 0.5) / (n + 1))))
        tail = density[:, s >= threshold].sum(axis=1) / density.sum(axis=1)
        out.append(int(np.argmax(tail >= miss)))
    return np.array(out)


class Jaccard(Similarity):
    """Signatures by sequential Bayesian pruning; shingle sets exactly."""

    def __init__(self, percent: int, miss: float = MISS):
        self.percent, self.miss = percent, miss

    def matrix(self, summaries: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(summaries), np.uint16).reshape(-1, HASHES)

    def plausible(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        alive, matches = np.arange(len(other)), np.zeros(len(other), np.int64)
        for k, least in enumerate(least_matches(self.percent / 100, self.miss).tolist()):
            part = slice(k * BATCH, (k + 1) * BATCH)
            own = one[part] if one.ndim == 1 else one[alive, part]
            matches[alive] += (own == other[alive, part]).sum(axis=1)
            alive = alive[matches[alive] >= least]
        return alive

    def linked(self, sides: list[tuple[list, list, np.ndarray]]) -> Iterator[tuple[int, int, np.ndarray]]:
        """Shared shingles of one set with all others of its group at a time: a lookup table and a sum by set."""
        for g, (one, other, apart) in enumerate(sides):
            words, place = np.unique(np.concatenate(other), return_inverse=True)
            sizes = np.array([len(x) for x in other])
            starts = np.cumsum(sizes) - sizes
            for i, own in enumerate(one):
                at = np.searchsorted(words, own)
                at = at[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == own)]
                has = np.zeros(len(words), bool)
                has[at] = True
                shared = np.add.reduceat(has[place], starts, dtype=np.int64)
                found = np.flatnonzero((100 * shared >= self.percent * (len(own) + sizes - shared)) & apart[i])
                if len(found):
                    yield g, i, found


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = shingles(*word_hashes(batch.column("text"), lower=True)[:2], size)
            same = np.array([set_hash(s) for s in sets], np.int64).reshape(-1, 2)
            own = np.stack([batch.column(k).to_numpy() for k in ("k1", "k2")], axis=1)
            chosen = np.flatnonzero((same == own).all(axis=1)).tolist()
            ends = np.cumsum([0, *(len(sets[i]) for i in chosen)]).astype(np.int32)
            values = np.concatenate([sets[i] for i in chosen]).view(np.int64) if chosen else np.empty(0, np.int64)
            yield pa.record_batch([batch.column("node").take(pa.array(chosen, pa.int64())), pa.ListArray.from_arrays(ends, values)], ["node", "payload"])

    return run


class NearDuplicates(BucketLinks):
    """One run over `docs` (doc_id, text)."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs.select("doc_id", "text", F.xxhash64("text").alias("h")), size, percent
        scratch = Scratch(docs.sparkSession, "near-dedup")
        signed = self.docs.mapInArrow(_sign(size), "doc_id long, h long, n_shingles long, k1 long, k2 long, sig binary")
        self.rows = scratch.write(signed, "rows")
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first")  # nulls last
        alike = self.rows.where("n_shingles > 0").groupBy("k1", "k2").agg(first, F.any_value("sig").alias("sig"), F.max("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
        alike = alike.select("k1", "k2", F.col("first.doc_id").alias("rep"), F.col("first.h").alias("rep_h"), "sig", (8 * F.col("n_shingles")).alias("bytes"), "n")
        self.classes = scratch.write(alike.withColumn("node", F.monotonically_increasing_id()), "classes")
        super().__init__(scratch, self.classes.select("node", "sig", "bytes"), Jaccard(percent))

    def members(self) -> DataFrame:
        """(leader, node) of classes that share a bucket with a smaller one, its smallest."""
        bands = self.classes.select("node", "sig").mapInArrow(_bands, "key long, node long")
        leaders = bands.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
        return self.scratch.write(bands.join(leaders, "key").where("node != leader").select("leader", "node").distinct(), "members")

    def payloads(self, nodes: DataFrame) -> DataFrame:
        """The shingle sets of (node), from the texts of one document of each class."""
        return self.scratch.write(self.texts_of(nodes).mapInArrow(_sets(self.size), "node long, payload array<long>").dropDuplicates(["node"]), "sets")

    def texts_of(self, nodes: DataFrame) -> DataFrame:
        """(text, node, k1, k2): a document is looked up by doc_id and text, as many may share a doc_id or have none."""
        wanted = nodes.join(self.classes.select("node", "rep", "rep_h", "k1", "k2"), "node")
        return self.docs.join(wanted, self.docs["doc_id"].eqNullSafe(wanted["rep"]) & (self.docs["h"] == wanted["rep_h"])).select("text", "node", "k1", "k2")

    def verified(self, pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        sets = self.payloads(self.scratch.write(nodes, "nodes"))
        one, other = (sets.select(F.col("node").alias(x), F.col("payload").alias(f"m{x}")) for x in "ab")
        shared = F.size(F.array_intersect("ma", "mb")).cast("long")
        all_of = F.size("ma") + F.size("mb") - shared
        # b first: the shuffle to a then carries one set a pair; that of a leader with many members is salted
        links = spread_join(pairs.join(other, "b"), one, "a", pairs).where(100 * shared >= self.percent * all_of).select("a", "b")
        return self.scratch.write(links, "links")

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, kept, h), one row per row of the input; h is xxhash64 of its text."""
        found = self.classes.select("k1", "k2", "rep", "n", "node").join(self.components(self.members()), "node", "left")
        found = self.scratch.write(found.withColumn("component", F.coalesce("component", "node")), "found")
        least = self.scratch.write(found.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("size")), "least")
        named = skew_join(found, least, ["component"], "size", self.classes.count())
        lookup = self.scratch.write(named.select("k1", "k2", "n", F.col("found.component_id").alias("component_id")), "lookup")
        rows = skew_join(self.rows.select("doc_id", "h", "n_shingles", "k1", "k2"), lookup, ["k1", "k2"], "n", self.rows.count())
        component = F.when(F.col("n_shingles") > 0, F.col("found.component_id")).otherwise(F.col("doc_id"))
        out = rows.withColumn("component_id", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        return out.select("doc_id", "n_shingles", "component_id", "kept", "h")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of documents linked at a Jaccard similarity of `percent` / 100."""
    return NearDuplicates(docs, size, percent).result().drop("h")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay: of each component, those with its smallest doc_id."""
    gone = NearDuplicates(docs, size, percent).result().where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_h")), "left_anti")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)

"""Links between classes that share buckets, joined into components, whatever the size of a bucket.

Round 1 pairs each member with its bucket's leader, the smallest member: a cheap check of the two summaries, then
the exact one. That joins what most buckets hold. Round 2 is for leaders whose buckets still hold several
components. Their members, each once per leader, are dealt into blocks: those outside the leader's most frequent
component on one side, all on the other. Summaries are compared block against block and across components only; the
members with a plausible partner are dealt again with what the exact check needs, and it runs inside the blocks.
A block gives at most one link for a member and a component, so no bucket's pairs are ever rows, nothing is capped,
and the components are those of all links between members of one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.common import Scratch, group_starts, groups, skew_join, spread_join
from newsdesk.llm.components import components, joined_components

#: Members of a side of a block, and the bytes of payload that count as one: a side has about 4 MB at most, or one payload.
BLOCK, UNIT = 512, 8192


class Similarity:
    """What links two classes: a cheap check of summaries (bytes of one length each) and the exact one of payloads."""

    def matrix(self, summaries: list[bytes]) -> np.ndarray:
        """One row for each summary."""
        raise NotImplementedError

    def plausible(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Rows at which the two matrices (or one row and a matrix) may belong to a link."""
        raise NotImplementedError

    def linked(self, sides: list[tuple[list, list, np.ndarray]]) -> Iterator[tuple[int, int, np.ndarray]]:
        """For groups of (one, other, apart): the group, the row of `one` and the rows of `other` that are linked with it;
        apart[i, j] says which pairs matter."""
        raise NotImplementedError


def _sides(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each group (leader, left, right) the rows of its two sides, if it has both."""
    starts = np.append(group_starts(rows, ["leader", "left", "right"]), rows.num_rows)
    is_left = rows.column("is_left").to_numpy(zero_copy_only=False)
    for at, to in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        side = is_left[at:to]
        if side.any() and not side.all():
            yield at + np.flatnonzero(side), at + np.flatnonzero(~side)


def _plausible(kind: Similarity):
    """(leader, node) of members with a plausible partner across components in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["leader", "left", "right"]):
            label = rows.column("label").to_numpy()
            matrix = kind.matrix(rows.column("sig").to_pylist())
            hit = np.zeros(rows.num_rows, bool)
            for one, other in _sides(rows):
                for i in one.tolist():
                    apart = other[label[other] != label[i]]
                    found = apart[kind.plausible(matrix[i], matrix[apart])]
                    if len(found):
                        hit[i] = True
                        hit[found] = True
            yield from rows.select(["leader", "node"]).filter(pa.array(hit)).to_batches()

    return run


def _links(kind: Similarity):
    """(a, b) of linked members across components: one for each member of the left side and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["leader", "left", "right"]):
            label, node = rows.column("label").to_numpy(), rows.column("node").to_numpy()
            payload = rows.column("payload").combine_chunks() if isinstance(rows.column("payload"), pa.ChunkedArray) else rows.column("payload")
            members, sides, a, b = [], [], [], []
            for one, other in _sides(rows):
                apart = label[one][:, None] != label[other][None]
                some = other[apart.any(axis=0)]
                members.append((one, some))
                sides.append((*(_values(payload.take(pa.array(x))) for x in (one, some)), apart[:, apart.any(axis=0)]))
            for g, i, found in kind.linked(sides):
                one, some = members[g]
                first = found[np.unique(label[some[found]], return_index=True)[1]]
                a.append(np.full(len(first), node[one[i]]))
                b.append(node[some[first]])
            if a:
                yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _values(column: pa.Array) -> list:
    if pa.types.is_list(column.type):
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return column.to_pylist()


class BucketLinks:
    def __init__(self, scratch: Scratch, summaries: DataFrame, kind: Similarity):
        """summaries: (node, sig, bytes), `bytes` being the size of the node's payload."""
        self.scratch, self.summaries, self.kind = scratch, summaries, kind

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of (a, b), those that are links."""
        raise NotImplementedError

    def payloads(self, nodes: DataFrame) -> DataFrame:
        """(node, payload) that the exact check needs, for (node)."""
        raise NotImplementedError

    def pruned(self, pairs: DataFrame) -> DataFrame:
        """Of (a, b), those that the cheap check lets pass."""
        kind = self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = kind.plausible(kind.matrix(batch.column("sa").to_pylist()), kind.matrix(batch.column("sb").to_pylist()))
                    yield batch.select(["a", "b"]).take(pa.array(found))

        one, other = (self.summaries.select(F.col("node").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
        return spread_join(pairs, one, "a", pairs).join(other, "b").mapInArrow(run, "a long, b long")

    def components(self, members: DataFrame) -> DataFrame:
        """(node, component) of the nodes that have a link; members: written (leader, node) with node != leader."""
        before = self.scratch.n
        stars = members.select(F.col("leader").alias("a"), F.col("node").alias("b"))  # of the two only a leader may be in many
        tested = self.scratch.write(self.pruned(stars), "pairs")
        found = self.scratch.write(components(self.verified(tested), self.scratch), "components")

        everyone = members.unionByName(members.select("leader", F.col("leader").alias("node")).distinct())
        label = F.coalesce("component", "node").alias("label")
        rows = self.scratch.write(everyone.join(found, "node", "left").select("leader", "node", label), "labelled")
        hit = self.dealt(rows.withColumn("weight", F.lit(1.0))).join(self.summaries.select("node", "sig"), "node")
        hit = self.in_groups(hit, "sig").mapInArrow(_plausible(self.kind), "leader long, node long").distinct()
        weight = F.greatest(F.lit(1.0), F.col("bytes") / UNIT).alias("weight")
        hit = hit.join(found, "node", "left").join(self.summaries.select("node", "bytes"), "node")
        hit = self.scratch.write(hit.select("leader", "node", label, weight), "residual")
        nodes = self.scratch.write(hit.select("node").distinct(), "nodes")
        links = self.dealt(hit).join(self.payloads(nodes), "node")
        links = self.scratch.write(self.in_groups(links, "payload").mapInArrow(_links(self.kind), "a long, b long").distinct(), "links")
        joined = self.scratch.write(joined_components(found, links, self.scratch), "components")
        self.scratch.drop_since(before, joined)
        return joined

    def dealt(self, rows: DataFrame) -> DataFrame:
        """(leader, left, right, is_left, node, label): the two sides of each leader's rows (leader, node, label, weight), in
        blocks of about BLOCK members of weight 1."""
        sizes = rows.groupBy("leader", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
        sizes = sizes.groupBy("leader").agg(
            F.max_by("label", "n").alias("main"), F.sum("n").alias("all"), F.sum("weight").alias("whole"), F.max_by("weight", "n").alias("in_main"), F.count("*").alias("labels")
        )
        sizes = self.scratch.write(sizes.where("labels > 1").drop("labels"), "sizes")
        rows = skew_join(rows, sizes, ["leader"], "all", rows.count()).where("found is not null").select("leader", "node", "label", "found.*")
        lefts = F.greatest(F.lit(1), F.ceil((F.col("whole") - F.col("in_main")) / BLOCK).cast("int"))
        rights = F.greatest(F.lit(1), F.ceil(F.col("whole") / BLOCK).cast("int"))
        block = lambda n: F.pmod(F.hash("node"), n)
        spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = rows.where("label != main").select("leader", block(lefts).alias("left"), spread(rights).alias("right"), F.lit(True).alias("is_left"), "node", "label")
        right = rows.select("leader", spread(lefts).alias("left"), block(rights).alias("right"), F.lit(False).alias("is_left"), "node", "label")
        return left.unionByName(right)

    @staticmethod
    def in_groups(rows: DataFrame, *more: str) -> DataFrame:
        key = ["leader", "left", "right"]
        return rows.select(*key, "is_left", "node", "label", *more).repartition(*key).sortWithinPartitions(*key)

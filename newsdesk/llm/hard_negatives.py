"""Hard negatives by cover trees over norm-augmented vectors.

With one more component, sqrt(M^2 - |x|^2), every vector has the norm M, so that an inner product with an anchor is
(|q|^2 + M^2 - d^2) / 2 for their distance d. A node of a cover tree has one of its vectors as centre and a covering
radius; the distance to the centre, less and plus the radius, bounds the inner products of all that it covers.

The uppermost level is a net of at most `pivots` vectors of a bounded sample (farthest first, radii halving in effect);
every row is then assigned to its nearest pivot, and the covering radii are taken over all rows. Rows are dealt in
groups of about `group_rows`: small pivots share a group, a large one is spread over several by a hash. An anchor goes
to the groups of those pivots that its windows can reach. In a group a tree is built of all its rows, level by level:
a node's children are a net of half its radius, or of `FAN` centres where that is more (vectors without structure at
that scale), until a node has at most `LEAF` rows. Blocks of anchors descend it together, best bound first; nodes
outside an anchor's windows, or below the k-th it has found, are skipped, leaves are verified with exact integers.
The best of each group are then combined. All bounds are exact, so the result is too; the sample decides only speed.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part; missing components
of shorter vectors count as zero; a null vec_id is no anchor and comes last among ties; repeated rows are rows of
their own, so a repeated anchor has its result repeated; where products may exceed 2^62, including the row number that
parts ties, an error says so; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsdesk.llm.common import Scratch, table

LEAF, FAN, ANCHORS = 512, 64, 128
NO_KEY = np.iinfo(np.int64).min
FOUND = "anchor long, anchor_id long, positive_id long, positive_rank int, positive_score long, number long, vec_id long, score long"


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = rows.select("vec_id", F.col("label").cast("long").alias("label"), x.alias("x"), odd.alias("odd")).where("label is not null and x is not null and not odd")
    return good.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of float64, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(column)), sizes), at] = flat
    return out


def net(points: np.ndarray, most: int, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres of a net of half the covering radius of points[first], farthest first, at most `most`; each point's centre and distance."""
    square = (points * points).sum(1)

    def away(c: int) -> np.ndarray:
        d = square + square[c] - 2 * (points @ points[c])
        return np.where(d < 0.5, 0, d)  # vectors of whole numbers that aren't equal are 1 apart at least

    least, own, centres = away(first), np.zeros(len(points), np.int64), [first]
    aim = least.max() / 4
    while least.max() > aim and len(centres) < most:
        centres.append(int(least.argmax()))
        d = away(centres[-1])
        closer = d < least
        least[closer], own[closer] = d[closer], len(centres) - 1
    return np.array(centres), own, np.sqrt(least)


class Tree:
    """A cover tree of a group's rows: for each node its centre, covering radius, and children or rows."""

    def __init__(self, x: np.ndarray, size: float):
        """size: M; rows are sorted by vec_id."""
        self.x = x
        norms = (x * x).sum(1)
        self.points = np.concatenate([x, np.sqrt(np.maximum(size * size - norms, 0))[:, None]], 1)
        self.centre, self.radius, self.children, self.rows = [], [], [], []
        self._add(np.arange(len(x)), 0, None)

    def _add(self, rows: np.ndarray, centre: int, distance: np.ndarray | None) -> int:
        if distance is None:
            distance = np.sqrt(np.maximum(((self.points[rows] - self.points[centre]) ** 2).sum(1), 0))
        node = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(distance.max()))
        self.children.append([])
        self.rows.append(rows)
        if len(rows) > LEAF:
            centres, own, far = net(self.points[rows], FAN, int(np.flatnonzero(rows == centre)[0]))
            parts = [(rows[own == k], int(rows[c]), far[own == k]) for k, c in enumerate(centres)]
            if len(parts) == 1:  # equal vectors, in order of vec_id
                parts = [(rows[a : a + LEAF], centre, distance[a : a + LEAF]) for a in range(0, len(rows), LEAF)]
            self.rows[node] = rows[:1]  # rows are in order: the first parts ties best
            self.children[node] = [self._add(*p) for p in parts]
        return node


def search(tree: Tree, labels: np.ndarray, numbers: np.ndarray, size: float, q: np.ndarray, q_labels: np.ndarray, q_numbers: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> np.ndarray:
    """Keys (product * rows + order) of the best k rows, for anchors `q` and windows low..high of products (anchors x windows).

    same: of the anchor's label, other than itself; else of other labels.
    """
    n, many = len(tree.x), q.shape[0]
    best = np.full((many, low.shape[1], k), NO_KEY, np.int64)
    norms = (q * q).sum(1)
    centre, radius = np.array(tree.centre), np.array(tree.radius)

    def bounds(node: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most and least products of anchors (rows) with nodes (columns), a little widened."""
        dot = q[who] @ tree.x[centre[node]].T
        whole = norms[who, None] + size * size
        d, r = np.sqrt(np.maximum(whole - 2 * dot, 0)), radius[node] * (1 + 1e-9)
        slack = 1e-6 + 1e-9 * whole
        most, least = (whole - np.maximum(d - r, 0) ** 2) / 2 + slack, (whole - (d + r) ** 2) / 2 - slack
        exact = radius[node] == 0
        most[:, exact], least[:, exact] = dot[:, exact], dot[:, exact]
        return most, least

    def wanted(most: np.ndarray, least: np.ndarray, first: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Which windows (anchors x nodes x windows) a node may still serve."""
        top = np.floor(np.minimum(most[:, :, None], high[who][:, None]))
        key = np.where(np.abs(top) < 1 << 62, top, 0).astype(np.int64) * n + (n - 1 - first)[None, :, None]
        return (least[:, :, None] <= high[who][:, None]) & (top >= low[who][:, None]) & (key > best[who][:, None, :, 0])

    everyone = np.arange(many)
    root = np.array([0])
    most, least = bounds(root, everyone)
    queue = [(-float(most.max(initial=-np.inf)), 0, everyone, most[:, 0], least[:, 0])]
    while queue:
        _, node, who, most, least = heapq.heappop(queue)
        first = tree.rows[node][:1]
        use = wanted(most[:, None], least[:, None], first, who)[:, 0].any(1)
        if not use.any():
            continue
        who = who[use]
        if tree.children[node]:
            below = np.array(tree.children[node])
            most, least = bounds(below, who)
            use = wanted(most, least, np.array([tree.rows[c][0] for c in below]), who).any(2)
            for c in np.flatnonzero(use.any(0)):
                mine = use[:, c]
                heapq.heappush(queue, (-float(most[mine, c].max()), int(below[c]), who[mine], most[mine, c], least[mine, c]))
            continue
        rows = tree.rows[node]
        score = q[who] @ tree.x[rows].T
        fits = labels[rows][None] == q_labels[who, None]
        fits = fits & (numbers[rows][None] != q_numbers[who, None]) if same else ~fits
        key = score.astype(np.int64) * n + (n - 1 - rows)[None]
        for w in range(low.shape[1]):
            ok = fits & (score >= low[who, w, None]) & (score <= high[who, w, None]) & (key > best[who, w, :1])
            some = np.flatnonzero(ok.any(1))
            if len(some):
                both = np.concatenate([best[who[some], w], np.where(ok[some], key[some], NO_KEY)], 1)
                best[who[some], w] = np.sort(np.partition(both, both.shape[1] - k, 1)[:, -k:], 1)
    return best


def _windows(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Products n with low * score <= 100 * n <= high * score, by whole numbers."""
    return -((-low * score) // 100), (high * score) // 100


def _place(pivots: np.ndarray, size: float, width: int):
    """Rows with their nearest pivot and the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"), width)
            norms = (x * x).sum(1)
            x = np.concatenate([x, np.sqrt(np.maximum(size * size - norms, 0))[:, None]], 1)
            d = np.maximum(norms[:, None] + (size * size - norms)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T), 0)
            near = d.argmin(1)
            yield batch.append_column("pivot", pa.array(near, pa.int32())).append_column("distance", pa.array(np.sqrt(d[np.arange(len(x)), near])))

    return run


def _reach(pivots: np.ndarray, radius: np.ndarray, size: float, width: int):
    """(number, pivot) of the pivots whose rows an anchor's windows may hold; low and high bound the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("v"), width)
            whole = (q * q).sum(1)[:, None] + size * size
            d = np.sqrt(np.maximum(whole - 2 * (q @ pivots[:, :-1].T), 0))
            slack = 1e-3 + 1e-9 * whole
            most, least = (whole - np.maximum(d - radius, 0) ** 2) / 2 + slack, (whole - (d + radius) ** 2) / 2 - slack
            low, high = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("low", "high"))
            a, p = np.nonzero((most >= low[:, None]) & (least <= high[:, None]))
            yield pa.record_batch([batch.column("number").take(pa.array(a)), pa.array(p, pa.int32())], ["number", "pivot"])

    return run


class _Group:
    """The rows of one group, in order of vec_id, and their tree."""

    def __init__(self, held: list[pa.RecordBatch], size: float, width: int):
        rows = pa.Table.from_batches(held).combine_chunks()
        ids = rows.column("vec_id").combine_chunks()
        order = np.lexsort((rows.column("number").to_numpy(), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
        rows = rows.take(pa.array(order))
        self.labels, self.numbers, self.ids = rows.column("label").to_numpy(), rows.column("number").to_numpy(), rows.column("vec_id").combine_chunks()
        self.tree = Tree(matrix(rows.column("v"), width), size)


def _answer(group: _Group, rows: pa.RecordBatch, size: float, width: int, k: int, window: tuple[int, int] | None) -> pa.RecordBatch:
    """The best rows of a group for a block of anchors."""
    q, n = matrix(rows.column("v"), width), len(group.labels)
    largest = size * max(float(np.sqrt((q * q).sum(1).max())), 1)
    if largest * n >= 1 << 62 or largest >= 1 << 53:
        raise ValueError("inner products of these vectors are too large to be compared exactly")
    scores = [np.array(s, np.int64) for s in rows.column("scores").to_pylist()]
    shape = (len(q), 1 if window is None else max(map(len, scores)))
    low, high = (np.full(shape, -np.inf), np.full(shape, np.inf)) if window is None else (np.full(shape, np.inf), np.full(shape, -np.inf))
    for i, s in enumerate(scores if window else []):
        low[i, : len(s)], high[i, : len(s)] = _windows(s, *window)
    found = search(group.tree, group.labels, group.numbers, size, q, rows.column("label").to_numpy(), rows.column("number").to_numpy(), low, high, k, window is None)
    a, w, slot = np.nonzero(found != NO_KEY)
    score, row = found[a, w, slot] // n, pa.array(n - 1 - found[a, w, slot] % n)
    if window:
        ids = rows.column("positives").to_pylist()
        of = [pa.array([ids[i][j] for i, j in zip(a.tolist(), w.tolist(), strict=True)], pa.int64()), pa.array(w + 1, pa.int32())]
        of.append(pa.array([int(scores[i][j]) for i, j in zip(a.tolist(), w.tolist(), strict=True)], pa.int64()))
    else:
        of = [pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int64())]
    at = pa.array(a)
    columns = [rows.column("number").take(at), rows.column("vec_id").take(at), *of, pa.array(group.numbers).take(row), group.ids.take(row), pa.array(score)]
    return pa.record_batch(columns, ["anchor", "anchor_id", "positive_id", "positive_rank", "positive_score", "number", "vec_id", "score"])


def _search(size: float, width: int, k: int, window: tuple[int, int] | None):
    """Groups' best rows for each anchor; a group's rows come before the anchors that were sent to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, group = None, [], None
        for batch in batches:
            keys, asks = batch.column("group").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if keys[a] != key:
                    key, held, group = keys[a], [], None
                if not asks[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    group, held = _Group(held, size, width), []
                for at in range(a, b if group else a, ANCHORS):
                    yield _answer(group, batch.slice(at, min(ANCHORS, b - at)), size, width, k, window)

    return run


class Index:
    """The rows of a table by pivots and groups."""

    def __init__(self, rows: DataFrame, pivots: int = 64, sample: int = 4096, group_rows: tuple[int, int] = (4096, 1 << 17), lane_anchors: int = 1 << 17):
        """rows: see quantised(). group_rows: least and most rows of a group; lane_anchors: anchors a task, about."""
        spark = rows.sparkSession
        self.lane_anchors = lane_anchors
        self.scratch = Scratch(spark, "hard-negatives")
        self.rows = self.scratch.write(rows.withColumn("number", F.monotonically_increasing_id()), "rows")
        square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
        most = self.rows.agg(F.sqrt(F.max(square)).alias("size"), F.max(F.size("v")).alias("width")).first()  # one row
        self.size, self.width = most.size or 0.0, most.width or 0
        some = self.rows.orderBy(F.xxhash64("v", "vec_id"), "number").limit(sample).select("v").toPandas()["v"]  # a bounded sample
        x = np.zeros((len(some), self.width))
        for k, v in enumerate(some):
            x[k, : len(v)] = v
        points = np.concatenate([x, np.sqrt(np.maximum(self.size**2 - (x * x).sum(1), 0))[:, None]], 1)
        centres = net(points, pivots)[0] if len(points) else np.empty(0, int)
        self.pivots = points[centres] if len(points) else np.zeros((1, self.width + 1))
        placed = self.rows.mapInArrow(_place(self.pivots, self.size, self.width), "vec_id long, label long, v array<long>, number long, pivot int, distance double")
        self.placed = self.scratch.write(placed, "placed")
        known = {r.pivot: r for r in self.placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}  # a row a pivot
        self.radius = np.array([known[p].radius if p in known else -np.inf for p in range(len(self.pivots))])
        total, tasks = sum(r.n for r in known.values()), int(spark.conf.get("spark.sql.shuffle.partitions"))
        group_rows = min(max(group_rows[0], total // tasks), group_rows[1])
        spread, group, full = [], 0, 0
        for p in sorted(known):
            n = known[p].n
            if full and full + n > group_rows:
                group, full = group + 1, 0
            parts = -(-n // group_rows)
            spread.append((p, group, parts))
            group, full = (group + parts, 0) if parts > 1 else (group, full + n)
        self.spread = spark.createDataFrame(spread, "pivot int, first long, parts long")  # a row a pivot
        part = F.pmod(F.xxhash64("number"), F.col("parts"))
        self.dealt = self.placed.join(F.broadcast(self.spread), "pivot").select("vec_id", "label", "v", "number", (F.col("first") + part).alias("group"))

    def best(self, anchors: DataFrame, k: int, window: tuple[int, int] | None) -> DataFrame:
        """The best k of each group for each anchor: of its label or, with a window of hundredths of its `scores`, of others.

        anchors: (vec_id, label, v, number, scores, positives).
        """
        low, high = (F.lit(-float("inf")), F.lit(float("inf"))) if window is None else (F.array_min(F.transform("scores", lambda s: s * window[0] / 100)) - 1, F.array_max(F.transform("scores", lambda s: s * window[1] / 100)) + 1)
        asked = anchors.select("number", "v", low.alias("low"), high.alias("high"))
        reached = asked.mapInArrow(_reach(self.pivots, self.radius, self.size, self.width), "number long, pivot int")
        to = reached.join(F.broadcast(self.spread), "pivot").select("number", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("group")).distinct()
        none = F.array().cast("array<long>")
        lanes = -(-anchors.count() // self.lane_anchors)  # a group's rows go to each lane of anchors
        lane = F.pmod(F.xxhash64("number"), F.lit(max(1, lanes)))
        key = lambda lane: (F.col("group") * max(1, lanes) + lane).alias("group")
        sent = anchors.join(to, "number").select("vec_id", "label", "v", "number", key(lane), F.lit(True).alias("asks"), "scores", "positives")
        every = F.explode(F.sequence(F.lit(0), F.lit(max(0, lanes - 1)))).alias("lane")
        rows = self.dealt.select("*", every).select("vec_id", "label", "v", "number", key(F.col("lane")), F.lit(False).alias("asks"), none.alias("scores"), none.alias("positives"))
        both = rows.unionByName(sent).repartition("group").sortWithinPartitions("group", "asks")
        return both.mapInArrow(_search(self.size, self.width, k, window), FOUND)


def best_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best k of the groups' best, with `rank`."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "number")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: F.Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), **options) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchors` holds.

    rows: see quantised(). The negatives of an anchor and a positive are the best of other labels whose product with the
    anchor is between the window's hundredths of the positive's.
    """
    index = Index(rows, **options)
    none = F.array().cast("array<long>")
    asked = index.rows.where(anchors).withColumn("scores", none).withColumn("positives", none)
    near = best_of(index.best(asked, positives, None), ["anchor"], positives)
    each = F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id")))  # at most `positives`
    known = near.groupBy("anchor").agg(each.alias("p")).select(F.col("anchor").alias("number"), F.col("p.score").alias("scores"), F.col("p.vec_id").alias("positives"))
    asked = index.scratch.write(index.rows.where(anchors).join(known, "number"), "anchors")
    found = best_of(index.best(asked, negatives, window), ["anchor", "positive_rank"], negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH q AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), dots AS (
  SELECT a.n AS a, a.vec_id AS anchor_id, x.n, x.vec_id, x.label = a.label AS same, list_dot_product(a.v, x.v)::BIGINT AS score
  FROM q a JOIN q x ON a.n <> x.n WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM dots WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, n) <= 5
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, d.vec_id AS negative_id, d.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.n ORDER BY d.score DESC, d.vec_id, d.n)::INT AS rank
  FROM positives p JOIN dots d ON d.a = p.a AND NOT d.same AND 30 * p.score <= 100 * d.score AND 100 * d.score <= 90 * p.score
) SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""

"""Best-fit packing by linear grouping.

Only the histogram of piece lengths (at most `capacity` counts) reaches the driver. There, pieces above
`small` tokens are split, in descending order, into groups of equal cardinality whose lengths count as the
group's largest (linear grouping); configurations of these few sizes that fill a sequence are optimised by column
generation; each planned slot is then given an actual piece of its group, and what room the rounding and the
configurations leave is filled with the small pieces, best fit first. The plan is a table of runs
"the i-th to j-th pieces of length L go to sequences s.. at offset o", whose size depends on the capacity and the
number of groups, not on the number of documents. Spark ranks the pieces by (length, doc_id, piece) with one
range sort and each task looks its pieces up in the plan.

Defined cases: a null text counts as empty and is one piece, the end id alone; repeated rows are packed each, also
those of one doc_id or none; other columns are left behind; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from newsdesk.llm.common import Scratch, slices, table
from newsdesk.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = encoder(path)
        end = np.array([end_id], "<u4")
        for batch in slices(batches, "text"):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), chunks.encode_all(batch.column("text")), strict=True):
                ids = np.concatenate([ids.astype("<u4"), end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at : at + capacity]
                    rows.append((doc, k, at, len(piece), zlib.crc32(piece.tobytes())))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], NAMES)

    return run


# The plan. A run is [length, first rank, count]; bins with equal content are kept as runs of sequence numbers.


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(items of each size, times) from the cutting-stock relaxation, rounded down.

    Column generation: the basis starts with one size a configuration; the dual prices go to a knapsack over the
    capacity, whose best filling enters, until none is worth more than a sequence.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        best = np.zeros(capacity + 1)
        took = []
        for _ in range(int(capacity // sizes.min())):  # one more item each time
            value, which = best.copy(), np.full(capacity + 1, -1)
            for j, s in enumerate(sizes):
                tried = best[: capacity + 1 - s] + price[j]
                better = tried > value[s:] + 1e-12
                value[s:][better], which[s:][better] = tried[better], j
            if (which < 0).all():
                break
            took.append(which)
            best = value
        if best[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(k), capacity
        for which in reversed(took):
            if which[room] >= 0:
                column[which[room]] += 1
                room -= sizes[which[room]]
        amount, change = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, np.maximum(amount, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    amount = np.linalg.solve(basis, demand)
    return [(basis[:, i].astype(int), int(np.floor(max(amount[i], 0) + 1e-9))) for i in range(k)]


class Plan:
    """Runs of (length, first rank, count, first sequence, offset), sorted by length and rank."""

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int = 192, small: int | None = None):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.next = defaultdict(int)  # length -> rank of the next piece without a place
        self.left = {n: c for n, c in histogram.items() if c}
        self.room: dict[int, list[list[int]]] = defaultdict(list)  # room -> runs of [first sequence, count]
        small = capacity // 3 if small is None else small
        if n := self.left.get(capacity):
            self._open(capacity, n)
        large = sorted((n for n in self.left if n > small), reverse=True)
        if large:
            self._large(large, groups)
        for n in sorted(self.left, reverse=True):
            self._best_fit(n)
        self.runs.sort()

    def _place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.next[length], count, sequence, offset))
        self.next[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def _open(self, length: int, bins: int) -> None:
        """New sequences that each begin with one piece of this length."""
        self._place(length, bins, self.sequences, 0)
        if length < self.capacity:
            self.room[self.capacity - length].append([self.sequences, bins])
        self.sequences += bins

    def _large(self, lengths: list[int], groups: int) -> None:
        total = sum(self.left[n] for n in lengths)
        size = -(-total // groups)
        members: list[list[list[int]]] = []  # of each group, runs of [length, count]
        filled = size
        for n in lengths:
            count = self.left[n]
            while count:
                if filled == size:
                    members.append([])
                    filled = 0
                take = min(count, size - filled)
                members[-1].append([n, take])
                filled += take
                count -= take
        merged: list[list] = []  # groups that round to one size are one
        for m in members:
            if merged and merged[-1][0][0] == m[0][0]:
                merged[-1] += m
            else:
                merged.append(m)
        sizes = np.array([m[0][0] for m in merged])
        demand = np.array([float(sum(c for _, c in m)) for m in merged])
        for items, times in _configurations(sizes, demand, self.capacity):
            slots = np.repeat(np.arange(len(sizes)), items)
            have = [sum(c for _, c in m) for m in merged]
            times = min([times, *(have[j] // items[j] for j in set(slots.tolist()))]) if len(slots) else 0
            if not times:
                continue
            bins = [[self.sequences, times, 0]]  # first sequence, count, used
            self.sequences += times
            for j in slots:
                bins = self._substitute(merged[j], bins)
            for first, count, used in bins:
                self.room[self.capacity - used].append([first, count])

    def _substitute(self, group: list[list[int]], bins: list[list[int]]) -> list[list[int]]:
        """Actual pieces of a group into one slot of each bin; bins split into runs where the lengths change."""
        out = []
        for first, count, used in bins:
            while count:
                length, have = group[0]
                take = min(count, have)
                self._place(length, take, first, used)
                out.append([first, take, used + length])
                first, count = first + take, count - take
                group[0][1] -= take
                if not group[0][1]:
                    group.pop(0)
        return out

    def _best_fit(self, length: int) -> None:
        """Each piece goes to the fullest sequence that has room for it, or to a new one."""
        while count := self.left.get(length, 0):
            fits = min((r for r, runs in self.room.items() if r >= length and runs), default=None)
            if fits is None:
                self._open(length, -(-count // (self.capacity // length)))
                continue
            run = self.room[fits].pop()
            take = min(count, run[1])
            self._place(length, take, run[0], self.capacity - fits)
            if fits > length:
                self.room[fits - length].append([run[0], take])
            if take < run[1]:
                self.room[fits].append([run[0] + take, run[1] - take])
            if not self.room[fits]:
                del self.room[fits]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(c, np.int64) for c in zip(*self.runs, strict=True)) if self.runs else (np.empty(0, np.int64),) * 5


def best_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """The grouped plan, or best fit alone where that takes fewer sequences; both are made from the histogram."""
    return min((Plan(histogram, capacity), Plan(histogram, capacity, small=capacity)), key=lambda plan: plan.sequences)


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the part and the position in it: with one count per part, every piece's rank in the whole order."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))]
        at += n
        yield pa.record_batch(columns, [*batch.schema.names, "part", "at"])


def _look_up(plan, before):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (first, sequence, offset), starts = plan.value, before
        for batch in batches:
            rank = np.array([starts[p] for p in batch.column("part").to_pylist()], np.int64) + batch.column("at").to_numpy()
            run = np.searchsorted(first, rank, "right") - 1
            columns = [*batch.select(NAMES).columns, pa.array(sequence[run] + rank - first[run]), pa.array(offset[run])]
            yield pa.record_batch(columns, [*NAMES, "sequence_id", "offset"])

    return run


def place(pieces: DataFrame, scratch: Scratch, capacity: int) -> DataFrame:
    """(pieces, sequence_id, offset) for written pieces."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = best_plan(histogram, capacity)
    order = ["length", "doc_id", "piece", "ids_crc32"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64(F.monotonically_increasing_id())  # parts equal pieces
    ranked = pieces.repartitionByRange(parts, *order, spread).sortWithinPartitions(*order).mapInArrow(_rank, f"{PIECES}, part int, at long")
    ranked = scratch.write(ranked, "ranked")
    sums = ranked.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # one row per part
    before = dict(zip([r["part"] for r in sums], np.cumsum([0, *(r["n"] for r in sums)]).tolist(), strict=False))
    base, total = {}, 0
    for n in sorted(histogram):
        base[n], total = total, total + histogram[n]
    length, rank, _, sequence, offset = plan.arrays()
    first = rank + np.array([base[n] for n in length.tolist()], np.int64)
    shared = spark.sparkContext.broadcast((first, sequence, offset))
    return ranked.mapInArrow(_look_up(shared, before), f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, scratch: Scratch | None = None) -> DataFrame:
    """Every piece of every document, with its sequence and its place there."""
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    cut = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, end_id, capacity), PIECES)
    return place(scratch.write(cut, "pieces"), scratch, capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

"""Line deduplication by a segment-partition edit join (after Li, Deng, Wang and Feng's Pass-Join, 2011).

Lines within `tau` edits of each other are linked, equal lines too; of each connected group of lines the occurrence
with the smallest (doc_id, position) stays. A line is cut into tau + 1 segments; a line within tau edits of it holds
at least one of them unchanged, at a place that the two lengths narrow down. So every distinct line is indexed under
(length, segment number, segment) and probes the indexes of its own and the tau shorter lengths with the substrings
at the places that the multi-match-aware bounds leave, (tau^2 - d^2) / 2 + tau + 1 at most for a length difference of
d. Index and probes meet in one shuffle; candidate pairs are verified with a banded bit-parallel edit distance over
code points, in step for a batch of pairs. Large buckets: see bucket_links.

Lines of at most tau characters have no such segment. They and the lines of at most 2 tau, with which alone they can
be linked, meet under what is left of each when up to tau characters are deleted: lines within tau edits share that.

Defined cases: blank lines (white space only) stay and are not compared; lines of any other length are linked within
tau edits, so all lines of at most tau characters are linked; a null text has no lines; a null doc_id counts as larger than any other; a line at the
same place of rows with the same doc_id is one occurrence; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm.bucket_links import BucketLinks, Similarity
from newsdesk.llm.chat_format import ranges
from newsdesk.llm.common import Scratch, map_in_arrow, skew_join, slices, spread_join, table, with_fields, without
from newsdesk.llm.words import mix

U = np.uint64
LAST = (1 << 63) - 1  # stands for a null doc_id
CELLS = 16


def codes_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all lines, number of each)."""
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(x) for x in lines], np.int64)


def segment_bounds(length: np.ndarray, tau: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Where segment i of lines of this length begins, and how long it is: the last ones take the remainder."""
    short = length // (tau + 1)
    longer = length - short * (tau + 1)
    before = i * short + np.maximum(0, i - (tau + 1 - longer))
    return before, short + (i >= tau + 1 - longer)


def left_over(line: str, tau: int) -> set[int]:
    """Hashes of what a short line is after up to tau deletions."""
    kept = range(max(0, len(line) - tau), len(line) + 1)
    return {xxhash.xxh64_intdigest("".join(x).encode("utf-8", "surrogatepass"), 7) for n in kept for x in itertools.combinations(line, n)}


def entries(lines: list[str], tau: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line number, whether it is an index entry) of each entry."""
    codes, length = codes_of(lines)
    base = np.cumsum(length) - length
    power = np.cumprod(np.r_[U(1), np.full(len(codes), 0xD6E8FEB86659FD93, U)], dtype=U)
    inverse = np.cumprod(np.r_[U(1), np.full(len(codes), pow(0xD6E8FEB86659FD93, -1, 1 << 64), U)], dtype=U)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(codes.astype(U) + U(1)) * power[:-1], dtype=U)])
    keys, owners, kinds = [], [], []

    def add(who: np.ndarray, start: np.ndarray, size: np.ndarray, of: np.ndarray, i: int, index: bool) -> None:
        a = base[who] + start
        h = (sums[a + size] - sums[a]) * inverse[a]
        keys.append(mix(mix(h) + of.astype(U) * U(0x9E3779B97F4A7C15) + U(i)))
        owners.append(who)
        kinds.append(np.full(len(who), index))

    every = np.arange(len(lines))
    for i in range(tau + 1):
        add(every, *segment_bounds(length, tau, i), length, i, True)
        for d in range(tau + 1):
            other = length - d
            begin, size = segment_bounds(other, tau, i)
            low = np.maximum(np.maximum(begin - i, begin + d - (tau - i)), 0)
            high = np.minimum(np.minimum(begin + i, begin + d + (tau - i)), length - size)
            n = np.where(size > 0, np.maximum(high - low + 1, 0), 0)
            if d == 0:
                own = begin  # equal lines are one class: the index entry stands for this probe
            who = np.repeat(every, n)
            start = ranges(low, n)
            if d == 0:
                other_place = start != own[who]
                who, start = who[other_place], start[other_place]
            add(who, start, size[who], other[who], i, False)
    short = [(i, length[i] <= tau, k) for i in np.flatnonzero(length <= 2 * tau).tolist() for k in left_over(lines[i], tau)]
    keys.append(np.array([k for *_, k in short], U))
    owners.append(np.array([i for i, *_ in short], np.int64))
    kinds.append(np.array([is_short for _, is_short, _ in short], bool))
    return np.concatenate(keys).view(np.int64), np.concatenate(owners), np.concatenate(kinds)


def summaries(lines: list[str]) -> np.ndarray:
    """(lines, CELLS) counts of characters by a hash, modulo 256: tau edits change their sum of differences by 2 tau at most."""
    codes, length = codes_of(lines)
    cell = (mix(codes.astype(U)) % U(CELLS)).astype(np.int64)
    owner = np.repeat(np.arange(len(lines)), length)
    return np.bincount(owner * CELLS + cell, minlength=len(lines) * CELLS).reshape(-1, CELLS).astype(np.uint8)


def _padded(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, pad: int, before: int = 0, backwards: bool = False) -> np.ndarray:
    """(lines, width) code points, each line from column `before` on, or from its end."""
    rows = np.full((len(sizes), width), pad, np.int32)
    at = ranges(np.zeros(len(sizes), np.int64), sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rows[owner, before + (sizes[owner] - 1 - at if backwards else at)] = codes[ranges(starts, sizes)]
    return rows


def within(left: list[str], right: list[str], tau: int) -> np.ndarray:
    """Whether each pair is within tau edits.

    What both lines begin and end with is taken off first, which doesn't change their distance. Bit k of the vectors is
    diagonal k - tau of the band. The tracked diagonal ends in the last cell, and its values never fall, so a pair
    leaves when it is past tau.
    """
    ok = np.zeros(len(left), bool)
    swapped = [(b, a) if len(a) < len(b) else (a, b) for a, b in zip(left, right, strict=True)]
    order = sorted((k for k, (a, b) in enumerate(swapped) if len(a) - len(b) <= tau), key=lambda k: len(swapped[k][0]))
    bits = np.uint8 if tau <= 3 else np.int64  # sums have 2 tau + 2 bits
    at = 0
    while at < len(order):
        to = at
        while to < len(order) and (to == at or (to - at + 1) * len(swapped[order[to]][0]) <= 1 << 21):
            to += 1
        chosen = np.array(order[at:to])
        at = to
        one, n = codes_of([swapped[k][0] for k in chosen])
        other, m = codes_of([swapped[k][1] for k in chosen])
        starts = [np.cumsum(x) - x for x in (n, m)]
        width = int(n.max()) + 1
        begin, end = ((_padded(one, starts[0], n, width, -1, 0, x) != _padded(other, starts[1], m, width, -2, 0, x)).argmax(axis=1) for x in (False, True))
        end = np.minimum(end, m - begin)
        n, m = n - begin - end, m - begin - end
        width = int(n.max()) + 2 * tau + 1
        a = np.ascontiguousarray(_padded(one, starts[0] + begin, n, width, -1, tau).T)
        b = np.ascontiguousarray(_padded(other, starts[1] + begin, m, width, -2).T)
        mask = bits((1 << (2 * tau + 1)) - 1)
        plus = np.full(len(chosen), mask & ~bits((1 << tau) - 1), bits)
        minus = np.zeros(len(chosen), bits)
        distance = n - m
        mark = (tau + distance).astype(bits)
        for j in range(int(m.max())):
            match = np.zeros(len(chosen), bits)
            for k in range(2 * tau + 1):
                match |= (a[j + k] == b[j]).astype(bits) << bits(k)
            same = (((match & plus) + plus) ^ plus) | match | minus
            up = (minus | ~(same | plus)) & mask
            down = same & plus & mask
            distance += (j < m) & ((same >> mark) & bits(1) == 0)
            same = (same & mask) >> bits(1)
            plus, minus = (down | ~(same | up)) & mask, up & same
            if j % 8 == 7:
                ok[chosen[(m <= j + 1) & (distance <= tau)]] = True
                stay = (m > j + 1) & (distance <= tau)
                if 4 * stay.sum() < 3 * len(stay):
                    a, b = a[:, stay], b[:, stay]
                    plus, minus, distance, mark, m, chosen = (x[stay] for x in (plus, minus, distance, mark, m, chosen))
                    if not len(chosen):
                        break
        ok[chosen[distance <= tau]] = True
    return ok


def _entries(tau: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "line", 1 << 19):
            keys, owner, index = entries(batch.column("line").to_pylist(), tau)
            entry = 2 * batch.column("node").to_numpy()[owner] + index
            yield pa.record_batch([pa.array(keys), pa.array(entry)], ["key", "entry"])

    return run


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "line", 1 << 19):
        rows, sizes = summaries(batch.column("line").to_pylist()), pc.binary_length(batch.column("line")).cast(pa.int64())
        yield pa.record_batch([batch.column("node"), pa.array([r.tobytes() for r in rows], pa.binary()), sizes], ["node", "sig", "bytes"])


def _within(tau: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = within(batch.column("la").to_pylist(), batch.column("lb").to_pylist(), tau)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


class Edits(Similarity):
    """Counts of characters as summaries; lines by their edit distance."""

    def __init__(self, tau: int):
        self.tau = tau

    def matrix(self, summaries: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(summaries), np.int8).reshape(-1, CELLS)

    def plausible(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.abs((one - other).astype(np.int64)).sum(axis=1) <= 2 * self.tau)

    def linked(self, sides: list[tuple[list, list, np.ndarray]]) -> Iterator[tuple[int, int, np.ndarray]]:
        """The plausible pairs of all groups are verified together: within() works on them in step."""
        left, right, places = [], [], []
        for g, (one, other, apart) in enumerate(sides):
            a, b = summaries(one).view(np.int8), summaries(other).view(np.int8)
            for at in range(0, len(one), 64):
                off = np.abs(a[at : at + 64, None] - b[None]).view(np.uint8).sum(axis=2, dtype=np.uint16)
                x, y = np.nonzero((off <= 2 * self.tau) & apart[at : at + 64])
                left += [one[at + i] for i in x.tolist()]
                right += [other[i] for i in y.tolist()]
                places.append(np.stack([np.full(len(x), g), at + x, y]))
                if len(left) > 1 << 16:
                    yield from self._verified(left, right, places)
                    left, right, places = [], [], []
        if left:
            yield from self._verified(left, right, places)

    def _verified(self, left: list, right: list, places: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        g, i, j = np.concatenate(places, axis=1)[:, within(left, right, self.tau)]
        cuts = np.flatnonzero((np.diff(g, prepend=-1) != 0) | (np.diff(i, prepend=-1) != 0))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(g)], strict=False):
            yield int(g[a]), int(i[a]), j[a:b]


class LineLinks(BucketLinks):
    def __init__(self, scratch: Scratch, lines: DataFrame, tau: int):
        """lines: written (node, line)."""
        self.lines, self.tau = lines, tau
        sigs = scratch.write(lines.mapInArrow(_summaries, "node long, sig binary, bytes long"), "summaries")
        super().__init__(scratch, sigs, Edits(tau))

    def members(self) -> DataFrame:
        return self.scratch.write(self.sharing(), "members")

    def sharing(self) -> DataFrame:
        """(leader, node) of lines that share a bucket with an indexed one, the smallest of these.

        An entry is one number, twice the node plus 1 for an index entry. Both reads have the same filters below the
        shuffle, so that it is made once.
        """
        met = self.lines.mapInArrow(_entries(self.tau), "key long, entry long").where("key is not null and entry is not null").repartition("key")
        node = F.shiftright("entry", 1)
        leader = F.min(F.when(F.col("entry") % 2 == 1, node))
        ends = met.groupBy("key").agg(leader.alias("leader"), F.min(node).alias("x"), F.max(node).alias("y"))
        ends = ends.where("leader is not null and x < y").select("key", "leader")
        both = met.join(ends.hint("shuffle_hash"), "key").select("leader", node.alias("node"))
        return both.where("node != leader").distinct()

    def payloads(self, nodes: DataFrame) -> DataFrame:
        return nodes.join(self.lines.select("node", F.col("line").alias("payload")), "node")

    def verified(self, pairs: DataFrame) -> DataFrame:
        one, other = (self.lines.select(F.col("node").alias(x), F.col("line").alias(f"l{x}")) for x in "ab")
        return self.scratch.write(spread_join(pairs.join(other, "b"), one, "a", pairs).mapInArrow(_within(self.tau), "a long, b long"), "links")


def duplicate_lines(docs: DataFrame, tau: int = 2) -> DataFrame:
    """(d, text_hash, gone): for each doc_id (a null as LAST) and text the lines to drop, as (position, xxhash64 of the line).

    The hash of the text keeps rows with one doc_id (or none) from becoming one group.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    texts = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64("text").alias("text_hash"), "text")
    lines = texts.select("d", "text_hash", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    keys = [F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2")]
    place = F.struct("d", "at")
    alike = lines.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("times")).select("*", *keys)
    alike = scratch.write(alike.withColumn("node", F.monotonically_increasing_id()), "lines")
    links = LineLinks(scratch, alike.select("node", "line"), tau)
    found = links.components(links.members())
    # only lines that are not alone: those in a component, and those that occur again
    named = alike.select("node", "h1", "h2", "first", "times").join(found, "node", "left").where("component is not null or times > 1")
    named = scratch.write(named.withColumn("component", F.coalesce("component", "node")), "named")
    firsts = scratch.write(named.groupBy("component").agg(F.min("first").alias("stays"), F.count("*").alias("size")), "firsts")
    lookup = skew_join(named, firsts, ["component"], "size", named.count()).select("h1", "h2", F.col("found.stays").alias("stays"), "times")
    lookup = scratch.write(lookup, "lookup")
    each = lines.select("d", "text_hash", "at", *keys)
    rows = skew_join(each, lookup, ["h1", "h2"], "times", int(alike.agg(F.sum("times")).first()[0] or 0))
    gone = rows.where(F.col("found").isNotNull() & (place != F.col("found.stays")))
    gone = scratch.write(gone.groupBy("d", "text_hash").agg(F.collect_set(F.struct("at", "h1")).alias("gone")), "gone")
    scratch.drop_since(0, gone)
    return gone


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            lines = text.split("\n") if text is not None else []
            kept = lines
            if gone:
                drop = {(g["at"], g["h1"] & 0xFFFFFFFFFFFFFFFF) for g in gone}
                places = {at for at, _ in drop}
                kept = [x for at, x in enumerate(lines) if at not in places or (at, xxhash.xxh64_intdigest(x.encode(), 42)) not in drop]
            left = "\n".join(kept)
            rows.append((len(lines), len(lines) - len(kept), left if len(kept) < len(lines) else None, hashlib.sha256(left.encode()).hexdigest()))
        rest = [c for c in batch.schema.names if c != "gone"]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
        yield pa.record_batch([*(batch.column(c) for c in rest), *columns], [*rest, "n_lines", "n_removed", "kept", "kept_sha256"])


def remove_lines(docs: DataFrame, tau: int = 2) -> DataFrame:
    """`docs` with n_lines, n_removed, kept and kept_sha256; `kept` is null where nothing was removed."""
    rows = without(docs, "n_lines", "n_removed", "kept", "kept_sha256", "gone", "d", "text_hash")
    found = duplicate_lines(rows, tau)
    joined = rows.withColumn("d", F.coalesce("doc_id", F.lit(LAST))).withColumn("text_hash", F.xxhash64("text")).join(found, ["d", "text_hash"], "left")
    return map_in_arrow(without(joined, "d", "text_hash"), _drop, with_fields(rows, "n_lines long, n_removed long, kept string, kept_sha256 string"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_lines(docs).select("doc_id", "n_lines", "n_removed", "kept_sha256")

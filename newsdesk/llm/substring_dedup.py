"""Substring deduplication with prefix-partitioned suffix trees over words.

A window is `WINDOW` consecutive words of one document. A word goes when a window covers it whose word sequence
also starts in a document with a smaller doc_id; windows are judged on the input.

1. Documents with one and the same word sequence are represented by the smallest doc_id; the others go whole.
2. Of each window the smallest hash of `PREFIX` consecutive words is its *anchor* (a minimizer): equal windows have
   equal anchors at equal places, and one document in about 22 words has one. Windows whose anchor occurs in a
   single document cannot repeat, and their text stays where it is.
3. For the others, the stretch of text that an anchor's windows span becomes a *segment*. Equal segments are combined
   on the way, so a passage in very many documents is one segment with its smallest doc_id. Segments are dealt out by
   the anchor's words, the shared prefix of the group's suffixes.
4. A group of at most `GROUP_BYTES` fits in memory. A larger one is split by longer prefixes, of 16 and then 29 words
   with the anchor: a segment's windows that hold them behind the anchor go there, the others by as many words before
   it. What is still too large goes by all WINDOW words, where a group is one node and is combined by aggregation.
   Nothing is left out: the prefix only decides who builds a subtree.
5. A group's suffixes are ranked by prefix doubling, which is its suffix tree level by level; the internal nodes of
   depth WINDOW or more are the runs of equal rank. A leaf whose node holds a smaller doc_id marks its window, and
   marked windows in a row are one maximal repeat; each document collects these and drops their words.

Defined cases: null text has no words; a null doc_id counts as larger than any other and two nulls as equal; rows
with the same doc_id don't remove words from each other; without 50 words nothing goes; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm.chat_format import ranges
from newsdesk.llm.common import Scratch, group_starts, groups, map_in_arrow, skew_join, slices, table, with_fields, without
from newsdesk.llm.words import mix, rolled, word_hashes

U = np.uint64
WINDOW, PREFIX, LONGER = 50, 8, (16, 29)  # a window has LONGER words behind its anchor's start, or before its end
GROUP_BYTES = 8 << 20
LAST = (1 << 63) - 1  # stands for a null doc_id


def sequence_hash(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, 2) signed 64-bit hashes of each text's word sequence."""
    starts = np.cumsum(counts) - counts
    place = (np.arange(len(hashes)) - np.repeat(starts, counts)).astype(U)
    out = np.zeros((len(counts), 2), U)
    full = np.flatnonzero(counts)
    if len(full):
        for i, k in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            out[full, i] = np.add.reduceat(mix(hashes ^ (place * U(k) + U(i))), starts[full])
    return out.view(np.int64)


def anchors(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (text, first window's start, number of windows, anchor's place, anchor's hash); places count from the first text's first word."""
    across = WINDOW - PREFIX + 1
    bases = np.cumsum(counts) - counts
    windows = np.maximum(counts - WINDOW + 1, 0)
    if not windows.any():
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, U),)
    grams = rolled(hashes, PREFIX)
    bits = max(20, int(len(grams)).bit_length())
    low = U((1 << bits) - 1)
    tagged = (grams & ~low) | np.arange(len(grams), dtype=U)
    padded = np.concatenate([tagged, np.full(-len(tagged) % across + across, ~U(0))])
    blocks = padded.reshape(-1, across)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = ranges(bases, windows)
    place = (np.minimum(behind[at], ahead[at + across - 1]) & low).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), windows)
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    n = np.diff(np.append(first, len(at)))
    return owner[first], at[first], n, place[first], grams[place[first]]


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """Lists by owner (sorted)."""
    return pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32), pa.array(values))


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        hashes, counts, *_ = word_hashes(batch.column("text"), lower=False)
        keys = sequence_hash(hashes, counts)
        owner, _, _, place, h = anchors(hashes, counts)
        local = place - (np.cumsum(counts) - counts)[owner]
        columns = [batch.column("d"), batch.column("text_hash"), pa.array(counts.astype(np.int64)), pa.array(keys[:, 0]), pa.array(keys[:, 1])]
        columns += [_lists(h.view(np.int64), owner, len(counts)), _lists(local, owner, len(counts))]
        yield pa.record_batch(columns, ["d", "text_hash", "n_words", "k1", "k2", "hashes", "places"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        hashes, counts, joined, starts, ends = word_hashes(batch.column("text"), lower=False)
        keys = sequence_hash(hashes, counts)
        bases = np.cumsum(counts) - counts
        owner, first, n, place, h = anchors(hashes, counts)
        wanted = batch.column("places")
        sizes = wanted.value_lengths().to_numpy()
        known = np.repeat(bases, sizes) + wanted.flatten().to_numpy()
        same = keys[:, 0] == batch.column("k1").to_numpy()
        take = np.flatnonzero(np.isin(place, known[np.repeat(same, sizes)]) & same[owner])
        owner, first, n, h, place = owner[take], first[take], n[take], h[take], place[take]
        words = b" ".join(joined.split())
        sizes = ends - starts + 1
        at = np.cumsum(sizes) - sizes  # of each word in `words`
        texts = [words[a:b] for a, b in zip(at[first].tolist(), (at + sizes - 1)[first + n + WINDOW - 2].tolist(), strict=True)]
        values = _roll_spans(hashes, first, n + WINDOW - 1)
        columns = [pa.array(h.view(np.int64)), pa.array(values), pa.array(texts, pa.binary()).cast(pa.string()), batch.column("d").take(pa.array(owner)), batch.column("text_hash").take(pa.array(owner))]
        columns += [pa.array(keys[owner, 0]), pa.array(first - bases[owner]), pa.array(n), pa.array((place - first).astype(np.int32))]
        yield pa.record_batch(columns, ["h", "g", "segment", "d", "text_hash", "k1", "start", "n", "anchor"])


def _roll_spans(hashes: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each span of words."""
    if not len(first):
        return np.empty(0, np.int64)
    starts = np.cumsum(n) - n
    place = (np.arange(int(n.sum())) - np.repeat(starts, n)).astype(U)
    return np.add.reduceat(mix(hashes[ranges(first, n)] ^ (place * U(0x2545F4914F6CDD1D))), starts).view(np.int64)


def window_ranks(words: np.ndarray) -> np.ndarray:
    """Rank of the WINDOW words from each place on among all such sequences, by prefix doubling: order by the first 1, 2, 4 .. words.

    Places whose window leaves the array have ranks of no meaning.
    """
    ranks, length = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while length < WINDOW:
        step = min(length, WINDOW - length)
        then = np.concatenate([ranks[step:], np.zeros(step, np.int64)])
        ranks = np.unique(ranks * (int(then.max()) + 1) + then, return_inverse=True)[1].astype(np.int64)
        length += step
    return ranks


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the segments of whole groups: runs of windows that also start in a smaller document."""
    for rows in groups(batches, ["key"]):
        cuts = group_starts(rows, ["key"])
        sizes = np.cumsum(pc.binary_length(rows.column("segment")).to_numpy())
        step = np.flatnonzero(np.diff(np.append(0, sizes)[cuts] >> 20, prepend=-1))  # about 1 MB at a time, whole groups
        bounds = np.append(cuts[step], rows.num_rows)
        for at, to in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            part = rows.slice(at, to - at).combine_chunks()
            hashes, counts, *_ = word_hashes(part.column("segment"), lower=False)
            windows = counts - WINDOW + 1
            starts = ranges(np.cumsum(counts) - counts, windows)
            owner = np.repeat(np.arange(len(counts)), windows)
            low = part.column("low").to_numpy()[owner]
            ranks = window_ranks(hashes)[starts]
            order = np.argsort(ranks, kind="stable")
            node = np.flatnonzero(np.diff(ranks[order], prepend=-1))
            least = np.empty(len(order), np.int64)
            least[order] = np.repeat(np.minimum.reduceat(low[order], node), np.diff(np.append(node, len(order))))
            offset = starts - (np.cumsum(counts) - counts)[owner] + part.column("base").to_numpy()[owner]
            yield _runs(part, owner, offset, least < low)


def _runs(rows: pa.Table, owner: np.ndarray, offset: np.ndarray, marked: np.ndarray) -> pa.RecordBatch:
    """(h, g, from, to): runs of marked windows of each segment."""
    at = np.flatnonzero(marked)
    owner, offset = owner[at], offset[at]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)] if len(at) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    own = [rows.column(k).combine_chunks().take(pa.array(owner[first])) for k in ("h", "g")]
    return pa.record_batch([*own, pa.array(offset[first]), pa.array(offset[last])], ["h", "g", "from", "to"])


def _longer(words: int):
    """Segments cut in two: windows with `words` words from the anchor's start on, and the others, by words before its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "segment", 1 << 20):
            hashes, counts, joined, starts, ends = word_hashes(batch.column("segment"), lower=False)
            bases, anchor = np.cumsum(counts) - counts, batch.column("anchor").to_numpy().astype(np.int64)
            cut = np.clip(anchor - (WINDOW - words), 0, counts - WINDOW + 1)  # the first window of the right part
            grams = rolled(hashes, words)
            parts = []
            for side, some, first, last, key_at in (
                (1, np.flatnonzero(cut <= counts - WINDOW), cut, counts - 1, anchor),
                (2, np.flatnonzero(cut > 0), np.zeros_like(cut), cut + WINDOW - 2, anchor + PREFIX - words),
            ):
                keys = mix(grams[(bases + key_at)[some]] + U(side) * U(0x9E3779B97F4A7C15) + U(words))
                texts = [joined[a:b] for a, b in zip(starts[(bases + first)[some]].tolist(), ends[(bases + last)[some]].tolist(), strict=True)]
                parts.append((some, keys, texts, first[some]))
            who = np.concatenate([p[0] for p in parts])
            first = np.concatenate([p[3] for p in parts])
            columns = [pa.array(np.concatenate([p[1] for p in parts]).view(np.int64))] + [batch.column(k).take(pa.array(who)) for k in ("h", "g", "low", "high")]
            columns += [pa.array(first + batch.column("base").to_numpy()[who]), pa.array((anchor[who] - first).astype(np.int32))]
            columns.append(pa.array([x for p in parts for x in p[2]], pa.binary()).cast(pa.string()))
            yield pa.record_batch(columns, ["key", "h", "g", "low", "high", "base", "anchor", "segment"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of each segment under two 64-bit hashes of its words."""
    for batch in slices(batches, "segment", 1 << 18):
        hashes, counts, *_ = word_hashes(batch.column("segment"), lower=False)
        n = counts - WINDOW + 1
        bases = np.cumsum(counts) - counts
        starts = ranges(bases, n)
        owner = np.repeat(np.arange(len(counts)), n)
        both = [rolled(hashes, WINDOW)[starts], rolled(mix(hashes + U(0x9E3779B97F4A7C15)), WINDOW)[starts]]
        columns = [batch.column(k).take(pa.array(owner)) for k in ("h", "g", "low")]
        offset = starts - bases[owner] + batch.column("base").to_numpy()[owner]
        yield pa.record_batch([*columns, pa.array(offset), *(pa.array(x.view(np.int64)) for x in both)], ["h", "g", "low", "offset", "w1", "w2"])


def _single_nodes(segments: DataFrame, scratch: Scratch) -> DataFrame:
    """What _tree gives, for groups of any size: each node is a group of its own."""
    windows = segments.select("h", "g", "segment", "low", "base").mapInArrow(_windows, "h long, g long, low long, offset long, w1 long, w2 long")
    windows = scratch.write(windows, "windows")
    nodes = scratch.write(windows.groupBy("w1", "w2").agg(F.min("low").alias("least"), F.count("*").alias("n")), "nodes")
    marked = skew_join(windows, nodes, ["w1", "w2"], "n", windows.count()).where("found.least < low")
    return marked.select("h", "g", F.col("offset").alias("from"), F.col("offset").alias("to"))


def _marked_runs(classes: DataFrame, scratch: Scratch, group_bytes: int) -> DataFrame:
    """(h, g, from, to): runs of windows of written classes (h, g, segment, low, high, anchor) that a smaller document has."""
    rows = classes.select(F.col("h").alias("key"), "h", "g", "low", "high", F.lit(0).cast("long").alias("base"), "anchor", "segment")
    runs = []
    for words in (*LONGER, None):
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.octet_length("segment")).alias("bytes"), F.min("low").alias("x"), F.max("high").alias("y"))
        sizes = scratch.write(sizes.where("size > 1 and x < y").select("key", "size", "bytes"), "sizes")
        sized = skew_join(rows, sizes, ["key"], "size", rows.count())
        light = sized.where(F.col("found.bytes") <= group_bytes).select("key", "h", "g", "low", "base", "segment")
        runs.append(light.repartition("key").sortWithinPartitions("key").mapInArrow(_tree, "h long, g long, from long, to long"))
        if sizes.where(F.col("bytes") > group_bytes).isEmpty():
            break
        heavy = sized.where(F.col("found.bytes") > group_bytes)
        if words is None:
            runs.append(_single_nodes(heavy, scratch))
        else:
            kinds = "key long, h long, g long, low long, high long, base long, anchor int, segment string"
            rows = scratch.write(heavy.select("h", "g", "low", "high", "base", "anchor", "segment").mapInArrow(_longer(words), kinds), "longer")
    return functools.reduce(DataFrame.unionByName, runs)


def marks(docs: DataFrame, scratch: Scratch, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(d, text_hash, marks): for each document with something to remove, an array of (k1, copy, spans), one per word sequence it has.

    The hash of the text tells rows with one doc_id (or none) apart, so no group or join grows with their number.
    """
    before = scratch.n
    texts = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64("text").alias("text_hash"), "text")
    kinds = "d long, text_hash long, n_words long, k1 long, k2 long, hashes array<long>, places array<long>"
    rows = scratch.write(texts.mapInArrow(_first, kinds), "rows")
    owners = rows.groupBy("k1", "k2").agg(F.min("d").alias("owner"), F.count("*").alias("n"))
    owned = skew_join(rows, owners, ["k1", "k2"], "n", rows.count()).withColumn("copy", F.col("d") > F.col("found.owner"))
    owned = scratch.write(owned.select("d", "text_hash", "n_words", "k1", "copy", F.when(~F.col("copy"), F.arrays_zip("hashes", "places")).alias("anchors")), "owned")
    scratch.drop(rows)

    found = owned.where("not copy").select("d", "text_hash", "k1", F.inline("anchors").alias("h", "place"))
    repeated = found.groupBy("h").agg(F.min("d").alias("x"), F.max("d").alias("y"), F.count("*").alias("n")).where("x < y").select("h", "n")
    repeated = scratch.write(repeated, "repeated")
    total = owned.where("not copy").agg(F.sum(F.size("anchors"))).first()[0] or 0
    again = skew_join(found, repeated, ["h"], "n", total).where("found is not null")
    places = scratch.write(again.groupBy("d", "text_hash", "k1").agg(F.collect_set("place").alias("places")), "places")
    kinds = "h long, g long, segment string, d long, text_hash long, k1 long, start long, n long, anchor int"
    met = scratch.write(texts.join(places, ["d", "text_hash"]).select("text", "d", "text_hash", "k1", "places").mapInArrow(_segments, kinds), "segments")

    alike = met.groupBy("h", "g", "segment").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("times"), F.first("anchor").alias("anchor"))
    alike = scratch.write(alike, "classes")
    runs = _marked_runs(alike, scratch, group_bytes).groupBy("h", "g").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))
    lookup = scratch.write(alike.select("h", "g", "low", "times").join(runs, ["h", "g"], "left"), "runs")
    spans = skew_join(met.select("h", "g", "d", "text_hash", "k1", "start", "n"), lookup, ["h", "g"], "times", met.count())
    whole = F.array(F.struct(F.col("start").alias("from"), (F.col("start") + F.col("n") - 1).alias("to")))
    some = F.transform("found.runs", lambda x: F.struct((x["from"] + F.col("start")).alias("from"), (x["to"] + F.col("start")).alias("to")))
    spans = spans.select("d", "text_hash", "k1", F.inline(F.when(F.col("d") > F.col("found.low"), whole).otherwise(some)).alias("from", "to"))
    parts = spans.groupBy("d", "text_hash", "k1").agg(F.collect_set(F.struct("from", "to")).alias("spans")).withColumn("copy", F.lit(False))
    copies = owned.where(F.col("copy") & (F.col("n_words") >= WINDOW)).select("d", "text_hash", "k1").distinct()
    empty = F.array().cast("array<struct<from:bigint,to:bigint>>")
    both = parts.select("d", "text_hash", "k1", "copy", "spans").unionByName(copies.select("d", "text_hash", "k1", F.lit(True).alias("copy"), empty.alias("spans")))
    found = scratch.write(both.groupBy("d", "text_hash").agg(F.collect_list(F.struct("k1", "copy", "spans")).alias("marks")), "marks")
    scratch.drop_since(before, found)
    return found


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n_words, n_removed, kept (the words left, if any went) and kept_sha256."""
    for batch in slices(batches, "text", 1 << 20):
        found = batch.column("marks").to_pylist()
        texts = batch.column("text")
        chosen = [i for i, m in enumerate(found) if m]
        keys = {}
        if chosen:
            hashes, counts, *_ = word_hashes(texts.take(pa.array(chosen)), lower=False)
            keys = dict(zip(chosen, sequence_hash(hashes, counts)[:, 0].tolist(), strict=True))
        rows = []
        for i, (text, own) in enumerate(zip(texts.to_pylist(), found, strict=True)):
            words = (text or "").encode().split()
            n, kept = len(words), words
            for mark in own or ():
                if mark["k1"] != keys[i]:
                    continue
                if mark["copy"]:
                    kept = []
                    break
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, [s["from"] for s in mark["spans"]], 1)
                np.add.at(edge, [s["to"] + WINDOW for s in mark["spans"]], -1)
                kept = [w for w, c in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not c]
            left = b" ".join(kept)
            rows.append((n, n - len(kept), left.decode() if len(kept) < n else None, hashlib.sha256(left).hexdigest()))
        rest = [c for c in batch.schema.names if c != "marks"]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
        yield pa.record_batch([*(batch.column(c) for c in rest), *columns], [*rest, "n_words", "n_removed", "kept", "kept_sha256"])


def remove_repeats(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """`docs` with n_words, n_removed, kept and kept_sha256; `kept` is null where nothing was removed.

    group_bytes: how much text a group of suffixes may have before it is split by longer prefixes."""
    rows = without(docs, "n_words", "n_removed", "kept", "kept_sha256", "marks", "d", "text_hash")
    found = marks(rows, Scratch(docs.sparkSession, "substring-dedup"), group_bytes)
    joined = rows.withColumn("d", F.coalesce("doc_id", F.lit(LAST))).withColumn("text_hash", F.xxhash64("text")).join(found, ["d", "text_hash"], "left")
    return map_in_arrow(without(joined, "d", "text_hash"), _remove, with_fields(rows, "n_words long, n_removed long, kept string, kept_sha256 string"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")

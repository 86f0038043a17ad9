"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

A source's schedule gives its weight at each time of the training, from 0 to 1, in straight lines between knots. The
integral of the schedule is the source's share of all words, up to `most` times what it has; the excess goes to the
other sources by weight. The documents of a source stand in the order of a hash of their ids, one pass behind the
other, so each copy begins after a known number of the source's words. A copy is taken if its middle lies below the
source's target, and its training position is the time at which the integrated schedule has asked for the words up to
there. training_order() sorts the copies by position.

Prefix sums are taken over range partitions: a sum a partition, and a running sum within each, so a source of any size
is spread over tasks. What is known of a source is looked up skew-safe.

Defined cases: a null text has size 0; a null source is one source, the last; a null doc_id is an id of its own; rows
that are repeated are documents of their own and may go in any order, which changes no row of the result; a source
without words has target 0; a source that no schedule asks for is not taken; where the schedules cannot be met at
`most` copies of all they ask for, everything they ask for is taken `most` times; an empty table gives no rows; other
columns stay, those with the name of a new one are replaced. Whole documents are taken, so a source misses its target
by at most half of one document.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsdesk.llm.common import Scratch, quoted, skew_join, table

Knots = Sequence[tuple[float, float]]
NEW = ("size", "source_size", "target", "positions", "position", "number")
#: Integrals 5, 2 and 1: the first fades, the second grows, the third is even.
CURRICULA: tuple[Knots, ...] = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)), ((0.0, 1.0), (1.0, 1.0)))


def sized(docs: DataFrame) -> DataFrame:
    """`docs` with `size`, the number of words of the text."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))
    return docs.select(*[quoted(c) for c in docs.columns if c.lower() != "size"], words.alias("size"))


def running(rows: DataFrame, order: list[str], sums: list[str], scratch: Scratch, name: str) -> DataFrame:
    """`rows` with `number` (from 0) in the order of columns that are never null, and before_<c>: the sum of each
    column of `sums` over all rows before."""
    ranged = scratch.write(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    whole = {"number": F.count("*"), **{f"before_{c}": F.sum(c) for c in sums}}
    parts = ranged.groupBy("part").agg(*[f.alias(f"{n}_part") for n, f in whole.items()])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    zero = lambda c: F.coalesce(c, F.lit(0))
    offsets = parts.select("part", *[zero(F.sum(f"{n}_part").over(before)).alias(f"{n}_offset") for n in whole])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.join(F.broadcast(offsets), "part")
    return found.select(*rows.columns, *[(F.col(f"{n}_offset") + zero(f.over(inside))).alias(n) for n, f in whole.items()])


def cycled(curricula: Sequence[Knots] = CURRICULA) -> Callable[[DataFrame], DataFrame]:
    """A plan for mix(): the sources, by code point and null last, take the schedules in turn."""
    for knots in curricula:
        times = [t for t, _ in knots]
        if times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:], strict=False)) or min(w for _, w in knots) < 0:
            raise ValueError(f"a schedule goes from time 0 to 1 with weights of 0 or more: {knots}")
    each = F.array(*[F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in knots]) for knots in curricula])
    return lambda sources: sources.withColumn("knots", F.element_at(each, (F.col("number") % len(curricula) + 1).cast("int")))


def _segments(knots: F.Column) -> F.Column:
    """Of each straight stretch: where it begins, its weight there, its slope, and the integral before and after it."""
    pairs = F.transform(F.slice(knots, 1, F.size(knots) - 1), lambda k, i: F.struct(k.alias("k"), F.get(knots, i + 1).alias("next")))

    def add(done: F.Column, x: F.Column) -> F.Column:
        length = x["next"]["t"] - x["k"]["t"]
        area = F.coalesce(F.get(done, F.size(done) - 1)["after"], F.lit(0.0))
        slope = (x["next"]["w"] - x["k"]["w"]) / length
        both = (x["k"]["w"] + x["next"]["w"]) / 2 * length
        return F.concat(done, F.array(F.struct(x["k"]["t"].alias("t"), x["k"]["w"].alias("w"), slope.alias("slope"), area.alias("before"), (area + both).alias("after"))))

    none = F.array().cast("array<struct<t:double,w:double,slope:double,before:double,after:double>>")
    return F.aggregate(pairs, none, add)


def _time(asked: F.Column, segments: F.Column) -> F.Column:
    """The time at which the integral of a schedule reaches `asked`."""
    s = F.get(F.filter(segments, lambda x: x["after"] > asked), F.lit(0))
    s = F.coalesce(s, F.get(segments, F.size(segments) - 1))
    more = F.greatest(asked - s["before"], F.lit(0.0))
    speed = s["w"] + F.sqrt(F.greatest(s["w"] * s["w"] + 2 * s["slope"] * more, F.lit(0.0)))
    return s["t"] + F.when(speed > 0, 2 * more / speed).otherwise(0.0)


def _targets(sources: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """`sources` with `target`: by weight of all words, no more than `most` times what the source has.

    In the order of what a unit of weight may take, the first source that its share leaves within bounds has the share
    of all that follow; those before it are at their bound.
    """
    bound = most * F.col("source_size")
    full = F.when(F.col("weight") > 0, bound / F.col("weight")).otherwise(F.lit(float("inf")))
    whole = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()  # one row
    ranked = running(sources.drop("number").withColumn("full", full), ["full", "no_source", "source_key"], ["source_size", "weight"], scratch, "full").drop("full")
    words = F.lit(whole.words or 0) - most * F.col("before_source_size")
    weight = F.lit(whole.weight or 0.0) - F.col("before_weight")
    within = ranked.where((F.col("weight") > 0) & (words * F.col("weight") <= bound * weight))
    level = within.agg(F.min_by(F.struct(words.cast("double").alias("words"), weight.alias("weight")), "number").alias("level")).first().level  # one row
    target = F.col("weight") * F.lit(level.words) / F.lit(level.weight) if level else bound.cast("double")
    return ranked.drop("number", "before_source_size", "before_weight").withColumn("target", F.when(F.col("weight") > 0, F.least(target, bound.cast("double"))).otherwise(0.0))


def mix(docs: DataFrame, plan: Callable[[DataFrame], DataFrame] | None = None, most: int = 3) -> DataFrame:
    """`docs` (doc_id, source, size: see sized()) with source_size, target, positions (of the copies that are taken) and a unique number.

    plan: adds `knots`, an array of (t, w), to sources given as (no_source, source_key, number).
    """
    scratch = Scratch(docs.sparkSession, "mix")
    names = [c for c in docs.columns if c.lower() not in NEW]
    doc, source = quoted("doc_id"), quoted("source")
    rows = docs.select(
        F.struct(*[quoted(c) for c in names]).alias("row"),
        "size",
        source.isNull().alias("no_source"),
        F.coalesce(source.cast("string"), F.lit("")).alias("source_key"),
        F.sha1(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")).alias("place"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)).alias("spread"),  # parts equal rows
    )
    placed = scratch.write(running(rows, ["no_source", "source_key", "place", "size", "spread"], ["size"], scratch, "rows"), "placed")
    key = ["no_source", "source_key"]
    sources = placed.groupBy(*key).agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.min("before_size").alias("start"))
    planned = (plan or cycled())(running(sources, key, [], scratch, "sources")).withColumn("segments", _segments(F.col("knots"))).drop("knots")
    planned = planned.withColumn("weight", F.get("segments", F.size("segments") - 1)["after"])
    found = scratch.write(_targets(planned, most, scratch), "targets")
    total = found.agg(F.sum("n")).first()[0] or 0  # one value
    out = skew_join(placed, found, key, "n", total)
    know = lambda c: F.col(f"found.{c}")
    middle = lambda copy: F.col("before_size") - know("start") + copy * know("source_size") + F.col("size") / 2
    taken = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), middle), lambda m: m < know("target"))
    positions = F.transform(taken, lambda m: _time(m / know("target") * know("weight"), know("segments")))
    return out.select(
        *[quoted("row", c).alias(c) for c in names],
        "size",
        know("source_size").alias("source_size"),
        know("target").alias("target"),
        positions.alias("positions"),
        "number",
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each copy in `position` order over partitions; documents that are not taken come last, with none."""
    copies = mixed.select("*", F.explode_outer("positions").alias("position")).drop("positions")
    last = F.coalesce("position", F.lit(2.0))
    return copies.repartitionByRange(last, "number").sortWithinPartitions(last, "number")


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    ordered = Scratch(spark, "training-order").write(training_order(mix(docs)), "copies")
    of_doc = ["number", "doc_id", "size", "source_size", "target"]
    taken = F.sum(F.when(F.col("position").isNotNull(), F.col("size")).otherwise(0))
    return ordered.groupBy(*of_doc).agg(taken.alias("taken")).drop("number")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS src, sha1(coalesce(doc_id::VARCHAR, '')) AS place,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), p AS (
  SELECT *, sum(size) OVER (PARTITION BY none, src ORDER BY place, size ROWS UNBOUNDED PRECEDING) - size AS c FROM d
), s AS (
  SELECT none, src, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY none, src) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY none, src
), r AS (
  SELECT *, row_number() OVER o AS k, (sum(source_size) OVER () - 3 * (sum(source_size) OVER o - source_size))::DOUBLE AS words,
         sum(w) OVER () - (sum(w) OVER o - w) AS ws FROM s WINDOW o AS (ORDER BY 3 * source_size / w, none, src ROWS UNBOUNDED PRECEDING)
), level AS (SELECT arg_min(words, k) AS words, arg_min(ws, k) AS ws FROM r WHERE words * w <= 3 * source_size * ws
), t AS (SELECT none, src, source_size, least(w * words / ws, (3 * source_size)::DOUBLE) AS target FROM s, level)
SELECT doc_id, size, source_size, target,
       size * list_sum(list_transform([0, 1, 2], lambda i: (c + i * source_size + size / 2 < target)::BIGINT))::BIGINT AS taken
FROM p JOIN t USING (none, src)
"""

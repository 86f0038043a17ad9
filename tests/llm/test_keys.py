"""Rows without a doc_id, or with one and the same, are no group: what is looked up for a row is its own."""

import random

import pytest
from pyspark.sql import functions as F

from newsdesk.llm import exact_dedup, language_id, line_dedup, media, near_dedup, packing, sentencepieces, substring_dedup, token_files
from newsdesk.llm.common import Scratch, spread_join

N = 40


@pytest.fixture(scope="module")
def docs(spark):
    """A passage in a document with a small doc_id and, among lines of their own, in N rows of no doc_id and N of one."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    rows = [(0, passage)] + [(d, f"{text(30)}\n{passage}\n{text(30)}") for d in (None, 7) for _ in range(N)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def test_substring_marks_are_of_one_text(spark, docs):
    found = substring_dedup.marks(docs, Scratch(spark, "test-keys"))
    assert found.count() == 2 * N and found.agg(F.max(F.size("marks"))).first()[0] == 1
    got = substring_dedup.remove_repeats(docs).collect()
    assert len(got) == 2 * N + 1 and sorted(r.n_removed for r in got) == [0] + [60] * (2 * N)


def test_lines_are_of_one_text(spark, docs):
    found = line_dedup.duplicate_lines(docs)
    assert found.count() == 2 * N and found.agg(F.max(F.size("gone"))).first()[0] == 1
    got = line_dedup.remove_lines(docs).collect()
    assert len(got) == 2 * N + 1 and sorted(r.n_removed for r in got) == [0] + [1] * (2 * N)


def test_near_duplicates_look_up_one_text_a_class(spark, docs):
    run = near_dedup.NearDuplicates(docs, 2, 80)
    assert run.classes.count() == 2 * N + 1
    assert run.texts_of(run.classes.select("node")).count() == 2 * N + 1
    assert run.payloads(run.classes.select("node")).count() == 2 * N + 1


CLASHING = ("a.b", "row", "found", "hot", "cold", "d", "h", "n", "key", "kept", "keep_id", "n_words", "n_lines", "marks", "gone", "score", "media", "n_bytes", "feature", "ids", "n_ids", "decoded", "Text_Hash", "digest")


def test_columns_of_any_name(spark):
    """Operators that keep other columns do so whatever their names; a name of a new column is replaced."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(k, "a line of text here\n" * 3, "en") for k in range(4)], "doc_id long, text string, lang string")
    for name in CLASHING:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    runs = {
        "exact": exact_dedup.exact_dedup(docs), "lines": line_dedup.remove_lines(docs), "repeats": substring_dedup.remove_repeats(docs),
        "language": language_id.predict(docs, language_id.train(docs)), "stored": media.store(docs), "media": media.features(media.store(docs)),
        "encoded": sentencepieces.encode(docs, pieces), "decoded": sentencepieces.decode(sentencepieces.encode(docs, pieces), pieces),
    }
    for name, found in runs.items():
        low = [c.lower() for c in found.columns]
        assert len(set(low)) == len(low) and "a.b" in low, name
        rows = found.select("doc_id", "`a.b`").collect()
        assert len(rows) == 4 and all(r["a.b"] == f"a.b{r.doc_id}" for r in rows), name


def test_tables_of_null_ids_stay_linear(spark):
    """2000 rows without a doc_id: the steps' tables have a few rows for each, not for each pair."""
    rng = random.Random(8)
    line = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(60))
    docs = spark.createDataFrame([(None, f"{line} x{k % 50} y") for k in range(2000)], "doc_id long, text string")
    run = near_dedup.NearDuplicates(docs, 2, 80)
    members = run.members()
    assert members.count() <= 30 * 50 and run.result().count() == 2000
    found = substring_dedup.remove_repeats(docs)
    assert found.count() == 2000 and found.where("n_removed > 0").isEmpty()
    lines = line_dedup.remove_lines(docs)
    assert lines.count() == 2000


def test_one_shuffle_of_line_entries(spark):
    """Both reads of the entries take the same shuffle, so they are computed once."""
    scratch = Scratch(spark, "test-entries")
    lines = scratch.write(spark.range(3000).selectExpr("id AS node", "concat('line number ', id % 100, ' of ', id) AS line"), "lines")
    found = line_dedup.LineLinks(scratch, lines, 2).sharing()
    assert found.count() > 0
    plan = found._jdf.queryExecution()
    found.collect()
    final = plan.executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 1 and final.count("MapInArrow") == 1, final


def test_only_the_result_is_left(spark, tmp_path):
    """Tables that no later step reads are deleted."""
    import os

    docs = spark.createDataFrame([(k, f"a line of text\nanother line {k % 3}") for k in range(30)], "doc_id long, text string")
    made = []
    old = Scratch.__init__
    try:
        Scratch.__init__ = lambda self, *a: (old(self, *a), made.append(self))[0]
        line_dedup.duplicate_lines(docs)
        substring_dedup.marks(docs, Scratch(spark, "test-left"))
    finally:
        Scratch.__init__ = old
    assert [len(os.listdir(s.root)) for s in made] == [1, 1]


def sizes_of(rows):
    return [r.n for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_a_hot_leader_is_spread(spark):
    """One key with two thirds of the rows: the join is right, and no task has three times the median's rows."""
    n, written = 3000, Scratch(spark, "test-spread")
    pairs = written.write(spark.range(n).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("a"), F.col("id").alias("b")), "pairs")
    entries = spark.range(0, n - 1).select(F.col("id").alias("a"), (F.col("id") * 2).alias("twice"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spread_join(pairs, entries, "a", pairs)
        found, sizes = joined.collect(), sorted(sizes_of(joined))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.a, r.b, r.twice) for r in found) == sorted((k if k >= 2000 else 0, k, 2 * (k if k >= 2000 else 0)) for k in range(n - 1))
    assert sizes[-1] < 3 * sizes[len(sizes) // 2]


def test_equal_rows_go_to_several_parts(spark):
    """A row that is a third of the table: token files and packing sort it into parts of about one size, and are right."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(7, "one row that is a third of all")] * 1000 + [(k, f"text number {k}") for k in range(100, 2100)], "doc_id long, text string")
    written = Scratch(spark, "test-parts").write(token_files.segments(docs, path), "segments")
    sizes = sorted(r.n for r in written.groupBy("part").agg(F.sum(F.size("doc_ids")).alias("n")).collect())
    assert len(sizes) > 2 and sizes[-1] < 3 * sizes[len(sizes) // 2]
    read = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_digests(written).collect())
    assert [d for _, d, _ in read] == [7] * 1000 + [*range(100, 2100)] and all(a[0] + a[2] == b[0] for a, b in zip(read, read[1:], strict=False))


def test_packing_is_never_worse_than_best_fit():
    rng = random.Random(11)
    for most in (300, 900, 2048):
        histogram = {}
        for _ in range(400):
            n = rng.randrange(1, most)
            histogram[n] = histogram.get(n, 0) + rng.randrange(1, 4)
        chosen = packing.best_plan(histogram, 2048)
        plain = packing.Plan(histogram, 2048, small=2048)
        assert chosen.sequences <= plain.sequences and sum(r[2] for r in chosen.runs) == sum(histogram.values())

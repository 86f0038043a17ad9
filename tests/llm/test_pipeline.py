import hashlib
import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(2)
    vocab = ["".join(rng.choice(["th", "e", "an", "ou", "r"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = text(150), text(60)
    near = base.split()
    near[70] = "changed"
    texts = [base, base, " ".join(near), f"{text(40)} {passage} {text(40)}", f"{passage} {text(50)}", "123 ?!", None, *[text(80) for _ in range(12)]]
    rows = [(k, t, "en", "src", len(t or ""), "x", "y") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, `a.b` string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        kept.write.parquet(str(tmp_path / f"stage{k}"))
        kept = spark.read.parquet(str(tmp_path / f"stage{k}"))
        sizes.append({r.doc_id for r in kept.collect()})
    assert sizes[0] == set(range(len(texts))) - {5, 6}
    assert sizes[1] == sizes[0] - {1} and sizes[2] == sizes[1] - {2} and sizes[3] == sizes[2]
    left = {r.doc_id: r for r in kept.collect()}
    assert left[4].text == " ".join(texts[4].split()[60:]) and left[4].n_chars == len(left[4].text) and left[3].text == texts[3]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == sizes[3]
    again = corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id", "piece").collect()
    assert hashlib.sha256(repr(again).encode()).hexdigest() == hashlib.sha256(repr(packed.orderBy("doc_id", "piece").collect()).encode()).hexdigest()


def test_odd_rows(spark, tmp_path):
    """Null ids, repeated rows and ids, ties, texts of 0 to 6 words, one row a partition: each stage gives its defined result."""
    letters = "le chat noir dort bien ici".split()
    few = [" ".join(letters[:n]) for n in range(7)]
    rows = [(k, t, "fr") for k, t in enumerate(few)] + [(None, "chien blanc", "fr"), (None, "chien blanc", None), (None, None, None), (3, few[3], "fr"), (3, "autre texte du tout", "fr"), (9, few[3], None)]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows, schema).repartition(len(rows))
    want = [
        [r for r in rows if r[1]],
        [r for r in rows if r[1] and r[0] != 9],
        [r for r in rows if r[1] and r[0] != 9],
        [r for r in rows if r[1] and r[0] != 9],
    ]
    kept = docs
    for k, ((name, stage), expected) in enumerate(zip(corpus_pipeline.STAGES, want, strict=False)):
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(str(tmp_path / f"odd{k}"))
        kept = spark.read.parquet(str(tmp_path / f"odd{k}")).repartition(len(rows))
        assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, expected)), name
    assert corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).count() == len(want[-1])
    assert corpus_pipeline.drop_exact_copies(spark, docs, "").where("text is null or text = ''").count() == 1
    assert corpus_pipeline.drop_near_copies(spark, docs, "").where("text is null or text = ''").count() == 2


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

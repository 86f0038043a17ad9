"""A training corpus in five stages, each of which calls an operator of newsdesk.llm.

Language identification drops documents without a letter and those undecided between the languages it knows (lettered
text in another language is taken for one of these), exact and near deduplication keep one document of each group of copies, substring deduplication cuts passages that an earlier document has, and packing fills
sequences of 2048 tokens. Each stage's result is written and read again by the next.

Documents travel as a struct beside the columns that an operator reads, so columns of any name pass unharmed.

Defined cases, in every stage: a null or empty text has no letter and goes in the first stage (a later stage keeps it, as
a text without words, and exact dedup takes null and empty for equal); a null doc_id counts as larger than any other, so
of equal texts without any id each row stays, and a document without an id never removes words of another one; rows that
share doc_id and text are one document and stay together; of a tie between languages the first in the alphabet is taken;
an empty table gives no pieces. Each stage names its own below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm import exact_dedup, language_id, near_dedup, packing, substring_dedup
from newsdesk.llm.common import Scratch, table

TOKENIZER = "word_bpe_49k.json"


def _carried(docs: DataFrame, *read: str) -> DataFrame:
    """The columns that an operator reads, and the others as one struct."""
    return docs.select(*read, F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in read]).alias("row"))


def _restored(found: DataFrame, docs: DataFrame, *read: str, **new: F.Column) -> DataFrame:
    """The columns of `docs` again, in their order."""
    return found.select(*[new.get(c, F.col(c if c in read else f"row.`{c}`")).alias(c) for c in docs.columns])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str, least_score: float = 0.5) -> DataFrame:
    """Documents with a predicted language that has at least half of the probability among the known ones.

    The others have no letter (null and empty texts too) or are undecided. This doesn't tell unknown languages or
    lettered junk: the probability is relative to the known languages. Equal texts go or stay together; without any
    labelled row no language is known and all go.
    """
    model = language_id.train(docs)
    found = language_id.predict(_carried(docs, "text"), model)
    return _restored(found.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= least_score)), docs, "text")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id: each row that has it. A null text equals an empty one."""
    return _restored(exact_dedup.exact_dedup(_carried(docs, "doc_id", "text")).where("kept"), docs, "doc_id", "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their 5-word shingles, the one with the smallest doc_id.

    Texts without words are linked with nothing and stay; with fewer than five words, all of them are the one shingle.
    """
    return _restored(near_dedup.keep_one(_carried(docs, "doc_id", "text")), docs, "doc_id", "text")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 50-word windows that a document with a smaller doc_id has; n_chars follows the text.

    A document with nothing to remove keeps its text as it is, white space and null included; of the others the words
    that are left are joined by one space, to an empty text if none is.
    """
    found = substring_dedup.remove_repeats(_carried(docs, "doc_id", "text"))
    new = {"text": F.coalesce("kept", "text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.char_length("kept").cast(kind))
    return _restored(found, docs, "doc_id", "text", **new)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens.

    A null or empty text is one piece, the end id alone; rows with equal or no doc_id are packed each.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL cannot express the first and the last stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop_since(0, docs)
    return STAGES[-1][1](spark, docs, sf_dir)

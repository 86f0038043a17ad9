"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and every run of characters that are no letters counts as one space; its n-grams (2 and 3
characters) are hashed into `BUCKETS` buckets. Training counts n-grams per language in the tasks and adds them up
in Spark; the matrix of log-probabilities (buckets x languages, so its size does not depend on the data) is
broadcast. Scoring treats a batch of whole texts as one array of buckets: numpy gathers each language's
log-probabilities and sums them by document. Texts are taken about 1 MB at a time, and a longer one in blocks.

The model is fitted on a bounded sample of labelled rows: about `per_language` documents of each language, chosen
by a hash of doc_id. Prediction reads every text whole and nothing but the text.

Defined cases: a text that is null or holds no letter is `und` with score 0; without labelled rows every text is
`und`; ties between languages go to the first in alphabetical order; rows with a null doc_id or null lang are not
trained on; repeated rows count each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm.common import map_in_arrow, slices, table, with_fields, without

BUCKETS = 1 << 16
UND = "und"
SLICE, BLOCK = 1 << 20, 1 << 18  # bytes of text, and code points, that are worked on at a time
_A, _B, _HIGH = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(16)


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, number of each): letters in lower case, one space behind each run of them."""
    kept, sizes = [np.empty(0, np.uint32)], []
    letters = _letters()
    for text in texts.to_pylist():
        low, n, before = (text or "").lower(), 0, False
        for at in range(0, len(low), BLOCK):
            codes = np.frombuffer(low[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = letters[np.minimum(codes, 0xFFFF)]
            if codes.max() > 0xFFFF:
                high = np.flatnonzero(codes > 0xFFFF)
                letter[high] = [chr(c).isalpha() for c in codes[high].tolist()]
            keep = letter.copy()
            keep[1:] |= letter[:-1]
            keep[0] |= before
            before = bool(letter[-1])
            kept.append(np.where(letter, codes, np.uint32(32))[keep])
            n += len(kept[-1])
        if before:
            kept.append(np.array([32], np.uint32))
            n += 1
        sizes.append(n)
    return np.concatenate(kept), np.array(sizes, np.int64)


def ngrams(codes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket of each n-gram, texts that have some, where each one's begin) for each n and block of code points."""
    ends = np.cumsum(sizes)
    owner_of = lambda at: np.searchsorted(ends, at, "right")
    for at in range(0, len(codes), BLOCK):
        to = min(at + BLOCK, len(codes))
        c = codes[at : to + 2]
        two = (c[:-1] * _A + c[1:] * _B) >> _HIGH
        three = ((c[:-2] * _A + c[1:-1]) * _B + c[2:]) * _A >> _HIGH
        some = np.arange(owner_of(at), owner_of(to - 1) + 1)
        begin = np.maximum((ends - sizes)[some], at)
        for n, hashed in ((2, two), (3, three)):
            number = np.maximum(np.minimum(ends[some] - n + 1, to) - begin, 0)
            inside = np.ones(len(hashed), bool)
            for k in range(1, n):  # n-grams that leave their text
                left = ends[some] - k - at
                inside[left[(left >= 0) & (left < len(hashed))]] = False
            inside[to - at :] = False
            full = number > 0
            if full.any():
                yield hashed[inside].astype(np.uint16), some[full], (np.cumsum(number) - number)[full]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text", SLICE):
        langs = batch.column("lang").to_pylist()
        for buckets, owner, starts in ngrams(*normalised(batch.column("text"))):
            for i, at, to in zip(owner.tolist(), starts.tolist(), np.append(starts[1:], len(buckets)).tolist(), strict=True):
                if langs[i] not in sums:
                    sums[langs[i]] = np.zeros(BUCKETS, np.int64)
                found, times = np.unique(buckets[at:to], return_counts=True)
                sums[langs[i]][found] += times
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray, smoothing: float = 0.5):
        self.langs = langs
        self.weights = np.log((counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * BUCKETS)).astype(np.float32)
        self.prior = np.log((docs + 1) / (docs.sum() + len(langs)))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        codes, sizes = normalised(texts)
        if not self.langs:
            return [UND] * len(sizes), np.zeros(len(sizes))
        sums = np.zeros((len(sizes), len(self.langs)))
        for buckets, owner, starts in ngrams(codes, sizes):
            for i, row in enumerate(self.weights):
                sums[owner, i] += np.add.reduceat(row[buckets], starts, dtype=np.float64)
        sums += self.prior
        best = sums.argmax(axis=1)
        score = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        lettered = sizes > 0
        return [self.langs[i] if ok else UND for i, ok in zip(best.tolist(), lettered, strict=True)], np.where(lettered, score, 0.0)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = 4000, most_languages: int = 256) -> Model:
    """Fits on `docs` (doc_id, text, lang) outside the held-out quarter. More than `most_languages` are an error: the
    broadcast matrix has 256 KB a language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r["lang"]: r["n"] for r in sizes.limit(most_languages + 1).collect()}  # one row per language
    langs = sorted(sizes)
    if len(langs) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_language / sizes[lang]))])
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sums = labelled.where(u < share[F.col("lang")]).select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long")
    rows = sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows per language
    counts = np.zeros((len(langs), BUCKETS))
    at = np.array([langs.index(x) for x in rows["lang"].to_pylist()], np.int64)
    counts[at, rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return Model(langs, counts, np.array([sizes[x] for x in langs], float))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            langs, score = shared.value.predict(batch.column("text"))
            yield pa.record_batch([*batch.columns, pa.array(langs, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score, in place of any columns of these names (the posterior probability of that language)."""
    rows = without(docs, "lang_pred", "score")
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return map_in_arrow(rows, _predict(shared), with_fields(rows, "lang_pred string, score double"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

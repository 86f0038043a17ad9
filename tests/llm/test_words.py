"""Word hashes, shingles and n-grams of few, empty and long texts against plain versions, at several block sizes."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from newsdesk.llm import language_id, near_dedup, words


def plain_hash(word, lower):
    total, power = 0, 1
    for b in word:
        total, power = (total + int(words._bytes(lower)[b]) * power) % 2**64, power * words._P % 2**64
    return int(words.mix(np.array([total], np.uint64))[0])


def some_texts(rng, letters):
    return [None if rng.random() < 0.1 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 5))]


@pytest.mark.parametrize("block", [7, 8, 64, 1 << 19])
def test_word_hashes(monkeypatch, block):
    monkeypatch.setattr(words, "BLOCK", block)
    words._powers.cache_clear()
    rng = random.Random(block)
    for lower in (True, False) * 60:
        texts = some_texts(rng, "ab \tAé")
        hashes, counts, joined, starts, ends = words.word_hashes(pa.array(texts, pa.string()), lower)
        cut = [(t or "").encode().split() for t in texts]
        assert counts.tolist() == [len(w) for w in cut]
        assert hashes.tolist() == [plain_hash(w, lower) for w in itertools.chain(*cut)]
        assert [joined[a:b] for a, b in zip(starts, ends, strict=True)] == list(itertools.chain(*cut))
    words._powers.cache_clear()


@pytest.mark.parametrize("size", range(1, 6))
def test_shingles_of_few_words(size):
    for n in range(7):
        for texts in ([" ".join("abcdef"[:n])], [" ".join("abcdef"[:n]), None, ""]):
            hashes, counts, *_ = words.word_hashes(pa.array(texts, pa.string()), True)
            sets = words.shingles(hashes, counts, size)
            assert [len(s) for s in sets] == [max(n - size + 1, min(n, 1))] + [0] * (len(texts) - 1)


def test_near_duplicates_of_few_words(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a  b c"), (3, "a b"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs.repartition(4)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (0, 4)}


def plain_codes(text):
    c = re.sub(" +", " ", "".join(x if x.isalpha() else " " for x in (text or "").lower())).lstrip(" ")
    return [ord(x) for x in c.rstrip(" ") + " " * bool(c)]


def plain_buckets(text):
    a, b, c = int(language_id._A), int(language_id._B), plain_codes(text)
    two = [((x * a + y * b) % 2**32) >> 16 for x, y in zip(c, c[1:], strict=False)]
    return two + [((((x * a + y) * b + z) * a) % 2**32) >> 16 for x, y, z in zip(c, c[1:], c[2:], strict=False)]


@pytest.mark.parametrize("block", [3, 4, 7, 50])
def test_ngrams(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(100):
        texts = some_texts(rng, "ab ,Aé\U00010400")
        got = [[] for _ in texts]
        for buckets, owner, starts in language_id.ngrams(*language_id.normalised(pa.array(texts, pa.string()))):
            for i, at, to in zip(owner, starts, np.append(starts[1:], len(buckets)), strict=True):
                got[i] += buckets[at:to].tolist()
        assert [sorted(x) for x in got] == [sorted(plain_buckets(t)) for t in texts]


def test_language_id_is_naive_bayes(spark):
    """Predictions and scores over the whole smallest table, held-out rows and training rows alike."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.withColumn("held", language_id.held_out()).collect()
    counts, sizes = {}, {}
    for r in rows:
        if r.lang is not None and not r.held:
            sizes[r.lang] = sizes.get(r.lang, 0) + 1
            np.add.at(counts.setdefault(r.lang, np.zeros(language_id.BUCKETS)), np.array(plain_buckets(r.text), int), 1)
    langs = sorted(sizes)
    weights = [np.log((counts[x] + 0.5) / (counts[x].sum() + 0.5 * language_id.BUCKETS)) for x in langs]
    prior = np.log([(sizes[x] + 1) / (sum(sizes.values()) + len(langs)) for x in langs])
    got = {r.doc_id: r for r in language_id.predict(docs.select("doc_id", "text"), language_id.train(docs)).collect()}
    for r in rows:
        buckets = np.array(plain_buckets(r.text), int)
        sums = np.array([w[buckets].sum() for w in weights]) + prior
        odds = np.exp(sums - sums.max())
        own = got[r.doc_id]
        if not plain_codes(r.text):
            assert (own.lang_pred, own.score) == ("und", 0.0)
        else:
            assert own.lang_pred == langs[int(sums.argmax())] and own.score == pytest.approx(odds.max() / odds.sum(), abs=1e-3)


def test_too_many_languages(spark):
    docs = spark.createDataFrame([(k, "a", f"l{k}") for k in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language_id.train(docs, most_languages=5)

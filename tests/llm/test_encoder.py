import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokens = pytest.importorskip("newsdesk.llm.tokens")
pa = pytest.importorskip("pyarrow")

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_a_word_is_encoded_once_whatever_punctuation_follows():
    seen = []

    class Counting(tokens.Chunks):
        def ids_of(self, chunk):
            seen.append(chunk)
            return super().ids_of(chunk)

    words = [f"{a}{b}{c}blend" for a in "bdfg" for b in "aeiou" for c in ("l", "r", "ç", "é")]
    tails = ["", ",", ".", "!!", "%%%", ".***"]
    text = " ".join(w + t for t in tails for w in words)
    chunks = Counting(PATH, 10_000)
    assert chunks.encode(text).tolist() == chunks.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(seen) <= len(words) + len(tails) + 1


def test_batches_of_odd_texts_are_encoded_as_by_the_library():
    pick = random.Random(7)
    parts = [chr(i) for i in range(0x250)] + list(" \t\n\x0b\x0c\r\x1c\x85  　") * 12 + ["'s", "'re", "'ll", "'", "''", "’"] * 8
    parts += list("aeiouszSKnNJ019,.;:!?-\"()[]<>=&%#*_/|@+~^`{}\\") * 6
    parts += ["́", "̌", "̇", "̸", "K", "ſ", "İ", "ẞ", "Σ", "ﬁ", "×,", "é,", "ª", "²", "٠", "中", "가"] * 4
    parts += ["\U0001f600", "‍", "﻿", "—", "…", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "the", "Café", "Été"] * 4
    texts = ["".join(pick.choice(parts) for _ in range(pick.choice([0, 1, 2, 3, 5, 8, 20, 60]))) for _ in range(1500)]
    texts[::50] = [None] * len(texts[::50])
    chunks = tokens.Chunks(PATH, 500)  # a cache that is given up on the way
    want = [chunks.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    column = pa.array(["before", *texts])
    got = [*chunks.encode_all(column.slice(1, 700)), *chunks.encode_all(column.slice(701))]
    assert [x.tolist() for x in got] == want
    assert [len(x) for x in chunks.encode_all(pa.array([None, ""], pa.string()))] == [0, 0] and chunks.encode_all(pa.array([], pa.string())) == []

"""Encoding whole texts with a tokenizer of the tokenizers library, a word at a time.

A pre-token of these tokenizers never crosses ASCII white space, nor begins with a letter or digit and goes on with
ASCII punctuation. So a text's ids are those of its chunks, one after the other: a chunk begins with white space or
with the punctuation behind a word. Chunks repeat, so a batch's distinct ones are looked up, and each is encoded once
per worker and kept in a bounded cache. Texts that hold one of the tokenizer's special strings are encoded whole. A
file with another normaliser or pre-tokeniser than the one that this relies on is an error.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa

from newsdesk.llm.common import text_buffers

#: What a tokenizer file must say for the encoding by chunks to be the library's.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The pre-tokens of a chunk in ASCII and lower case.
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_SPACE, _WORD, _MARK, _HIGH = 0, 1, 2, 3
_KINDS = np.full(256, _MARK, np.uint8)
_KINDS[[32, *range(9, 14)]] = _SPACE
_KINDS[[i for i in range(128) if chr(i).isalnum()]] = _WORD
_KINDS[128:] = _HIGH


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins that byte-level BPE uses: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def _lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, but before a byte beyond ASCII: NFC comes before lower case, and some letters compose in one case only."""
    upper = (data >= 65) & (data <= 90)
    upper[:-1] &= data[1:] < 128
    return data + (upper.view(np.uint8) << 5)


def _bounds(data: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
    """Where chunks begin, and the end: at each text, each run of white space, and ASCII punctuation behind a letter or digit."""
    kind = _KINDS[data]
    space = kind == _SPACE
    new = np.zeros(len(data) + 1, bool)
    new[1:-1] = space[1:] & ~space[:-1]
    marks = 1 + np.flatnonzero((kind[1:] == _MARK) & (kind[:-1] & 1 == 1))
    before = data[marks - 1]  # of characters beyond ASCII, those of U+00C0 to U+00FF are letters, but for two
    new[marks[(before < 128) | (data[marks - 2] == 0xC3) & (before != 0x97) & (before != 0xB7)]] = True
    new[text_ends] = True
    return np.flatnonzero(new)


class Chunks(dict):
    """chunk (bytes; ASCII in lower case) -> its ids as bytes. At most twice `most` entries are kept."""

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.old = Tokenizer.from_file(path), most, {}
        config = json.loads(self.tokenizer.to_str())
        if [config[k] for k in ("normalizer", "pre_tokenizer")] != [_NORMALIZER, _PRE_TOKENIZER] or config["model"]["type"] != "BPE":
            raise ValueError(f"{path} normalises or splits texts in another way than this encoder does")
        self.model, self.alphabet = self.tokenizer.model, _byte_alphabet()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.ids_of(chunk.strip())
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def ids_of(self, chunk: bytes) -> bytes:
        """Pre-tokens of printable ASCII and Latin words are encoded as they stand; anything else goes through the whole tokenizer."""
        text = chunk.decode()
        if text.isascii() and text.isprintable():
            pieces = _PIECES.findall(chunk.lower())
            if len(pieces) > 1:
                return b"".join([self[p] for p in pieces])
            mapped = text.lower()
        else:
            low = text.lower()
            if not (text.isalpha() and max(text) < "ɐ" and max(low) < "ɐ" and unicodedata.is_normalized("NFC", text)):
                return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
            mapped = low.encode().decode("latin-1").translate(self.alphabet)
        return np.array([t.id for t in self.model.tokenize(mapped)], self.dtype).tobytes()

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null has none."""
        data, ends = text_buffers(texts)
        if not len(data):
            return [np.empty(0, self.dtype)] * len(texts)
        bounds = _bounds(data, ends)
        buffers = [None, pa.py_buffer(bounds), pa.py_buffer(_lowered(data))]
        chunks = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, buffers).dictionary_encode()
        known = [self[c] for c in chunks.dictionary.to_numpy(zero_copy_only=False).tolist()]
        found = pa.array(known, pa.large_binary()).take(chunks.indices)
        at = np.frombuffer(found.buffers()[1], np.int64, len(bounds))[np.searchsorted(bounds, ends)] // self.dtype.itemsize
        ids = np.frombuffer(found.buffers()[2] or b"", self.dtype)
        out = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        low = data.tobytes().lower()
        if any(s in low for s in self.special):
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                if any(s in low[a:b] for s in self.special):
                    out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.large_string()))[0]


@functools.lru_cache(maxsize=2)
def encoder(path: str, most: int = 200_000) -> Chunks:
    """One per Python worker: workers are reused from task to task."""
    return Chunks(path, most)

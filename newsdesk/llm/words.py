"""Words of whole texts as 64-bit hashes, a batch at a time in numpy."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0xD6E8FEB86659FD93
_P_INVERSE = pow(_P, -1, 1 << 64)
_ALL = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0x9FB21C651E98DF25)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


@functools.cache
def _bytes(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
    if lower:
        values[65:91] = values[97:123]
    return values


BLOCK = 1 << 19  # bytes of text that are worked on at a time


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse."""
    return tuple(np.cumprod(np.r_[U(1), np.full(BLOCK, x, U)], dtype=U) for x in (_P, _P_INVERSE))


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text, all texts' bytes, where each word begins and ends in them).

    Words are `[^\\x20\\x09-\\x0D]+`; `lower` folds A-Z. A null text has none. A block of bytes is worked on at a time;
    a word that goes on in the next block carries its hash over, so memory beyond the words themselves is bounded.
    """
    encoded = [(t or "").encode() for t in texts.to_pylist()]
    text_ends = np.cumsum([len(t) + 1 for t in encoded], dtype=np.int64)
    joined = b" ".join([*encoded, b""])  # each text ends with a space
    del encoded
    data = np.frombuffer(joined, np.uint8)
    power, inverse = _powers()
    values = _bytes(lower)
    hashes, starts, ends = [np.empty(0, U)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    begun, so_far = -1, 0  # start and hash of a word that goes on
    for at in range(0, len(data), BLOCK):
        block = data[at : at + BLOCK]
        word = np.zeros(len(block) + 2, np.int8)
        word[1:-1] = (block != 32) & ((block < 9) | (block > 13))
        edges = np.flatnonzero(np.diff(word))
        first, last = edges[::2], edges[1::2]
        if not len(first):
            if begun >= 0:
                hashes.append(mix(np.array([so_far], U)))
                starts.append(np.array([begun]))
                ends.append(np.array([at]))
                begun = -1
            continue
        sums = np.zeros(len(block) + 1, U)
        np.cumsum(values[block] * power[: len(block)], out=sums[1:])
        found = (sums[last] - sums[first]) * inverse[first]
        first, last = first + at, last + at
        if begun >= 0:
            if first[0] == at:
                found[0] = (so_far + int(found[0]) * pow(_P, at - begun, 1 << 64)) & _ALL
                first[0] = begun
            else:
                found, first, last = np.r_[U(so_far), found], np.r_[begun, first], np.r_[at, last]
            begun = -1
        if last[-1] == at + len(block):  # never at the very end, which is a space
            begun, so_far = int(first[-1]), int(found[-1])
            found, first, last = found[:-1], first[:-1], last[:-1]
        hashes.append(mix(found))
        starts.append(first)
        ends.append(last)
    hashes, starts, ends = (np.concatenate(x) for x in (hashes, starts, ends))
    counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    return hashes, counts, joined, starts, ends


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; of no use in the last n - 1 places."""
    out = np.zeros(len(hashes), U)
    for k in range(n):
        behind = max(0, len(hashes) - k)
        out[:behind] = out[:behind] * U(0xC2B2AE3D27D4EB4F) + hashes[k:]
    return mix(out)


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text; the whole sequence where it has fewer words."""
    grams = rolled(hashes, n)
    found, at = [], 0
    for c in counts.tolist():
        if c >= n:
            found.append(np.unique(grams[at : at + c - n + 1]))
        elif c:
            short = U(c)
            for h in hashes[at : at + c]:
                short = U((int(short) * 0x9E3779B97F4A7C15 + int(h)) & 0xFFFFFFFFFFFFFFFF)
            found.append(mix(np.array([short], U)))
        else:
            found.append(np.empty(0, U))
        at += c
    return found

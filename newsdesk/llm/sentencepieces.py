"""SentencePiece encoding and decoding with shared-prefix Viterbi.

A text's spaces become the marker U+2581, one more goes in front, and the text falls into *marked words*: markers
and the characters behind them, which no piece crosses. The distinct words of a batch are sorted and traversed like
the trie they form, depth first: the forward states of a word stay on a stack, and the next word starts from the
states of the prefix it shares with the word before.

For unigram models a prefix's state is its best score and last piece. For BPE models scores don't add up, and the
best sum is not the encoding, so the state is the last piece of the prefix's BPE encoding: piece t ends prefix p
if the prefix without t ends with some piece u and merging u + t by itself leaves (u, t). A sequence whose
neighbours all pass that test is the BPE encoding, so exactly one piece passes, and prefixes share states alike.

Characters without a piece become byte pieces. Decoding looks up the bytes of all ids of a batch at once.

Defined cases: a null text counts as empty and has no ids; U+2581 in a text reads back as a space; words of any
length are encoded whole; an empty table gives no rows; repeated rows are encoded each.
"""

from __future__ import annotations

import array
import functools
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm.chat_format import ranges
from newsdesk.llm.common import map_in_arrow, slices, table, with_fields, without

MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNIGRAM, BPE = 1, 2


class Pieces:
    """A model's pieces, its words' encodings (at most twice `most` are kept) and the tables for decoding."""

    def __init__(self, path: str | bytes, most: int = 60_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        if isinstance(path, str):
            with open(path, "rb") as f:
                path = f.read()
        proto.ParseFromString(path)
        flags = proto.normalizer_spec
        if proto.trainer_spec.model_type not in (UNIGRAM, BPE) or flags.precompiled_charsmap or flags.remove_extra_whitespaces or not flags.add_dummy_prefix:
            raise ValueError("a unigram or BPE model without normalisation, with a prefix space, is expected")
        model = sentencepiece.SentencePieceProcessor(model_proto=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes_at = {int(names[i][3:5], 16): i for i in range(len(names)) if model.is_byte(i)}
        plain = [i for i in range(len(names)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        if any(re.search(f"[^{MARK}]{MARK}", names[i]) for i in plain):
            raise ValueError("a piece crosses a marked word")
        self.ids = {names[i]: i for i in plain}
        self.scores = {names[i]: model.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        self.unknown, self.unknown_score = model.unk_id(), min(self.scores.values()) - 10.0
        self.kind = proto.trainer_spec.model_type
        self.most, self.words, self.old, self.pairs, self.n_pairs, self.timelines = most, {}, {}, {}, 0, {}
        tails = {name[k:] for name in self.ids for k in range(len(name))}
        self.tails = {t: t in self.ids for t in tails}  # how pieces end -> whether that is a piece
        self.dtype = np.dtype("<u2" if len(names) <= 1 << 16 else "<u4")
        raw = [b"" if model.is_control(i) else bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        raw[self.unknown] = " ⁇ ".encode()
        self.lengths = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    # BPE

    def timeline(self, piece: str) -> tuple | None:
        """How a piece merges by itself, best-scored neighbours first, the leftmost of equals: after each merge (score of
        the next one, first part, last part); None if it doesn't end as one part."""
        known = self.timelines.get(piece, ())
        if known == ():
            parts, steps = list(piece), []
            while True:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    score = self.scores.get(parts[k] + parts[k + 1])
                    if score is not None and (best is None or score > best):
                        best, at = score, k
                steps.append((best, parts[0], parts[-1]))
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self.timelines[piece] = tuple(steps) if len(parts) == 1 else None
        return known

    def fits(self, u: str, t: str) -> bool:
        """Whether u and t stay as they are side by side (u is empty at the start of a word).

        Each merges by itself as long as its next merge is at least as good as one across the border.
        """
        right = self.timeline(t)
        left = self.timeline(u) if u else ()
        if left is None or right is None:
            return False
        i = j = 0
        while u:
            across = self.scores.get(left[i][2] + right[j][1])
            mine, theirs = left[i][0], right[j][0]
            if across is not None and (mine is None or across > mine) and (theirs is None or across >= theirs):
                return False
            if mine is None and theirs is None:
                return True
            if theirs is None or (mine is not None and mine >= theirs):
                i += 1
            else:
                j += 1
        return True

    def _extend_bpe(self, word: str, states: list) -> None:
        """States of the prefixes from len(states) on: (last piece, what is known of pieces behind it)."""
        tails, pairs = self.tails, self.pairs
        for end in range(len(states), len(word) + 1):
            for start in range(end - 1, -1, -1):
                t = word[start:end]
                piece = tails.get(t)
                if piece or start == end - 1:
                    last, known = states[start]
                    ok = known.get(t)
                    if ok is None:
                        ok = known[t] = self.fits(last, t)
                        self.n_pairs += 1
                    if ok:
                        states.append((t, pairs.setdefault(t, {})))
                        break
                elif piece is None:
                    raise AssertionError("every prefix has an encoding")

    def _extend_unigram(self, word: str, states: list) -> None:
        """States of the prefixes from len(states) on: (last piece, best score)."""
        scores = self.scores
        for end in range(len(states), len(word) + 1):
            best, last = None, None
            for start in range(max(0, end - self.longest), end):
                t = word[start:end]
                score = scores.get(t)
                if score is None and start == end - 1:
                    score = self.unknown_score
                if score is not None and (best is None or states[start][1] + score > best):
                    best, last = states[start][1] + score, t
            states.append((last, best))

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Each distinct word's ids, as bytes."""
        if self.n_pairs > 4 * self.most:
            self.pairs, self.n_pairs = {}, 0
        bpe = self.kind == BPE
        extend = self._extend_bpe if bpe else self._extend_unigram
        states: list = [("", self.pairs.setdefault("", {})) if bpe else ("", 0.0)]
        before, out, known, kind = "", {}, self.ids, self.dtype.char
        for word in sorted(words):
            shared = len(os.path.commonprefix((before, word)))
            del states[shared + 1 :]
            extend(word, states)
            ids: list[int] = []
            end = len(word)
            while end:
                t = states[end][0]
                i = known.get(t)
                if i is not None:
                    ids.append(i)
                elif self.bytes_at:
                    ids += [self.bytes_at[b] for b in reversed(t.encode())]
                elif not (ids and ids[-1] == self.unknown):
                    ids.append(self.unknown)
                end -= len(t)
            ids.reverse()
            out[word] = array.array(kind, ids).tobytes()
            before = word
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*split) - self.words.keys() if split else set()
        if len(self.words) + len(new) > self.most and self.words:
            self.old, self.words = self.words, {}
            new = set().union(*split)
        known = {w: self.old[w] for w in new if w in self.old}
        self.words |= known
        self.words |= self.encode_words(new - known.keys())
        return [np.frombuffer(b"".join(map(self.words.__getitem__, words)), self.dtype) for words in split]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([np.empty(0, np.int64), *(x.astype(np.int64) for x in ids)])
        data = self.raw[ranges(self.starts[flat], self.lengths[flat])].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.lengths[flat])])[np.cumsum(sizes)].tolist() if len(ids) else []
        begins = [0, *ends[:-1]]
        return [data[a + (data[a : a + 1] == b" ") : b].decode(errors="replace") if b > a else "" for a, b in zip(begins, ends, strict=True)]


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One per Python worker: workers are reused from task to task."""
    return Pieces(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in slices(batches, "text", 1 << 20):
            ids = pa.array([x.tobytes() for x in model.encode(batch.column("text").to_pylist())], pa.binary())
            yield pa.record_batch([*batch.columns, ids], [*batch.schema.names, "ids"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with ids: the text's ids as little-endian unsigned integers of 16 bits (32 for over 65,536 pieces)."""
    rows = without(docs, "ids")
    return map_in_arrow(rows, _encode(path), with_fields(rows, "ids binary"))


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            ids = [np.frombuffer(x or b"", model.dtype) for x in batch.column("ids").to_pylist()]
            rest = [c for c in batch.schema.names if c != "ids"]
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(model.decode(ids), pa.string())]
            yield pa.record_batch([*(batch.column(c) for c in rest), *columns], [*rest, "n_ids", "ids_crc32", "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with n_ids, ids_crc32 (over unsigned 32-bit integers) and decoded in place of ids."""
    more = "n_ids long, ids_crc32 long, decoded string"
    rows = without(encoded, "n_ids", "ids_crc32", "decoded")
    return map_in_arrow(rows, _decode(path), with_fields(rows, more, ("ids",)))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded): encode() and decode() one after the other in one Python worker."""
    there, back = _encode(path), _decode(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return back(batch.select(["doc_id", "ids"]) for batch in there(batches))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text: number and CRC of its ids, digest of what they read back as."""
    import public_tokenizers

    found = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_ids", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))

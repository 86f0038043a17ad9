"""Chat formatting by columnar byte assembly.

A turn becomes `<|start|>role<|text|>content<|end|>`. Inside roles and contents every `<` and `[` gets a `\\`
behind it and every `\\` is doubled, so no control string of this or the usual bracketed templates can appear
there, and reading back is exact. Per Arrow batch, numpy computes segment lengths, cumulative offsets and scatter
indices, and copies headers and contents into one preallocated buffer.

Turns are dealt out by conversation and sorted, then streamed: a conversation that spans batches is written as
several parts in order, and the reader carries a running digest from part to part, so memory stays bounded
whatever a conversation's length.

Defined cases: null role or text counts as empty; a null conv_id is a conversation of its own; turns go by
(turn, role, text), null turns first; repeated rows are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm.common import table, text_buffers

START, TEXT, END = b"<|start|>", b"<|text|>", b"<|end|>"
ESCAPED = np.zeros(256, np.uint8)
ESCAPED[list(b"<[\\")] = 1
PARTS = "conv_id long, n_turns long, formatted binary, loss_starts array<long>, loss_ends array<long>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Escaped bytes and their offsets: each byte moves right by the number of marked bytes before it."""
    marked = ESCAPED[data]
    shift = np.zeros(len(data) + 1, np.int64)
    np.cumsum(marked, out=shift[1:])
    out = np.full(len(data) + int(shift[-1]), ord("\\"), np.uint8)
    out[np.arange(len(data)) + shift[:-1]] = data
    return out, offsets + shift[offsets]


def unescape(data: np.ndarray) -> np.ndarray:
    """Drops the backslash behind each marked byte. A run of backslashes is pairs, but for one that ends a `<` or `[` mark."""
    slash = data == ord("\\")
    if not slash.any():
        return data
    before = np.zeros(len(data), bool)  # right behind a `<` or `[`
    before[1:] = (data[:-1] == ord("<")) | (data[:-1] == ord("["))
    own = slash & ~before  # these come in pairs
    count = np.cumsum(own)
    first = own.copy()
    first[1:] &= ~own[:-1]
    base = np.maximum.accumulate(np.where(first, count, 0))
    drop = (slash & before) | (own & ((count - base) % 2 == 1))
    return data[~drop]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns, their offsets in it, and where each content begins and ends."""
    fixed = [np.frombuffer(x, np.uint8) for x in (START, TEXT, END)]
    role, role_at = escape(*text_buffers(roles))
    text, text_at = escape(*text_buffers(texts))
    n = len(role_at) - 1
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = map(len, fixed)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    begins = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, segment in zip((0, 2, 4), fixed, strict=True):
        out[begins[:, k, None] + np.arange(len(segment))] = segment
    out[ranges(begins[:, 1], lengths[:, 1])] = role
    out[ranges(begins[:, 3], lengths[:, 3])] = text
    return out, np.append(begins[:, 0], len(out)), begins[:, 3], ends[:, 3]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        out, at, begin, end = assemble(batch.column("role"), batch.column("text"))
        conv = batch.column("conv_id")
        ids = conv.fill_null(0).to_numpy(zero_copy_only=False)
        null = conv.is_null().to_numpy(zero_copy_only=False)
        learn = np.array([r == "assistant" for r in batch.column("role").to_pylist()], bool)
        first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])])
        last = np.append(first[1:], len(ids))
        cuts = at[np.append(first, len(ids))]
        chosen = np.flatnonzero(learn)
        spans = np.append(np.searchsorted(chosen, first), len(chosen)).astype(np.int32)
        base = np.repeat(at[first], np.diff(spans))
        buffers = [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out)]
        yield pa.record_batch(
            [
                conv.take(pa.array(first)),
                pa.array(last - first, pa.int64()),
                pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), buffers).cast(pa.binary()),
                pa.ListArray.from_arrays(spans, pa.array(begin[chosen] - base)),
                pa.ListArray.from_arrays(spans, pa.array(end[chosen] - base)),
            ],
            ["conv_id", "n_turns", "formatted", "loss_starts", "loss_ends"],
        )


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_starts, loss_ends): the parts of each conversation, in order within a partition.

    loss_starts and loss_ends are byte positions in `formatted` of the assistant's contents.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format, PARTS)


def _chars(data: bytes) -> int:
    """Code points: bytes that don't continue one."""
    return int(((np.frombuffer(data, np.uint8) & 0xC0) != 0x80).sum())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: list | None = None  # conv_id, turns, digest of turns, loss characters, digest of loss, characters
    done: list[tuple] = []

    def close() -> None:
        if state:
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

    def flush() -> pa.RecordBatch:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = zip(*done, strict=True) if done else [[]] * 6
        out = pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)
        done.clear()
        return out

    for batch in batches:
        columns = (batch.column(c) for c in ("conv_id", "formatted", "loss_starts", "loss_ends"))
        for conv, data, starts, ends in zip(*columns, strict=True):
            conv, data = conv.as_py(), data.as_py()
            if state is None or state[0] != conv:
                close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for turn in data.split(START)[1:]:
                role, _, rest = turn.partition(TEXT)
                content, _, _ = rest.partition(END)
                state[1] += 1
                for piece in (role, content):
                    state[2].update(unescape(np.frombuffer(piece, np.uint8)).tobytes() + b"\n")
            for a, b in zip(starts.as_py(), ends.as_py(), strict=True):
                plain = unescape(np.frombuffer(data[a:b], np.uint8)).tobytes()
                state[3] += _chars(plain)
                state[4].update(plain)
            state[5] += _chars(data)
        yield flush()
    close()
    yield flush()


def conversation_digests(parts: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, one row per conversation."""
    return parts.mapInArrow(_read, DIGESTS)


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The turns, and conversation -7, whose texts consist of control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_digests(format_conversations(with_probe(spark, table(spark, sf_dir, "conversations"))))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, 24 + length(role) + length(text)
         + length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

"""Token-ID output: fixed-width bit packing with block offsets.

Every id takes ceil(log2(vocabulary size)) bits. Documents are dealt out by ranges of doc_id and sorted, encoded,
and written as *segments*: rows of whole documents with about `segment_ids` ids or one longer document. A segment
holds its packed ids, the byte offset of each block of `BLOCK` ids, and its documents' ids and positions, so it
can be read alone, and a document in it without unpacking the others; its doc_id range is in the Parquet statistics, which makes reading some documents a pruned scan.
Part and segment numbers follow doc_id order. A document's position in the whole output is its position in its
part plus the ids of all parts before it; only one count per part ever reaches the driver.

Defined cases: a null text counts as empty and yields the end id alone; null doc_ids come first; rows with equal
doc_id go by a hash of the text, then the text; repeated rows are written each; other columns are not written; an
empty table gives no segments.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from newsdesk.llm.common import Scratch, slices, table
from newsdesk.llm.tokens import encoder

BLOCK = 4096
SEGMENTS = (
    "part int, segment int, first_doc long, last_doc long, bits int, n_ids long, packed binary, block_offsets array<long>, "
    "doc_ids array<long>, starts array<long>, lengths array<long>"
)


def width_of(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit string of `bits` bits an id. 64 ids take `bits` whole 64-bit words; the last ones are filled up with 0."""
    lanes = np.zeros(-(-len(ids) // 64) * 64, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(-1, 64)
    words = np.zeros((len(lanes), bits), "<u8")
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        words[:, word] |= lanes[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, i] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack(data: bytes, bits: int, n: int, start: int = 0) -> np.ndarray:
    """`n` ids from id `start` on, as unsigned 32-bit; reads only the words that hold them."""
    first, last = start // 64, -(-(start + n) // 64)
    words = np.frombuffer(data, "<u8", (last - first) * bits, 8 * first * bits).reshape(-1, bits)
    lanes = np.empty((len(words), 64), "<u4")
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        found = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            found = found | words[:, word + 1] << np.uint64(64 - shift)
        lanes[:, i] = found & mask
    return lanes.ravel()[start - 64 * first : start - 64 * first + n]


def unpack_from(data: bytes, block_offsets: np.ndarray, bits: int, n: int, start: int) -> np.ndarray:
    """Random access: `n` ids from id `start` on, from the blocks that hold them."""
    one, last = start // BLOCK, (start + n - 1) // BLOCK
    end = block_offsets[last + 1] if last + 1 < len(block_offsets) else len(data)
    return unpack(memoryview(data)[block_offsets[one] : end], bits, n, start - one * BLOCK)


def _encode(path: str, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, part = encoder(path), TaskContext.get().partitionId()
        bits = width_of(max(chunks.tokenizer.get_vocab_size(), end_id + 1))
        end = np.array([end_id], chunks.dtype)
        held, docs, n, before, segment = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            lengths = np.array([len(x) for x in held])
            starts = before + np.cumsum(lengths) - lengths
            blocks = np.arange(0, len(ids), BLOCK) * bits // 8
            known = [d for d in docs if d is not None]
            row = {
                "part": part, "segment": segment, "first_doc": min(known, default=None), "last_doc": max(known, default=None), "bits": bits,
                "n_ids": len(ids), "packed": pack(ids, bits), "block_offsets": blocks, "doc_ids": list(docs), "starts": starts, "lengths": lengths,
            }
            return pa.RecordBatch.from_pylist([row], SCHEMA)

        for batch in slices(batches, "text"):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), chunks.encode_all(batch.column("text")), strict=True):
                ids = np.concatenate([ids, end])
                if held and n + len(ids) > segment_ids:
                    yield close()
                    before, segment, n = before + n, segment + 1, 0
                    held, docs = [], []
                held.append(ids)
                docs.append(doc)
                n += len(ids)
        if held:
            yield close()

    return run


_L = pa.list_(pa.int64())
SCHEMA = pa.schema(
    [("part", pa.int32()), ("segment", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("bits", pa.int32())]
    + [("n_ids", pa.int64()), ("packed", pa.binary()), ("block_offsets", _L), ("doc_ids", _L), ("starts", _L), ("lengths", _L)]
)


def segments(docs: DataFrame, tokenizer: str, end_id: int = 2, segment_ids: int = 1 << 18) -> DataFrame:
    """The rows to write: `docs` encoded and packed, in ascending doc_id order over parts."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "h", "text"]  # the hash parts rows with one doc_id, or none
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    spread = F.xxhash64(F.monotonically_increasing_id())  # parts equal rows
    ranged = rows.repartitionByRange(parts, *order[:2], spread).sortWithinPartitions(*order).drop("h")
    return ranged.mapInArrow(_encode(tokenizer, end_id, segment_ids), SEGMENTS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            first, crcs, at = row["starts"][0], [], 0
            starts, lengths = np.array(row["starts"]) - first, np.array(row["lengths"])
            while at < len(starts):  # documents of about 2^20 ids, or a longer one, at a time
                to = max(at + 1, int(np.searchsorted(starts + lengths, starts[at] + (1 << 20), "right")))
                ids = unpack_from(row["packed"], row["block_offsets"], row["bits"], int(starts[to - 1] + lengths[to - 1] - starts[at]), int(starts[at]))
                crcs += [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip((starts[at:to] - starts[at]).tolist(), lengths[at:to].tolist(), strict=True)]
                at = to
            parts = pa.array(np.full(len(crcs), row["part"], np.int32))
            columns = [pa.array(row["doc_ids"], pa.int64()), parts, pa.array(row["starts"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.record_batch(columns, ["doc_id", "part", "local", "n_tokens", "ids_crc32"])


def read_digests(written: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from written segments."""
    sums = written.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row per part
    ends = np.cumsum([0, *(r["n"] for r in sums)]).tolist()
    rows = [(r["part"], at) for r, at in zip(sums, ends, strict=False)]
    offsets = F.broadcast(written.sparkSession.createDataFrame(rows, "part int, before long"))
    docs = written.select("packed", "block_offsets", "bits", "part", "doc_ids", "starts", "lengths").mapInArrow(
        _digest, "doc_id long, part int, local long, n_tokens long, ids_crc32 long"
    )
    return docs.join(offsets, "part").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(written: DataFrame, doc_id: int) -> list[np.ndarray]:
    """Random access: the ids of one document, read from the segments whose range holds it."""
    hits = written.where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).where(F.array_contains("doc_ids", doc_id))
    found = []
    for row in hits.collect():  # the segments of one document
        for d, s, n in zip(row["doc_ids"], row["starts"], row["lengths"], strict=True):
            if d == doc_id:
                found.append(unpack_from(bytes(row["packed"]), row["block_offsets"], row["bits"], n, s - row["starts"][0]))
    return found


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    written = Scratch(spark, "token-files").write(segments(table(spark, sf_dir, "documents"), path), "segments")
    return read_digests(written)

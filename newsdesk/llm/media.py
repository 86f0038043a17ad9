"""Media columns: baseline JPEG, DC-only luminance thumbnails.

`decode` parses the markers of any baseline JPEG (8-bit, sequential, Huffman; grey or colour, any sampling,
with or without restart intervals), Huffman-decodes its scan, keeps each luminance block's DC coefficient and
gives the thumbnail of one pixel per 8x8 block. Restart intervals are independent of each other, so numpy decodes
all intervals of a batch's images in step, a symbol at a time.

`encode` stores bytes losslessly as such an image: the unit is the DC coefficient of a block, whose quantiser is 8,
so a block of the constant sample v has the coefficient v - 128 and reads back as v. Rows of `COLUMNS` blocks are
restart intervals. An image has at most 8191 rows of blocks; longer data is a sequence of images. `store` gives bytes
that are common in text the samples about 128 (`PALETTE`), so that neighbours differ little and their codes are short.

Defined cases: a null text counts as empty and is stored as one row of spaces; equal texts give equal bytes; bytes
that are no baseline JPEG, that contradict themselves or end early give null features; an empty table gives no rows;
repeated rows are stored each; other columns stay, except those with the name of a new one, which are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from newsdesk.llm.chat_format import ranges
from newsdesk.llm.common import Scratch, map_in_arrow, slices, table, text_buffers, with_fields, without

COLUMNS, MOST_ROWS = 192, 8191
#: Code length of each size of a DC difference, chosen for text; the one AC symbol is the end of block.
DC_LENGTHS = {2: 2, 3: 2, 4: 2, 1: 3, 5: 4, 0: 5, 6: 7, 7: 7, 8: 7}


def _palette() -> np.ndarray:
    """Sample of each byte: 128, 129, 127, 130 .. by how common bytes are in text; those that are not listed follow by value."""
    common = list(dict.fromkeys([*b" etaoinshrdlucm\xc3gpbf.,wyvkqxjz", *range(0xA0, 0xC0), *b"\n0123456789", *range(65, 91), *range(32, 127), *range(256)]))
    found = np.empty(256, np.uint8)
    found[common] = 128 + np.array([(k + 1) // 2 if k % 2 else -(k // 2) for k in range(256)])
    return found


PALETTE = _palette()
BYTES = np.argsort(PALETTE).astype(np.uint8)  # of each sample


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), canonical."""
    code, last, out = 0, 0, {}
    for symbol, n in lengths.items():
        code <<= n - last
        out[symbol], code, last = (code, n), code + 1, n
    return out


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    body = bytes([kind]) + counts + bytes(lengths)
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


@functools.cache
def _header() -> tuple[bytes, int]:
    """Everything before the scan, and where the height goes."""
    dqt = b"\xff\xdb\x00\x43\x00\x08" + b"\x01" * 63
    sof = b"\xff\xc0\x00\x0b\x08\x00\x00" + struct.pack(">H", 8 * COLUMNS) + b"\x01\x01\x11\x00"
    dri = b"\xff\xdd\x00\x04" + struct.pack(">H", COLUMNS)
    sos = b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
    head = b"\xff\xd8" + dqt
    return head + sof + _dht(0, DC_LENGTHS) + _dht(0x10, {0: 1}) + dri + sos, len(head) + 5


def _pack_rows(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the codes (at most 16 bits each), every row filled up to a byte with ones, and where each row ends."""
    bits = n.sum(axis=1)
    fill = -bits % 8
    words, lengths = code[:, ::4], n[:, ::4]  # four codes make a word
    for k in (1, 2, 3):
        words, lengths = words << n[:, k::4].astype(np.uint64) | code[:, k::4], lengths + n[:, k::4]
    words = np.concatenate([words, ((1 << fill) - 1).astype(np.uint64)[:, None]], axis=1).ravel()
    lengths = np.concatenate([lengths, fill[:, None]], axis=1).ravel()
    ends = np.cumsum(lengths)
    at = ends - lengths
    off = at & 63
    left = np.where(lengths > 0, words << ((64 - lengths) & 63).astype(np.uint64), 0).astype(np.uint64)
    first = np.flatnonzero(np.diff(at >> 6, prepend=-1))
    out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
    out[at[first] >> 6] = np.bitwise_or.reduceat(left >> off.astype(np.uint64), first)
    over = np.flatnonzero(off + lengths > 64)
    out[(at[over] >> 6) + 1] |= left[over] << (64 - off[over]).astype(np.uint64)
    return out.astype(">u8").view(np.uint8)[: int(ends[-1]) // 8], np.cumsum((bits + 7) // 8)


def encode(data: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The stored form of each payload; `data` holds them one after the other, `sizes` are multiples of COLUMNS."""
    rows = data.reshape(-1, COLUMNS).astype(np.int16) - 128
    diff = np.diff(rows, axis=1, prepend=np.int16(0))
    size = np.ceil(np.log2(np.abs(np.arange(256)) + 1)).astype(np.uint8)[np.abs(diff)]
    codes = _codes(DC_LENGTHS)
    prefix = np.array([codes[k][0] for k in range(9)], np.uint16)[size]
    width = np.array([codes[k][1] for k in range(9)], np.uint8)[size]
    value = np.where(diff >= 0, diff, diff + (1 << size.astype(np.int16)) - 1).astype(np.uint16)
    n = width.astype(np.int64) + size + 1  # and the end of block, a 0 bit
    code = (prefix.astype(np.uint64) << size | value) << np.uint64(1)
    coded, row_ends = _pack_rows(code, n)
    full = coded == 0xFF
    shift = np.concatenate([[0], np.cumsum(full)])
    row_sizes = np.diff(row_ends + shift[row_ends], prepend=0)

    head, at_height = _header()
    images, owners = [], []  # rows of each image, payload of each image
    for k, r in enumerate((sizes // COLUMNS).tolist()):
        cut = [min(MOST_ROWS, r - i) for i in range(0, r, MOST_ROWS)]
        images += cut
        owners += [k] * len(cut)
    images = np.array(images, np.int64)
    first = np.cumsum(images) - images
    is_first = np.zeros(len(rows), np.int64)
    is_first[first] = 1
    number = np.arange(len(rows)) - np.repeat(first, images)
    starts = np.cumsum(row_sizes + 2 + len(head) * is_first) - row_sizes - 2
    out = np.zeros(int(starts[-1] + row_sizes[-1] + 2), np.uint8)
    place = ranges(starts, row_sizes)
    stuffed = np.zeros(len(place), np.uint8)
    stuffed[np.arange(len(coded)) + shift[:-1]] = coded
    out[place] = stuffed
    begins = starts[first] - len(head)
    out[begins[:, None] + np.arange(len(head))] = np.frombuffer(head, np.uint8)
    out[begins + at_height], out[begins + at_height + 1] = 8 * images >> 8, 8 * images & 0xFF
    after = starts + row_sizes
    out[after], out[after + 1] = 0xFF, 0xD0 + number % 8
    out[after[first + images - 1] + 1] = 0xD9
    ends = np.append(begins[1:], len(out))
    whole = out.tobytes()
    found = [b""] * len(sizes)
    for k, a, b in zip(owners, begins.tolist(), ends.tolist(), strict=True):
        found[k] += whole[a:b]
    return found


@dataclass
class Image:
    """What the markers say, and where the scan's bytes are."""

    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # (id, h, v, quantiser)
    tables: dict = field(default_factory=dict)  # (class, id) -> bytes of the table
    quantisers: dict = field(default_factory=dict)  # id -> DC quantiser
    restart: int = 0
    scan: list = field(default_factory=list)  # (component, DC table, AC table)
    begin: int = 0
    end: int = 0

    def blocks(self) -> tuple[int, int]:
        return -(-self.height // 8), -(-self.width // 8)


def parse(data: bytes) -> list[Image]:
    """The baseline images in `data`, one after the other."""
    found, at = [], 0
    while at < len(data):
        image = Image()
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker")
            kind = data[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xC0:
                if body[0] != 8:
                    raise ValueError("samples of another size than 8 bits")
                image.height, image.width, n = struct.unpack_from(">HHB", body, 1)
                image.components = [(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[6 + 3 * i : 9 + 3 * i] for i in range(n))]
                if not image.height or not image.width or not all(1 <= h <= 4 and 1 <= v <= 4 for _, h, v, _ in image.components):
                    raise ValueError("no size")
            elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    image.quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    if len(body) < n or sum(k << (16 - i) for i, k in enumerate(body[1:17], 1)) > 1 << 16:
                        raise ValueError("no prefix code")
                    image.tables[body[0] >> 4, body[0] & 15] = body[1:n]
                    body = body[n:]
            elif kind == 0xDD:
                image.restart = struct.unpack(">H", body)[0]
            elif kind == 0xDA:
                image.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                break
        if not image.components or len(image.scan) != len(image.components):
            raise ValueError("one interleaved scan is expected")
        if any(c[3] not in image.quantisers for c in image.components):
            raise ValueError("no quantiser")
        image.begin = at
        end = data.find(b"\xff\xd9", at)  # within a scan an FF is followed by 00 or a restart marker
        if end < 0:
            raise ValueError("no end of image")
        image.end, at = end, end + 2
        found.append(image)
    if not found:
        raise ValueError("empty")
    return found


@functools.lru_cache(maxsize=64)
def _lookup(table_bytes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits: length of the code they begin with (0: none), and its symbol."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(table_bytes[n - 1]):
            low, high = code << (16 - n), (code + 1) << (16 - n)
            length[low:high], symbol[low:high] = n, table_bytes[at]
            code, at = code + 1, at + 1
        code <<= 1
    return length, symbol


def decode(files: list[bytes]) -> list[list[tuple[Image, np.ndarray]] | None]:
    """For each file its images with their luminance thumbnails; None where it is no baseline JPEG."""
    parsed: list[list[Image] | None] = []
    alike: dict[tuple, list[tuple[int, int, Image]]] = {}
    for i, data in enumerate(files):
        try:
            images = parse(data)
        except (ValueError, IndexError, struct.error):
            parsed.append(None)
            continue
        parsed.append(images)
        for k, image in enumerate(images):
            kinds = tuple((image.tables.get((0, d)), image.tables.get((1, a))) for _, d, a in image.scan)
            shape = tuple(c[1:3] for c in image.components)
            alike.setdefault((kinds, shape), []).append((i, k, image))
    thumbs: dict[tuple[int, int], np.ndarray | None] = {}
    for (kinds, shape), members in alike.items():
        if any(t is None for pair in kinds for t in pair):
            thumbs |= {(i, k): None for i, k, _ in members}
            continue
        _decode_alike(files, members, kinds, shape, thumbs)
    return [None if images is None or any(thumbs[i, k] is None for k in range(len(images))) else [(x, thumbs[i, k]) for k, x in enumerate(images)] for i, images in enumerate(parsed)]


def _decode_alike(files, members, kinds, shape, thumbs) -> None:
    """Images with the same tables and sampling: all their restart intervals in step."""
    pieces, starts, ends, at, mcus, lane_of = [], [], [], 0, [], []
    schedule = [c for c, (h, v) in enumerate(shape) for _ in range(1 if len(shape) == 1 else h * v)]
    h, v = max(c[0] for c in shape), max(c[1] for c in shape)
    for m, (i, _, image) in enumerate(members):
        raw = np.frombuffer(files[i], np.uint8)[image.begin : image.end]
        marks = np.flatnonzero(raw[:-1] == 0xFF)
        marks = marks[(raw[marks + 1] >= 0xD0) & (raw[marks + 1] <= 0xD7)]
        stuffing = np.zeros(len(raw), bool)
        stuffing[1:] = (raw[:-1] == 0xFF) & (raw[1:] == 0)
        keep = ~stuffing
        keep[marks], keep[marks + 1] = False, False
        kept = np.concatenate([[0], np.cumsum(keep)])
        begins = kept[np.append(0, marks + 2)]
        total = -(-image.width // (8 * h)) * -(-image.height // (8 * v)) if len(shape) > 1 else int(np.prod(image.blocks()))
        each = image.restart or total
        if -(-total // each) != len(begins):
            continue
        counts = np.minimum(each, total - each * np.arange(len(begins)))
        lane_ends = np.append(begins[1:], kept[-1])
        if (2 * counts * len(schedule) > 8 * (lane_ends - begins)).any():  # a block has two bits at least
            continue
        pieces.append(raw[keep])
        starts.append(begins + at)
        ends.append(lane_ends + at)
        at += int(kept[-1])
        mcus.append(counts)
        lane_of.append(m)
    thumbs |= {(i, k): None for i, k, _ in members}
    if not pieces:
        return
    data = np.concatenate([*pieces, np.full(8, 0xFF, np.uint8)]).astype(np.int64)
    window = data[:-4] << 32 | data[1:-3] << 24 | data[2:-2] << 16 | data[3:-1] << 8 | data[4:]  # 40 bits from each byte on
    limit = len(window) - 1
    lanes = np.concatenate(starts)
    counts = np.concatenate(mcus)
    order = np.argsort(-counts, kind="stable")
    lanes, todo, ends = lanes[order], counts[order], np.concatenate(ends)[order]
    position = lanes.astype(np.int64) * 8
    single = len(shape) == 1
    y_blocks = schedule.count(0)
    tables = [tuple(_lookup(t) for t in pair) for pair in kinds]
    previous = np.zeros((len(shape), len(lanes)), np.int64)
    sizes = todo * y_blocks
    first = np.cumsum(sizes) - sizes  # of each lane's coefficients
    dc = np.zeros(int(sizes.sum()), np.int32)
    bad = np.zeros(len(lanes), bool)

    def ahead(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """40 bits from the byte of bit p on, and how many of them are still to come at p."""
        return window[np.minimum(p >> 3, limit)], 40 - (p & 7)

    active = len(lanes)
    for step in range(int(todo.max())):
        active = int(np.searchsorted(-todo, -step, "left"))  # lanes with more than `step` units
        y = 0
        for c in schedule:
            (dc_length, dc_symbol), (ac_length, ac_symbol) = tables[c]
            p = position[:active]
            word, rest = ahead(p)
            bits = (word >> (rest - 16)) & 0xFFFF
            n, size = dc_length[bits], dc_symbol[bits]
            bad[:active] |= (n == 0) | (size > 11)
            size = np.minimum(size, 11)
            n = n + size
            raw = (word >> (rest - n)) & ((1 << size) - 1)
            previous[c, :active] += np.where(raw < (1 << size >> 1), raw - (1 << size) + 1, raw)
            p = p + n
            if c == 0:
                dc[first[:active] + (step * y_blocks + y)] = previous[0, :active]
                y += 1
            word, rest = ahead(p)
            bits = (word >> (rest - 16)) & 0xFFFF
            n, symbol = ac_length[bits], ac_symbol[bits]
            bad[:active] |= n == 0
            p += n + (symbol & 15)
            going = np.flatnonzero((symbol != 0) & (n > 0))  # most blocks end here
            k = np.zeros(active, np.int64)
            k[going] = 1 + np.where(symbol[going] == 0xF0, 16, (symbol[going] >> 4) + 1)
            going = going[k[going] < 64]
            while len(going):
                word, rest = ahead(p[going])
                bits = (word >> (rest - 16)) & 0xFFFF
                n, symbol = ac_length[bits], ac_symbol[bits]
                bad[going] |= n == 0
                p[going] += n + (symbol & 15)
                k[going] += np.where(symbol == 0xF0, 16, (symbol >> 4) + 1)
                going = going[(symbol != 0) & (n > 0) & (k[going] < 64)]
            position[:active] = p
        if step % 64 == 63:
            bad |= position > 8 * ends
            if bad[:active].all():  # the lanes that went on are bad, and those that ended stay as they are
                break
    bad |= position > 8 * ends
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    at = 0
    for m, c in zip(lane_of, mcus, strict=True):
        i, k, image = members[m]
        rows = back[at : at + len(c)]
        at += len(c)
        if bad[rows].any():
            continue
        units = dc[ranges(first[rows], sizes[rows])]
        high, wide = image.blocks()
        if single:
            grid = units.reshape(high, wide)
        else:
            own_h, own_v = shape[0]
            across = -(-image.width // (8 * h))
            grid = units.reshape(-1, across, own_v, own_h).transpose(0, 2, 1, 3).reshape(-1, across * own_h)[:high, :wide]
        q = image.quantisers[image.components[0][3]]
        thumbs[i, k] = np.clip((grid * q + 4) // 8 + 128, 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: whether each cell of an 8x8 grid is brighter than the mean cell."""
    high, wide = thumb.shape
    rows, cols = np.arange(8) * high // 8, np.arange(8) * wide // 8
    cells = thumb.astype(np.float64)
    down = np.add.reduceat(cells, np.unique(rows), axis=0)[np.searchsorted(np.unique(rows), rows)]
    grid = np.add.reduceat(down, np.unique(cols), axis=1)[:, np.searchsorted(np.unique(cols), cols)]
    n_rows = np.diff(np.append(np.unique(rows), high))[np.searchsorted(np.unique(rows), rows)]
    n_cols = np.diff(np.append(np.unique(cols), wide))[np.searchsorted(np.unique(cols), cols)]
    grid = grid / (n_rows[:, None] * n_cols)
    return np.packbits((grid > grid.mean()).ravel()).tobytes().hex()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        data, offsets = text_buffers(batch.column("text"))
        n = np.diff(offsets)
        sizes = np.maximum(1, -(-n // COLUMNS)) * COLUMNS
        padded = np.full(int(sizes.sum()), 32, np.uint8)
        padded[ranges(np.cumsum(sizes) - sizes, n)] = data
        media = encode(PALETTE[padded], sizes)
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(n, pa.int64()), pa.array(media, pa.binary())], [*rest, "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """`docs` with n_bytes and media in place of text: its bytes, padded with spaces to whole rows, as JPEG."""
    rows = without(docs, "n_bytes", "media")
    return map_in_arrow(rows, _store, with_fields(rows, "n_bytes long, media binary", ("text",)))


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width long, height long, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in FEATURES.split(", ")]
    for batch in batches:
        media = batch.column("media").to_pylist()
        rest = [c for c in batch.schema.names if c != "media"]
        at = 0
        while at < len(media):
            to, size = at, 0
            while to < len(media) and (to == at or size + len(media[to] or b"") <= 2 << 20):
                size += len(media[to] or b"")
                to += 1
            rows = []
            for data, images in zip(media[at:to], decode([m or b"" for m in media[at:to]]), strict=True):
                own = (len(data), hashlib.sha256(data).hexdigest()) if data is not None else (None, None)
                if images is None:
                    rows.append((None, None, None, *own, None, None, None))
                    continue
                payload = b"".join(BYTES[t].tobytes() for _, t in images)
                image, thumb = images[0]
                feature = f"{len(images)}x{image.width}x{image.height}:{average_hash(thumb)}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *own, image.width, image.height, feature))
            columns = [batch.column(c).slice(at, to - at) for c in rest]
            columns += [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.record_batch(columns, [*rest, *names])
            at = to


def features(stored: DataFrame) -> DataFrame:
    """`stored` with what its column `media` says in place of it: dimensions, digests, thumbnail hash."""
    rows = without(stored, *(x.split()[0] for x in FEATURES.split(", ")))
    return map_in_arrow(rows, _features, with_fields(rows, FEATURES, ("media",)))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without(features(Scratch(spark, "media").write(store(docs), "media")), "width", "height")

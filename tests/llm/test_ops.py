"""Each operator against brute force on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from newsdesk.llm import chat_format, exact_dedup, language_id, line_dedup, media, near_dedup, packing, sentencepieces, substring_dedup, token_files  # noqa: E402
from newsdesk.llm.common import Scratch  # noqa: E402
from newsdesk.llm.components import components, joined_components  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, kept string, d long, score string"


def made_texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice(["th", "e", "an", "ou", "é", "ção", "x"]) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = text(200), text(70)
    words = base.split()
    near = [" ".join(w if i != k else "mudado" for i, w in enumerate(words)) for k in (20, 90)]
    chain = [words[:]]
    for k in range(4):  # each is near the one before, the ends are not near each other
        step = chain[-1][:]
        for i in range(6):
            step[5 + 25 * i + 4 * k] = f"novo{k}{i}"
        chain.append(step)
    return [
        base, None, "", base.replace(" ", " \n "), *near, *[" ".join(c) for c in chain], "a", "a b", "A  B", f"{text(30)} {passage} {text(30)}", f"{text(10)}\n{passage}", passage,
        text(20) + "\nlinha repetida que aparece em mais de um texto\n\nfim " + text(5), "linha repetida que aparecem em mais de um texto\noutra", "x" * 3000, text(3000), "<|endoftext|> É AQUI ção. 日本 1234 ﬁ İ Σας", "?!.. 123",
    ]


@pytest.fixture(scope="module")
def rows():
    found = [(10 * k % 37 + k * 100, t, "pt" if k % 2 else "en", "own", 7, "s") for k, t in enumerate(made_texts())]
    found += [found[0], (None, found[0][1], None, "own", 7, "s"), (None, "sem número", "pt", None, None, None), (5, found[2][1], "en", None, None, None)]
    random.Random(1).shuffle(found)
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(doc_id):
    return float("inf") if doc_id is None else doc_id


def tally(values):
    return sorted(map(repr, values))


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(docs, empty, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    want = []
    for r in rows:
        g = groups[normal(r[1])]
        keep = min((x for x in g if x is not None), default=None)
        want.append((r[0], keep, len(g), r[0] == keep, hashlib.sha256(normal(r[1]).encode()).hexdigest(), r[3]))
    got = exact_dedup.exact_dedup(docs.withColumn("group_size", F.lit("mine")), salts=2)
    fields = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert tally(tuple(r[c] for c in fields) for r in got.collect()) == tally(w[:5] for w in want)
    assert exact_dedup.exact_dedup(empty).count() == 0


def shingle_set(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else frozenset([tuple(words)] if words else [])


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup(docs, rows, size):
    sets = [shingle_set(r[1], size) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    best = {}
    for r, g in zip(rows, label, strict=True):
        best[g] = min(best.get(g, float("inf")), key(r[0]))
    want = []
    for r, s, g in zip(rows, sets, label, strict=True):
        c = (None if best[g] == float("inf") else best[g]) if s else r[0]
        want.append((r[0], len(s), c, r[0] == c))
    got = near_dedup.near_duplicates(docs, size)
    assert tally(tuple(r) for r in got.collect()) == tally(want)


def test_near_dedup_empty(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_links_across_components_of_a_bucket(spark, monkeypatch):
    """A member that is near others but not near the leader of any bucket, over several blocks."""
    from newsdesk.llm import bucket_links

    monkeypatch.setattr(bucket_links, "BLOCK", 2)
    words = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(12):  # each differs from the next in two words: ends are far apart, neighbours near
        texts.append(" ".join(f"n{i}" if i < 3 * k else w for i, w in enumerate(words)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(docs, 2).collect()} == {0}


def test_components(spark):
    scratch = Scratch(spark, "test")
    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(50)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    frame = spark.createDataFrame(pairs, "a long, b long")
    found = scratch.write(components(frame, scratch), "found")
    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            label[y] = x
    assert {r.node: r.component for r in found.collect()} == {n: find(n) for n in label}
    more = [(3, 120), (900, 901), (901, 3)]
    got = joined_components(found, spark.createDataFrame(more, "a long, b long"), scratch)
    for a, b in more:
        x, y = sorted((find(a), find(b)))
        label[y] = x
    assert {r.node: r.component for r in got.collect()} == {n: find(n) for n in label}


@pytest.mark.parametrize("group_bytes", [8 << 20, 2000, 0])
def test_substring_dedup(docs, rows, group_bytes):
    first = {}
    for r in rows:
        words = (r[1] or "").encode().split()
        for i in range(len(words) - 49):
            w = tuple(words[i : i + 50])
            first[w] = min(first.get(w, float("inf")), key(r[0]))
    want = []
    for r in rows:
        words = (r[1] or "").encode().split()
        gone = set()
        for i in range(len(words) - 49):
            if first[tuple(words[i : i + 50])] < key(r[0]):
                gone |= set(range(i, i + 50))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((r[0], len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    got = substring_dedup.remove_repeats(docs, group_bytes).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert tally(tuple(r) for r in got.collect()) == tally(want) and sum(w[2] for w in want) > 200


def test_substring_dedup_empty(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("tau", [0, 1, 2, 3])
def test_edit_join_parts(tau):
    rng = random.Random(tau)
    left, right = [], []
    for _ in range(400):
        a = [rng.choice("abé") for _ in range(rng.randint(0, 25))]
        b = list(a)
        for _ in range(rng.randint(0, tau + 2)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice("abc")] * rng.randint(0, 1)
        left.append("".join(a))
        right.append("".join(b))
    near = [distance(a, b) <= tau for a, b in zip(left, right, strict=True)]
    assert line_dedup.within(left, right, tau).tolist() == near
    for a, b, ok in zip(left, right, near, strict=True):
        if ok and a != b:
            keys, owner, index = line_dedup.entries([a, b], tau)
            sides = [{k for k, o, i in zip(keys, owner, index, strict=True) if o == w and (i or not only)} for w in (0, 1) for only in (True, False)]
            assert sides[0] & sides[3] or sides[2] & sides[1]


def test_line_dedup(docs, rows):
    places = defaultdict(set)
    for r in rows:
        if r[1] is not None:
            for at, line in enumerate(r[1].split("\n")):
                if line.strip(" \t\n\x0b\f\r"):
                    places[line].add((key(r[0]), at))
    lines = list(places)
    label = {x: x for x in lines}
    close = [(a, b) for a in lines for b in lines if a < b and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2]
    for _ in lines:
        for a, b in close:
            label[a] = label[b] = min(label[a], label[b])
    first = {}
    for x in lines:
        first[label[x]] = min([*places[x], first.get(label[x], (float("inf"), 1 << 60))])
    want = []
    for r in rows:
        own = r[1].split("\n") if r[1] is not None else []
        kept = [x for at, x in enumerate(own) if x not in label or first[label[x]] == (key(r[0]), at)]
        want.append((r[0], len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = line_dedup.remove_lines(docs).select("doc_id", "n_lines", "n_removed", "kept_sha256")
    assert tally(tuple(r) for r in got.collect()) == tally(want) and sum(w[2] for w in want) > 3


def test_line_dedup_empty(empty):
    assert line_dedup.remove_lines(empty).count() == 0


def test_language_id(spark, docs, empty):
    train = [(k, f"the and of that with {k % 7} thing house" if k % 2 else f"le la de que avec {k % 7} maison être", "en" if k % 2 else "fr") for k in range(200)]
    model = language_id.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "the house of that", "x"), (2, "la maison de que", "x"), (3, None, "x"), (4, "12 ?!", "x"), (5, "", "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language_id.predict(asked, model).collect()}
    assert [got[k].lang_pred for k in range(1, 6)] == ["en", "fr", "und", "und", "und"] and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(empty)).collect()} == {"und"}
    held = {r[0]: r[1] for r in docs.select("doc_id", language_id.held_out()).collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in held.items() if d is not None) and held[None] is False


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language_id.predict(docs, language_id.train(docs)).where(language_id.held_out() & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing(spark, docs, empty, rows):
    want = []
    for r, ids in zip(rows, library_ids([r[1] for r in rows]), strict=True):
        ids = np.array([*ids, 0], "<u4")
        want += [(r[0], k, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes())) for k, at in enumerate(range(0, len(ids), 512))]
    got = packing.pack(docs, WORDS, capacity=512).collect()
    assert tally(tuple(r)[:5] for r in got) == tally(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= -(-sum(r.length for r in got) // 512) + 2
    assert packing.pack(empty, WORDS).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 500, 20_000])
def test_packing_plan(n):
    rng = np.random.default_rng(n)
    lengths = np.minimum(2048, np.maximum(1, rng.lognormal(6, 1, n).astype(int)))
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan, placed, used = packing.Plan(histogram, 2048), defaultdict(int), defaultdict(int)
    for length, rank, count, sequence, offset in plan.runs:
        assert rank == placed[length]
        placed[length] += count
        for k in range(count):
            used[sequence + k] += length
    assert dict(placed) == histogram and all(u <= 2048 for u in used.values()) and len(used) == plan.sequences
    assert plan.sequences <= 1.01 * lengths.sum() / 2048 + 2


def test_token_files(spark, docs, empty, rows):
    written = Scratch(spark, "test-tokens").write(token_files.segments(docs, WORDS, segment_ids=700), "segments")
    hashed = lambda t: 42 if t is None else (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 - 2**63
    order = sorted(range(len(rows)), key=lambda i: (-1 if rows[i][0] is None else rows[i][0], hashed(rows[i][1])))
    encoded, at, want = library_ids([r[1] for r in rows]), 0, []
    for i in order:
        ids = np.array([*encoded[i], 2], "<u4")
        want.append((rows[i][0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert tally(tuple(r) for r in token_files.read_digests(written).collect()) == tally(want)
    some = max((i for i in order if rows[i][0] is not None), key=lambda i: len(encoded[i]))
    assert [x.tolist() for x in token_files.read_ids(written, rows[some][0])] == [[*encoded[some], 2]]
    assert token_files.read_digests(Scratch(spark, "test-tokens").write(token_files.segments(empty, WORDS), "segments")).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == 16 * bits * 8 and token_files.unpack(data, bits, 1001).tolist() == ids.tolist()
    plain = sum(int(x) << (bits * k) for k, x in enumerate(ids))
    assert int.from_bytes(data, "little") == plain
    assert token_files.unpack(data, bits, 17, 333).tolist() == ids[333:350].tolist()


def test_media(docs, empty, rows):
    got = media.features(media.store(docs.select("doc_id", "text"))).collect()
    want = []
    for r in rows:
        data = (r[1] or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")
        want.append((r[0], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert tally(tuple(r)[:5] for r in got) == tally(want)
    assert len({r.feature for r in got if r.payload_sha256 == got[0].payload_sha256}) == 1
    assert media.features(media.store(empty)).count() == 0


def test_media_foreign_and_broken_files(spark):
    tall = np.random.default_rng(0).integers(0, 256, 192 * 8200, dtype=np.uint8)
    (data,) = media.encode(tall, np.array([len(tall)]))
    (images,) = media.decode([data])
    assert len(images) == 2 and b"".join(t.tobytes() for _, t in images) == tall.tobytes()
    rows = spark.createDataFrame([(1, b"no image"), (2, None), (3, bytes(data[:500]))], "doc_id long, media binary")
    assert [r.feature for r in media.features(rows).collect()] == [None] * 3


def test_jpeg_with_ac_coefficients_and_colour():
    """A scan written bit by bit: three components, 2x1 sampling, AC symbols, no restart intervals."""
    dc, ac = {0: 2, 1: 2, 2: 2, 3: 3}, {0: 2, 0x21: 2, 0xF0: 2, 0x01: 3}
    dht = media._dht(0, dc) + media._dht(0x10, ac)
    dcc, acc = media._codes(dc), media._codes(ac)
    sof = b"\xff\xc0\x00\x11\x08\x00\x08\x00\x20\x03" + bytes([1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0])
    sos = b"\xff\xda\x00\x0c\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00"
    bits = ""

    def put(code):
        return format(code[0], f"0{code[1]}b")

    values = [3, -2, 1, 5]
    last, y = 0, iter(values)
    for _ in range(2):
        for block in ("y", "y", "c", "c"):
            d = 0
            if block == "y":
                v = next(y)
                d, last = v - last, v
            size = abs(d).bit_length()
            bits += put(dcc[size]) + (format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else "")
            bits += put(acc[0xF0]) + put(acc[0x21]) + "1" + put(acc[0])
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    data = b"\xff\xd8" + b"\xff\xdb\x00\x43\x00\x10" + b"\x01" * 63 + sof + dht + sos + scan + b"\xff\xd9"
    ((image, thumb),) = media.decode([data])[0]
    assert (image.width, image.height) == (32, 8) and thumb.tolist() == [[128 + 2 * v for v in values]]


def one_block_jpeg(height, width, scan, sampling=0x11, dc=None, quantiser=0):
    sof = b"\xff\xc0\x00\x0b\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, sampling, quantiser])
    tables = media._dht(0, dc or {0: 2, 1: 2, 2: 2}) + media._dht(0x10, {0: 1})
    return b"\xff\xd8" + b"\xff\xdb\x00\x43\x00\x08" + b"\x01" * 63 + sof + tables + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + scan + b"\xff\xd9"


def test_media_that_contradicts_itself(spark):
    """Sizes of zero, sampling of zero, more blocks than the scan has bits, no quantiser, no prefix code, an early end."""
    good = one_block_jpeg(8, 8, b"\x1f")
    files = [
        good, one_block_jpeg(0, 8, b"\x1f"), one_block_jpeg(8, 0, b"\x1f"), one_block_jpeg(8, 8, b"\x1f", 0), one_block_jpeg(2400, 2400, b"\x1f" * 100),
        one_block_jpeg(65528, 65528, b"\x1f" * 100), one_block_jpeg(8, 8, b"\x1f", quantiser=1), one_block_jpeg(8, 8, b"\x1f", dc={0: 1, 1: 1, 2: 1}),
        one_block_jpeg(8, 64, b"\xaa\xaa"), good[:40], good + good, good + b"x",
    ]
    rows = spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary").withColumn("feature", F.lit("own")).withColumn("a.b", F.lit(1))
    got = media.features(rows)
    assert got.columns.count("feature") == 1 and "a.b" in got.columns
    assert {r.doc_id for r in got.collect() if r.payload_bytes is not None} == {0, 10}


def test_media_palette_and_independent_digests(docs, rows):
    assert sorted(media.PALETTE.tolist()) == list(range(256)) and (media.BYTES[media.PALETTE] == np.arange(256)).all()
    stored = media.store(docs).collect()
    for r, f in zip(stored, media.features(media.store(docs)).collect(), strict=True):
        assert (f.media_bytes, f.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        thumb = np.concatenate([t for _, t in media.decode([bytes(r.media)])[0]]).astype(float)
        high, wide = thumb.shape
        edge = [[n * k // 8 for k in range(9)] for n in (high, wide)]
        cells = [[thumb[min(a, high - 1) : max(b, a + 1), c:d].mean() for c, d in zip(edge[1], edge[1][1:], strict=False)] for a, b in zip(edge[0], edge[0][1:], strict=False)]
        if high >= 8:
            bits = "".join(str(int(x > np.mean(cells))) for row in cells for x in row)
            assert f.feature == f"1x{f.width}x{f.height}:{int(bits, 2):016x}"


def test_chat(spark):
    said = "</s>[INST] ok [/INST]\\ <|end|> <\\|start|>é"
    rows = [(1, 0, "user", said), (1, 1, "assistant", "a<[\\\\["), (1, 2, "assistant", None), (2, None, None, ""), (None, 3, "user", "x"), (2, 1, "as<|text|>", said), (1, 2, "assistant", None)]
    turns = chat_format.with_probe(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    by = defaultdict(list)
    for c, t, r, x in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    parts = chat_format.format_conversations(turns)
    got = {r.conv_id: r for r in chat_format.conversation_digests(parts).collect()}
    assert got.keys() == by.keys()
    for c, own in by.items():
        own.sort()
        loss = "".join(x for _, r, x in own if r == "assistant")
        want = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[c])[1:5] == want
    shown = b"".join(bytes(r.formatted) for r in parts.collect())
    assert b"</s>" not in shown and b"[INST]" not in shown and shown.count(b"<|start|>") == len(rows) + 2
    assert chat_format.conversation_digests(chat_format.format_conversations(turns.limit(0))).count() == 0


def test_chat_parts():
    """A conversation over several batches reads back as one."""
    batch = lambda ids: pa.record_batch([pa.array(ids, pa.int64()), pa.array(["assistant"] * len(ids)), pa.array(["é"] * len(ids))], ["conv_id", "role", "text"])
    parts = list(chat_format._format(iter([batch([1, 1]), batch([1, 2]), batch([2])])))
    got = [r for b in chat_format._read(iter(parts)) for r in b.to_pylist()]
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in got] == [(1, 3, 3), (2, 2, 2)]


ODD = ["", "   ", " a  b ", "x ▁ y", "日本語 ①①", "</s> <s> <0x41>", "a\tb\nc", "a" * 500, "the" * 100, None, "é́ ü", "     lots    of"]


def test_sentencepiece(spark, docs, empty, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [r[1] for r in rows]
    model = sentencepieces.Pieces(PIECES, most=50)  # the cache turns over
    got = model.encode(texts) + model.encode(ODD)
    want = library.encode([t or "" for t in [*texts, *ODD]])
    assert [x.tolist() for x in got] == want
    assert model.decode(got) == library.decode(want)
    found = sentencepieces.decode(sentencepieces.encode(docs, PIECES), PIECES).select("doc_id", "n_ids", "decoded", "lang").collect()
    assert tally((r.doc_id, r.decoded) for r in found) == tally((r[0], r[1] or "") for r in rows)
    both = sentencepieces.round_trip(docs, PIECES).collect()
    assert tally((r.doc_id, r.n_ids, r.decoded) for r in both) == tally((r.doc_id, r.n_ids, r.decoded) for r in found)
    assert sentencepieces.round_trip(empty, PIECES).count() == 0


def test_sentencepiece_unigram(rows):
    """The same pieces as a unigram model: the scores add up, and the best sum wins."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = sentencepieces.UNIGRAM
    for piece in proto.pieces:
        piece.score = max(piece.score, -40000.0)
    data = proto.SerializeToString()
    texts = [t or "" for t in [*(r[1] for r in rows), *ODD]]
    got = sentencepieces.Pieces(data).encode(texts)
    assert [x.tolist() for x in got] == sentencepiece.SentencePieceProcessor(model_proto=data).encode(texts)

"""Source mixing and hard negatives against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from newsdesk.llm import curriculum, hard_negatives
from newsdesk.llm.common import Scratch


def filled(sizes, weights, most=3):
    """Targets by sharing the excess again until none is above."""
    target, full, words = {}, set(), sum(sizes.values())
    while True:
        rest = words - sum(most * sizes[s] for s in full)
        whole = sum(weights[s] for s in sizes if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weights[s] / whole for s in sizes}
        above = {s for s in sizes if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


DOCS = "doc_id long, source string, text string, number string, size string, target int"


def mixed_rows():
    rng = random.Random(4)
    rows = [(d, rng.choice(["a", "a", "a", "B", "é", "z", "", None]), " ".join(["w"] * rng.randrange(30)), "n", "s", 1) for d in range(300)]
    rows += [(None, "a", "one two", "n", "s", 1)] * 5 + [(3, "B", None, "n", "s", 1), (4, None, " \t\n", "n", "s", 1), (5, "rare", "x " * 3, "n", "s", 1), (6, "empty", "", "n", "s", 1)]
    return rows + [(7, "é", "copy of one row", "n", "s", 1)] * 150


def test_mix_against_a_plain_version(spark):
    rows = mixed_rows()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, source, text, *_ in rows:
        sizes[source] += size(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    docs = curriculum.sized(spark.createDataFrame(rows, DOCS).repartition(7))
    got = curriculum.mix(docs).collect()
    assert len(got) == len(rows) and {r.number for r in got} == set(range(len(rows)))
    assert {(r.doc_id, r.source, r.text) for r in got} == {(d, s, t) for d, s, t, *_ in rows}
    taken = Counter()
    for r in got:
        assert r.size == size(r.text) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert len(r.positions) <= 3 and all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        taken[r.source] += r.size * len(r.positions)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(size(t) for _, x, t, *_ in rows if x == s) / 2 + 1e-6, s
    again = sorted((str(r.doc_id), r.size, len(r.positions)) for r in curriculum.mix(docs.repartition(3)).collect())
    assert again == sorted((str(r.doc_id), r.size, len(r.positions)) for r in got)


def test_positions_follow_the_schedules(spark):
    """The share of words a source has up to a time is that of its schedule's integral."""
    docs = spark.createDataFrame([(d, s, 10, "own") for d in range(400) for s in "abc"], "doc_id long, source string, size long, position string")
    copies = curriculum.training_order(curriculum.mix(docs)).collect()
    at = [r.position for r in copies if r.position is not None]
    assert at == sorted(at) and [r.position for r in copies][len(at) :] == [None] * (len(copies) - len(at))
    whole = {"a": lambda t: 6 * t - t * t, "b": lambda t: t + t * t, "c": lambda t: t}
    for source, integral in whole.items():
        own = [r.position for r in copies if r.source == source and r.position is not None]
        for t in (0.2, 0.5, 0.9):
            assert sum(p <= t for p in own) / len(own) == pytest.approx(integral(t) / integral(1), abs=0.01)


def test_schedules_that_cannot_be_met(spark):
    docs = spark.createDataFrame([(1, "a", 10), (2, "b", 1), (3, "c", 0)], "doc_id long, source string, size long")
    never, always = ((0, 0), (1, 0)), ((0, 1), (1, 1))
    got = {r.source: r for r in curriculum.mix(docs, curriculum.cycled([never, always, always])).collect()}
    assert (got["a"].target, got["b"].target, got["c"].target) == (0, 3, 0)
    assert (len(got["a"].positions), len(got["b"].positions)) == (0, 3)
    assert curriculum.mix(docs.where("doc_id is null")).count() == 0
    with pytest.raises(ValueError, match="schedule"):
        curriculum.cycled([((0, 1), (0.5, 1))])


def test_running_sums_and_no_python(spark):
    rows = spark.createDataFrame([(k % 5, k, k) for k in range(500)], "a int, b int, x long")
    found = curriculum.running(rows, ["a", "b"], ["x"], Scratch(spark, "test-running"), "rows").collect()
    before = 0
    for n, r in enumerate(sorted(found, key=lambda r: (r.a, r.b))):
        assert (r.number, r.before_x) == (n, before)
        before += r.x
    plan = curriculum.op13_source_mix(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


# Hard negatives


def mined(rows, positives=5, negatives=10):
    """rows: (vec_id, label, vector)."""
    known = [(k, i, n, [math.floor(256 * x) for x in v]) for k, (i, n, v) in enumerate(rows) if n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    tie = lambda s, i, k: (-s, i is None, i or 0, k)
    out = []
    for k, i, n, v in known:
        if i is None or i % 100:
            continue
        scored = [(dot(v, w), j, m, o) for o, j, m, w in known if o != k]
        near = sorted((tie(s, j, o), s, j) for s, j, m, o in scored if m == n)[:positives]
        for _, p, j in near:
            fits = sorted((tie(s, x, o), s, x) for s, x, m, o in scored if m != n and 30 * p <= 100 * s <= 90 * p)[:negatives]
            out += [(i, j, rank, x, p, s) for rank, (_, s, x) in enumerate(fits, 1)]
    return out


def vectors(n, seed=5):
    """Clusters, a hot vector with a third of all rows, ties, nulls, odd components."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = []
    for k in range(n):
        v = centres[k % 6] + 0.1 * rng.normal(size=8) if k % 3 else np.full(8, 0.5)
        rows.append((k * 5, int(rng.integers(4)), [float(x) for x in np.float32(v)]))
    rows += [(None, 1, [0.5] * 8), (100, 1, [0.5] * 8), (100, 1, [0.5] * 8), (200, 2, [0.25]), (300, 3, []), (400, None, [0.1] * 8), (500, 1, None), (600, 1, [0.1, None]), (700, 1, [float("nan")] * 8), (800, 1, [float("inf")] * 8)]
    return rows


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    rows = vectors(600)
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "vec_id long, label int, embedding array<float>, number string, score int").repartition(5)
    for size in ((4096, 1 << 17), (50, 90)):
        found = hard_negatives.mine(hard_negatives.quantised(df), hard_negatives.F.col("vec_id") % 100 == 0, group_rows=size, lane_anchors=16)
        got = sorted(map(tuple, found.collect()), key=str)
        want = sorted(mined(rows), key=str)
        assert len(want) > 300 and got == want


def test_trees_cover_and_search_is_exact(monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    monkeypatch.setattr(hard_negatives, "FAN", 4)
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(12, 5)) * 40)[rng.integers(12, size=500)] + rng.integers(-3, 4, size=(500, 5)) * (rng.random((500, 1)) < 0.7)
    size = float(np.sqrt((x * x).sum(1).max()))
    tree = hard_negatives.Tree(x, size)
    leaves = [k for k, c in enumerate(tree.children) if not c]
    assert sorted(r for k in leaves for r in tree.rows[k]) == list(range(500))
    for k in leaves:
        far = np.sqrt(((tree.points[tree.rows[k]] - tree.points[tree.centre[k]]) ** 2).sum(1)).max()
        assert far <= tree.radius[k] + 1e-6
    labels, numbers = rng.integers(3, size=500), np.arange(500)
    q, q_labels, q_numbers = x[:40], labels[:40], numbers[:40]
    scores = (q @ x.T).astype(int)
    low, high = np.sort(rng.integers(-3000, 9000, size=(2, 40, 3)).astype(float), 0)
    for same in (True, False):
        found = hard_negatives.search(tree, labels, numbers, size, q, q_labels, q_numbers, low, high, 4, same)
        for a in range(40):
            for w in range(3):
                ok = [n for n in range(500) if (labels[n] == q_labels[a]) == same and (n != a or not same) and low[a, w] <= scores[a, n] <= high[a, w]]
                want = sorted(((scores[a, n], -n) for n in ok), reverse=True)[:4]
                got = [(int(key // 500), -int(499 - key % 500)) for key in found[a, w][::-1] if key != hard_negatives.NO_KEY]
                assert got == want


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(hard_negatives.quantised(none), hard_negatives.F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(100, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(hard_negatives.quantised(one), hard_negatives.F.col("vec_id") % 100 == 0).count() == 0

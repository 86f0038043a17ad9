"""All pairs by blocks against brute force, and what their plans move."""

import random

import pytest
from test_queries import SF

import __spark_entry__ as entry
from newsdesk.operators.allpairs import all_pairs


@pytest.mark.parametrize(("block", "heavy_weight", "high"), [(7, 1, None), (16, 1, 0.5), (4096, 1, 0.5), (7, 9000, 0.6)])
def test_against_brute_force(spark, block, heavy_weight, high):
    """Frequent and rare terms, terms twice, empty and single vectors, ids in no order, names or none; norms beyond single precision."""
    rng = random.Random(block + heavy_weight)
    words = ["all", *(f"often{k}" for k in range(3)), *(f"rare{k}" for k in range(60))]
    rows = []
    for k in range(61):
        terms = rng.choices(words, [20, *[9] * 3, *[1] * 60], k=rng.choice([0, 1, 4, 12]))
        rows.append((f"{k * 37 % 61:x}é", terms, [rng.choice((1, 3, heavy_weight)) for _ in terms], rng.sample(["Ana", "Bia", "Caio"], rng.randrange(3))))
    got = {(r.a, r.b): r.similarity for r in all_pairs(spark.createDataFrame(rows, "id string, terms array<string>, weights array<long>, entities array<string>"), 0.3, high, block).collect()}
    vectors = {i: {t: sum(w for u, w in zip(terms, weights, strict=True) if u == t) for t in terms} for i, terms, weights, _ in rows}
    names, want = {r[0]: set(r[3]) for r in rows}, {}
    for a in vectors:
        for b in vectors:
            dot = sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items())
            if a < b and dot:
                cosine = dot / (sum(w * w for w in vectors[a].values()) ** 0.5 * sum(w * w for w in vectors[b].values()) ** 0.5)
                if cosine >= 0.3 - 1e-12 and (high is None or cosine >= high or not names[a] or not names[b] or names[a] & names[b]):
                    want[a, b] = cosine
    assert len(want) > 50 and got == pytest.approx(want, abs=1e-12)


def test_nothing_to_pair(spark):
    assert all_pairs(spark.createDataFrame([("a", [], [])], "id string, terms array<string>, weights array<long>"), 0.3).collect() == []


@pytest.mark.parametrize("name", ["similar_pairs", "entity_guard"])
def test_no_pairs_are_shuffled(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan

"""Clustering of whole editions against plain definitions."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from newsdesk.functions import text
from newsdesk.operators import clusters, greedy
from newsdesk.operators import vectors as vectors_module
from newsdesk.operators.vectors import term_freq
from newsdesk.params import ClusterParams, Lexicon
from newsdesk.plans import queries

LEX = Lexicon()
SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2026, 5, 20, 12)
SCHEMA = "id string, title string, description string, published_at timestamp, feed_rank int, item_rank long"


def edition(spark, n=40, families=4, common=0):
    """Articles of several vocabularies, in turn, and `common` words that all have; their windows in two runs."""
    rng = random.Random(3)
    words = [[f"{'abcd'[f]}{k:02d}x" for k in range(12)] for f in range(families)]
    shared = [f"comum{k:02d}" for k in range(common)]
    rows = []
    for k in range(n):
        chosen = rng.sample(words[k % families], 5)
        names = " ".join(w.capitalize() + "nome" for w in rng.sample(words[k % families], k % 3))
        rows.append((f"{k:03d}", f"{' '.join(chosen)} {names}", " ".join(rng.sample(words[k % families], 4) + shared), NOW - dt.timedelta(minutes=7 * (k // 2)), 0, k))
    articles = spark.createDataFrame(rows, SCHEMA)
    return articles, clusters.windows_of(articles).where(F.col("edition_ts").isin(NOW, NOW + dt.timedelta(hours=4)))


def plain_greedy(rows, p):
    """(number of the cluster, rank in it) by id: newest first, each article compared with every cluster."""
    found, out = [], {}
    for r in sorted(rows, key=lambda r: (-r.published_at.timestamp(), r.feed_rank, r.item_rank)):
        own, names = dict(zip(r.terms, r.weights)), set(r.entities)
        best, most = None, p.threshold
        for c in found:
            dot = sum(w * c[0].get(t, 0) for t, w in own.items())
            cosine = dot / (sum(w * w for w in own.values()) ** 0.5 * sum(w * w for w in c[0].values()) ** 0.5)
            if dot and cosine >= most:
                best, most = c, cosine
        if best and most < p.high_cosine and names and best[1] and not names & best[1]:
            best = None
        if best is None:
            best = ({}, set(), [])
            found.append(best)
        for t, w in own.items():
            best[0][t] = best[0].get(t, 0) + w
        best[1].update(names)
        best[2].append(r.id)
        out[r.id] = (next(k for k, c in enumerate(found) if c is best), len(best[2]) - 1)
    return out


@pytest.mark.parametrize("n,common,most", [(40, 0, 30), (24, 2, 10)])
def test_large_editions_are_clustered_in_waves(spark, n, common, most):
    """Words that all articles share make each edition one connected part; waves, and waves cut short, give the plain result."""
    articles, windows = edition(spark, n, common=common)
    p = ClusterParams(max_group_rows=most)
    vectors = clusters.vectors_of(articles, LEX, p)
    rows = windows.join(vectors, "id").collect()
    want = {(at, i, *v) for at in {r.edition_ts for r in rows} for i, v in plain_greedy([r for r in rows if r.edition_ts == at], p).items()}
    got = clusters.cluster_greedy(articles, windows, LEX, p).collect()
    assert len(got) == len(want) == 2 * n and set(map(tuple, got)) == want and len({w[2] for w in want}) > 3
    if most == 30:
        assert set(map(tuple, clusters.cluster_greedy(articles, windows, LEX).collect())) == want


def test_groups_stay_within_the_bound(spark, monkeypatch):
    """Also where single articles reach more clusters than a group may hold: their most similar ones are enough."""
    sizes, settle = spark.sparkContext.accumulator(0), greedy._settle

    def watched(p):
        run = settle(p)

        def watch(pdf):
            assert len(pdf) <= p.max_group_rows
            sizes.add(1)
            return run(pdf)

        return watch

    monkeypatch.setattr(greedy, "_settle", watched)
    rows = [(f"s{k}", f"alfa beta gama w{k}x", f"v{k}x", NOW - dt.timedelta(minutes=k), 0, k) for k in range(5)]
    rows += [(f"t{k}", "alfa beta gama", f"w{k}x", NOW - dt.timedelta(hours=1, minutes=k), 0, k + 10) for k in range(2)]
    articles = spark.createDataFrame(rows, SCHEMA)
    windows = clusters.windows_of(articles).where(F.col("edition_ts") == F.lit(NOW))
    p = ClusterParams(max_group_rows=4, threshold=0.85)
    known = windows.join(clusters.vectors_of(articles, LEX, p), "id").collect()
    want = {(NOW, i, *v) for i, v in plain_greedy(known, p).items()}
    got = clusters.cluster_greedy(articles, windows, LEX, p).collect()
    assert set(map(tuple, got)) == want and sizes.value >= 4


def test_texts_stay_below_the_windows(spark):
    """What is exploded over editions has no text: the windows read ids and times alone."""
    articles, _ = edition(spark)
    plan = clusters.windows_of(articles)._jdf.queryExecution().optimizedPlan().toString()
    assert "title" not in plan.split("Generate")[1].split("\n")[0] and set(clusters.windows_of(articles).columns) == {"id", "published_at", "feed_rank", "item_rank", "edition_ts"}


@pytest.mark.parametrize("heavy,cell_pairs", [(32, 1 << 20), (3, 10), (64, 5)])
def test_cosine_join_against_all_pairs(spark, heavy, cell_pairs):
    """Heavy terms, split terms, pairs that share heavy terms alone, groups, and two different sides."""
    rng = random.Random(8)
    rows = []
    for g in ("x", "y"):
        for k in range(60):
            terms = {f"c{t}" for t in range(4) if rng.random() < 0.7} | {f"t{rng.randrange(25)}" for _ in range(rng.choice((0, 0, 2, 5)))}
            rows += [(g, f"{k:02d}", t, rng.choice((1, 1, 3, 7))) for t in terms]
    vectors = spark.createDataFrame(rows, "g string, id string, term string, weight long").cache()
    by = {}
    for g, i, t, w in rows:
        by.setdefault((g, i), {})[t] = w
    cosine = lambda u, v: sum(w * v.get(t, 0) for t, w in u.items()) / (sum(w * w for w in u.values()) * sum(w * w for w in v.values())) ** 0.5
    for threshold in (0.3, 0.8):
        want = {(g, i, j): cosine(u, by[h, j]) for (g, i), u in by.items() for h, j in by if g == h and i < j}
        want = {k: round(c, 9) for k, c in want.items() if c >= threshold - 1e-12}
        found = vectors_module.cosine_join(vectors, vectors, threshold, ("g",), heavy, cell_pairs).collect()
        assert {(r.g, r.a, r.b): round(r.similarity, 9) for r in found} == want and len(found) == len(want) > 20
    left, right = vectors.where("id < '20'"), vectors.where("id >= '20'")
    want = {(g, i, j) for (g, i), u in by.items() for h, j in by if g == h and i < "20" <= j and cosine(u, by[h, j]) >= 0.5 - 1e-12}
    found = vectors_module.cosine_join(left, right, 0.5, ("g",), heavy, cell_pairs).collect()
    assert {(r.g, r.a, r.b) for r in found} == want and len(found) == len(want) > 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_registered_components_match_union_find(spark):
    p = ClusterParams()
    rows = queries._windowed(spark, SF).select("edition_ts", "id", "title", "description").cache()
    articles = rows.select("id", "title", "description").dropDuplicates(["id"])
    vectors = {}
    for r in term_freq(articles, queries.LEXICON.stopwords, p.title_weight).collect():
        vectors.setdefault(r.id, {})[r.term] = r.weight
    names = {r.id: set(r.names) for r in articles.select("id", text.named_entities(F.col("title")).alias("names")).collect()}
    norm = {i: sum(w * w for w in v.values()) ** 0.5 for i, v in vectors.items()}
    linked = set()
    for a in vectors:
        for b in vectors:
            if a < b:
                cosine = sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items()) / (norm[a] * norm[b])
                apart = names[a] and names[b] and not names[a] & names[b]
                if cosine >= p.threshold - 1e-12 and (cosine >= p.high_cosine or not apart):
                    linked.add((a, b))
    editions, want = {}, set()
    for r in rows.collect():
        if r.id in vectors:
            editions.setdefault(r.edition_ts, set()).add(r.id)
    for at, ids in editions.items():
        root = {i: i for i in ids}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in linked:
            if a in ids and b in ids:
                one, other = sorted((find(a), find(b)))
                root[other] = one
        want |= {(at.strftime("%Y-%m-%d %H:%M:%S"), i, find(i)) for i in ids}
    got = entry.queries()["cluster_components"](spark, SF).collect()
    print(len(got), "rows,", len({(r[0], r[2]) for r in got}), "components,", len(linked), "links")
    assert len(got) == len(want) and set(map(tuple, got)) == want

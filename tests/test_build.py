"""Whole editions against a plain version on the smallest tables, and as a stream of batches."""

import datetime as dt
import hashlib
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsdesk.functions import text
from newsdesk.operators import articles as art
from newsdesk.operators.vectors import term_freq
from newsdesk.params import FALLBACK_WHY
from newsdesk.plans import adapter, archive_queries

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
PARAMS = archive_queries.PARAMS


def greedy(rows, vectors, names, p):
    """Newest first, each article joins the most similar cluster, compared with every one."""
    found = []
    for r in sorted(rows, key=lambda r: (-r.published_at.timestamp(), r.feed_rank, r.item_rank)):
        if r.id not in vectors:
            continue
        own, best, most = vectors[r.id], None, p.threshold
        for c in found:
            dot = sum(w * c["sum"].get(t, 0) for t, w in own.items())
            size = sum(w * w for w in own.values()) ** 0.5 * sum(w * w for w in c["sum"].values()) ** 0.5
            if dot > 0 and dot / size >= most:
                best, most = c, dot / size
        if best and most < p.high_cosine and names[r.id] and best["names"] and not names[r.id] & best["names"]:
            best = None
        if best is None:
            best = {"sum": defaultdict(float), "names": set(), "rows": []}
            found.append(best)
        for t, w in own.items():
            best["sum"][t] += w
        best["names"] |= names[r.id]
        best["rows"].append(r)
    return found


class Plain:
    """A whole run over collected articles, edition by edition; vectors and names come from the library's functions."""

    def __init__(self, articles, p=PARAMS):
        niche = art.filter_niche(articles, p.lexicon)
        self.p, self.rows = p, niche.withColumn("names", text.named_entities(F.col("title"))).collect()
        self.names = {r.id: set(r.names) for r in self.rows}
        self.vectors = defaultdict(dict)
        for r in term_freq(niche, p.lexicon.stopwords, p.cluster.title_weight).collect():
            self.vectors[r.id][r.term] = float(r.weight)

    def edition(self, at, cache, known=None):
        """{(section, rank): story} of a run, and the summaries that it generates. cache: slug to (cached_at, titulo, resumo, why, categoria)."""
        inside = [r for r in self.rows if at in clusters_of(r.published_at) and (known is None or r.id in known)]
        pool = []
        for seq, c in enumerate(greedy(inside, self.vectors, self.names, self.p.cluster)):
            age = max(0.0, (at - max(r.published_at for r in c["rows"])).total_seconds() / 3600)
            score = len({r.source for r in c["rows"]}) + 1.5 * 2.0 ** (-age / 10)
            pool.append((-round(score, 9), seq, c["rows"]))
        stories, asked, made = [], 0, {}
        for _, _, c in sorted(pool, key=lambda x: x[:2])[: self.p.rank.pool]:
            anchor = min(c, key=lambda r: (r.published_at, r.norm_url))
            n, cached = anchor.item_rank, cache.get(anchor.id)
            fresh = bool(cached) and cached[0] >= at - dt.timedelta(hours=24)
            asked += not fresh
            longest = max(enumerate(c), key=lambda x: (len(x[1].description), -x[0]))[1]
            said = (longest.title, longest.description or longest.title, FALLBACK_WHY, "Geral")
            if fresh:
                said = cached[1:]
            elif asked <= self.p.summary.budget and n % 3 and n % 4 != 1 and n % 7 != 1:
                said = made[anchor.id] = (anchor.title.strip(), (anchor.description or anchor.title).strip(), "motivo suficiente para importar", "Geral" if n % 5 == 0 else "Incêndio")
            elif cached:
                said = cached[1:]
            order = [anchor, *[r for r in c if r.id != anchor.id]]
            sources = {}
            for r in order:
                sources.setdefault(r.source, r.url)
            cluster = hashlib.sha1("|".join(sorted(r.id for r in c)).encode()).hexdigest()[:16]
            image = next((r.image_url for r in order if r.image_url), None)
            stories.append((anchor.id, cluster, *said, stamp(max(r.published_at for r in c)), "|".join(f"{s} {u}" for s, u in sources.items()), image))
        home, found = stories[:10], {}
        if home and not home[0][-1]:
            home.insert(0, home.pop(next((k for k, s in enumerate(home) if s[-1]), 0)))
        for section, listed in [("home", home), *[(name, [s for s in stories if s[5] == label]) for label, name in (("Geral", "geral"), ("Incêndio", "incendio"))]]:
            found |= {(section, k): s for k, s in enumerate(listed, 1)}
        return found, {slug: (at, *said) for slug, said in made.items()}


def shown(rows):
    """What a query gives, as {(edition_ts, section, rank): story}."""
    return {(r.edition_ts, r.section, r.story_rank): (r.slug, r.cluster_id, r.titulo, r.resumo, r.por_que_importa, r.categoria, r.updated_at, r.sources, r.image_url) for r in rows}


@tables
def test_editions_match_a_plain_build(spark):
    adapter.start()
    plain = Plain(adapter.firsts(spark, SF))
    cache = {}
    for r in adapter.firsts(spark, SF).collect():
        n = r.item_rank
        if n % 2 == 0 and n % 4 != 2 and n % 7 != 1:
            cache[r.id] = (r.published_at, r.title, r.description or r.title, "motivo suficiente para importar", "Geral" if n % 5 == 0 else "Incêndio")
    want = {}
    for at in {at for r in plain.rows for at in clusters_of(r.published_at)}:
        want |= {(stamp(at), *k): s for k, s in plain.edition(at, cache)[0].items()}
    got = archive_queries.edition_build(spark, SF).collect()
    assert len(got) > 500 and len(got) == len(want) and shown(got) == want and all(r.n_sources == len(r.sources.split("|")) for r in got)


def stamp(at):
    return dt.datetime.fromtimestamp(at.timestamp(), dt.UTC).strftime("%Y-%m-%d %H:%M:%S")


def clusters_of(at):
    step = 4 * 3600
    first = -(-(at.timestamp() - 3600) // step)
    last = (at.timestamp() + 48 * 3600) // step
    return [dt.datetime.fromtimestamp(k * step) for k in range(int(first), int(last) + 1)]

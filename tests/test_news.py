import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsdesk.operators import articles as art
from newsdesk.operators import catalog, clusters, editions, editorial, publish, ranking, summaries, topics
from newsdesk.params import ClusterParams, Lexicon, SummaryParams
from newsdesk.sources import archive, feeds
from newsdesk.streaming import ingest

NOW = dt.datetime(2026, 5, 20, 12)
LEX = Lexicon()


def hours(n):
    return NOW - dt.timedelta(hours=n)


def articles(spark, rows):
    """rows: (id, source, title, published_at)."""
    full = [(i, f"https://x.com/{i}", f"https://x.com/{i}", s, t, t, None, p, NOW, 0, k) for k, (i, s, t, p) in enumerate(rows)]
    return spark.createDataFrame(full, "id string, url string, norm_url string, source string, title string, description string, image_url string, published_at timestamp, fetched_at timestamp, feed_rank int, item_rank long")


def groups(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["cluster_seq"], set()).add(r["id"])
    return sorted(map(sorted, found.values()))


def item(spark, **given):
    fields = dict(feed_rank=0, item_rank=0, source="s", fetched_at=NOW, title=None, link=None, isoDate=None, pubDate=None, contentSnippet=None, content=None, summary=None, enclosure=None, mediaContent=None, mediaThumbnail=None)
    return spark.createDataFrame([tuple((fields | given).values())], feeds.ITEMS)


def test_items(spark):
    got = art.items_to_articles(item(spark, title="Título <b>X</b>", link="https://g1.globo.com/n/1", isoDate="2026-05-20T10:00:00.000Z", contentSnippet="Resumo do feed.")).first()
    assert (got.title, got.description, got.published_at) == ("Título X", "Resumo do feed.", dt.datetime(2026, 5, 20, 10))
    assert art.items_to_articles(item(spark, title="Só título")).count() == 0 and art.items_to_articles(item(spark, link="https://x.com/a")).count() == 0
    bad = art.items_to_articles(item(spark, title="T", link="https://x.com/a", pubDate="data-zoada", summary="")).first()
    assert bad.published_at == NOW and bad.description == ""


def test_image(spark):
    image = lambda **g: item(spark, **g).select(art.extract_image()).first()[0]
    assert image(mediaContent=[("https://img/x", "image", None)]) == "https://img/x"
    assert image(mediaContent=[("https://img/x.mp4", "video", None), ("https://img/y.JPG?w=1", None, None)], enclosure=("https://e.png", None)) == "https://img/y.JPG?w=1"
    assert image(enclosure=("https://e", "image/png")) == "https://e" and image(content='<IMG a src="h.gif">') == "h.gif" and image() is None
    assert image(mediaThumbnail=("t",), enclosure=("https://e", "image/png")) == "t"


def test_dedupe_keeps_first(spark):
    rows = articles(spark, [("a", "1", "x", NOW), ("a", "2", "y", NOW), ("b", "1", "z", NOW)])
    assert {r.id: r.title for r in art.dedupe_by_url(rows).collect()} == {"a": "x", "b": "z"}


@pytest.mark.parametrize(
    "title,kept",
    [
        ("Enchente atinge bairros de Porto Alegre", True), ("Acidente de percurso no debate", False), ("Acidente na BR-101 deixa dois mortos", True),
        ("Tragédia política em Brasília", False), ("Time vence campeonato", False), ("Corpo soterrado é achado", True), ("Incêndio sem feridos em galpão", True),
    ],
)
def test_niche(spark, title, kept):
    assert art.filter_niche(articles(spark, [("a", "s", title, NOW)]), LEX).count() == kept


def test_greedy_clusters(spark):
    rows = [
        ("a", "G1", "Enchente atinge bairros de Porto Alegre", hours(1)), ("b", "UOL", "Enchente atinge bairros em Porto Alegre", hours(2)), ("c", "G1", "Avião cai no interior paulista", hours(3)),
        ("old", "G1", "Enchente atinge bairros de Porto Alegre", hours(200)),
    ]
    at_now = lambda rows: clusters.windows_of(rows).where(F.col("edition_ts") == F.lit(NOW))
    known = articles(spark, rows)
    assert groups(clusters.cluster_greedy(known, at_now(known), LEX)) == [["a", "b"], ["c"]]
    other = [("x", "s", "Grave acidente entre trem deixa mortos na Bélgica", hours(1)), ("y", "s", "Grave acidente deixa mortos em Minas Gerais ônibus", hours(2))]
    known = articles(spark, other)
    assert groups(clusters.cluster_greedy(known, at_now(known), LEX, ClusterParams(high_cosine=0.9))) == [["x"], ["y"]]


def test_components_match_union(spark):
    from newsdesk.operators.graph import connected_components

    pairs = [("e", f"{k:03d}", f"{k + 1:03d}") for k in range(40)] + [("e", "x", "y"), ("f", "a", "b")]
    got = {(r.g, r.id): r.component for r in connected_components(spark.createDataFrame(pairs, "g string, a string, b string"), "g").collect()}
    assert {got["e", f"{k:03d}"] for k in range(41)} == {"000"} and got["e", "y"] == "x" and got["f", "b"] == "a"


def test_ranking(spark):
    rows = spark.createDataFrame([("now", 1, NOW), ("three", 3, hours(24)), ("ten", 1, hours(10)), ("none", 1, None)], "id string, source_count int, latest_at timestamp")
    got = {r.id: r.score for r in rows.withColumn("score", ranking.score(F.lit(NOW))).collect()}
    assert got["now"] == 2.5 and got["ten"] == 1.75 and got["none"] == 1.0 and got["three"] > got["now"]


def test_stories(spark):
    rows = articles(spark, [("new", "B", "n", hours(1)), ("old", "A", "o", hours(5)), ("same", "B", "s", hours(3))]).withColumn("k", F.lit(1))
    rows = rows.withColumn("member_rank", F.col("item_rank")).withColumn("image_url", F.when(F.col("id") == "same", "img"))
    anchor = clusters.cluster_anchor(rows, ("k",)).first()
    assert anchor.slug == "old"
    marked = rows.withColumn("is_anchor", F.col("id") == "old")
    assert [s.name for s in editions.story_sources(marked, ("k",)).first().sources] == ["A", "B"]
    assert editions.story_image(marked, ("k",)).first().image_url == "img"
    stats = clusters.cluster_stats(rows, ("k",)).first()
    assert stats.source_count == 2 and stats.latest_at == hours(1)


def test_sections_and_promotion(spark):
    rows = spark.createDataFrame([(1, "a", "Acidente aéreo", None, 1), (1, "b", "Enchente", None, 2), (1, "c", "Enchente", "img", 3)], "e int, slug string, categoria string, image_url string, rank int")
    rows = rows.withColumn("categoria_slug", F.regexp_replace(F.lower("categoria"), "\\W+", "-"))
    assert [r.slug for r in editions.promote_imaged(rows, "e").orderBy("rank").collect()] == ["c", "a", "b"]
    got = editions.sections(rows, "e").orderBy("section_rank", "story_rank").collect()
    assert [(r.section_rank, r.slug) for r in got] == [(1, "b"), (1, "c"), (2, "a")]


@pytest.mark.parametrize("word,at,bad", [("março", 5, True), ("janeiro", 5, True), ("maio", 5, False), ("abril", 5, False), ("julho", 5, False), ("dezembro", 1, False), ("março", 1, False), ("outubro", 1, True)])
def test_months(spark, word, at, bad):
    row = spark.createDataFrame([(f"em 24 de {word}", dt.datetime(2026, at, 10))], "t string, at timestamp")
    assert row.select(summaries.date_inconsistent(F.col("t"), F.col("at"))).first()[0] is bad
    assert row.select(summaries.date_inconsistent(F.col("t"), F.lit(None).cast("timestamp"))).first()[0] is False


def test_resolve(spark):
    why = "motivo suficiente para importar"
    pool = [("e", s, k, NOW, "flavio bolsonaro fala sobre chuva") for k, s in enumerate(("fresh", "stale", "made", "bad", "none"))]
    pool = spark.createDataFrame(pool, "edition_ts string, slug string, rank int, latest_at timestamp, corpus string")
    cache = spark.createDataFrame([("fresh", "Chuva", "r", why, "c", hours(6)), ("stale", "Chuva", "r", why, "c", hours(60))], "slug string, titulo string, resumo string, por_que_importa string, categoria string, cached_at timestamp")
    responses = spark.createDataFrame([("made", "Chuva Bolsonaro", "r", why, " "), ("bad", "Diz Flávio Marqueteiro", "r", why, "c")], "slug string, titulo string, resumo string, por_que_importa string, categoria string")
    fallback = pool.select("edition_ts", "slug", F.lit("f").alias("titulo"), F.lit("f").alias("resumo"), F.lit(why).alias("por_que_importa"), F.lit("Geral").alias("categoria"))
    got = summaries.resolve(pool, cache, responses, fallback, F.lit(NOW))
    found = {r.slug: r for r in got.collect()}
    assert {s: r.status for s, r in found.items()} == {"fresh": "fresh", "stale": "stale", "made": "generated", "bad": "fallback", "none": "fallback"}
    assert found["made"].categoria == "Geral"
    kept = {r.slug for r in summaries.next_cache(cache, got, F.lit(NOW)).collect()}
    assert kept == {"fresh", "stale", "made"}
    few = summaries.resolve(pool, cache, responses, fallback, F.lit(NOW), SummaryParams(budget=0))
    assert few.where("status = 'generated'").count() == 0


def test_parse_response(spark):
    row = spark.createDataFrame([('```json\n{"titulo": "x"}\n```',), ("nada",)], "t string")
    assert [r[0] and r[0].titulo for r in row.select(summaries.parse_response(F.col("t"), "titulo string")).collect()] == ["x", None]


def test_topics(spark):
    rows = [("1", "Super El Niño chega"), ("2", "alerta: Defesa Civil age"), ("3", "hoje a Defesa Civil"), ("4", "Governo do Brasil"), ("5", "chuva no Rio")]
    stories = spark.createDataFrame([(s, t, NOW, k) for k, (s, t) in enumerate(rows)], "slug string, titulo string, updated_at timestamp, story_rank int")
    bridge = topics.topic_stories(stories)
    assert {r.topic_slug for r in bridge.where("story_slug = '1'").collect()} == {"super-el-nino", "el-nino"}
    hubs = topics.build_topics(bridge).collect()
    assert [(h.slug, h.n_stories, h.indexable) for h in hubs] == [("defesa-civil", 2, False)]
    assert "rio" not in {r.topic_slug for r in bridge.collect()}


def test_catalog_and_related(spark):
    day = dt.date(2026, 5, 20)
    make = lambda slug, d, title, section="home", n=1: (slug, d, d == day, section, 0, n, title, "c", NOW)
    rows = spark.createDataFrame(
        [make("a", day - dt.timedelta(1), "velha"), make("a", day, "nova"), make("a", day, "secao", "c")] + [make(f"s{k}", day, "t", "c", k) for k in range(9)],
        "slug string, date date, is_current boolean, section string, section_rank int, story_rank int, titulo string, categoria_slug string, updated_at timestamp",
    )
    found = catalog.catalog(rows)
    assert found.where("slug = 'a'").first().titulo == "nova" and found.count() == 10
    near = catalog.related(found).collect()
    assert max(r["rank"] for r in near) == 6 and all(r.slug != r.related_slug for r in near) and len(near) == 60


def test_editorial(spark):
    long = "Uma frase analítica suficientemente longa sobre a chuva de hoje."
    rows = [("ok", "Panorama da chuva no Sul", long, [long, long, "x"]), ("name", "Panorama com Joaquim Nogueira", long, [long, long]), ("short", "Curto", long, [long]), ("few", "Panorama da chuva", long, [long]), ("old", "Panorama da chuva hoje", long, [long, long + " Em janeiro."])]
    df = spark.createDataFrame([(*r, "panorama chuva", NOW) for r in rows], "id string, titulo string, linha_fina string, paragrafos array<string>, corpus string, at timestamp")
    got = {r.id: r.reason for r in editorial.validate_editorial(df).collect()}
    assert got == {"ok": None, "name": "unknown names", "short": "title too short", "few": "too few paragraphs", "old": "incoherent date"}


def test_gates(spark):
    day = dt.date(2026, 6, 3)
    rows = spark.createDataFrame([(day, 12), (day, 4), (day - dt.timedelta(1), 13)], "date date, hour_utc int")
    sent = spark.createDataFrame([(day - dt.timedelta(1), NOW)], "date date, sent_at timestamp")
    assert {(str(r.date), r.hour_utc): r.send for r in publish.newsletter_gate(rows, sent).collect()} == {("2026-06-03", 12): True, ("2026-06-03", 4): False, ("2026-06-02", 13): False}
    assert publish.newsletter_gate(rows, sent, force=True).where("send").count() == 3


def test_sitemap(spark):
    now = dt.datetime(2026, 6, 2, 12)
    at = lambda h: now - dt.timedelta(hours=h)
    rows = spark.createDataFrame([("a", "A & <b>", at(1)), ("b", "B", at(47.5)), ("c", "C", at(49)), ("d", "D", None)], "slug string, titulo string, updated_at timestamp")
    none = spark.createDataFrame([], "date date, titulo string, generated_at timestamp")
    got = publish.news_sitemap(rows, none, F.lit(now)).orderBy("part", F.col("at").desc()).collect()
    assert [r.slug for r in got] == ["a", "b"] and "A &amp; &lt;b&gt;" in got[0].entry and "2026-06-02T11:00:00Z" in got[0].entry


def test_social(spark):
    row = spark.createDataFrame([("s", "Título é " + "x" * 400, "enchente-rio")], "slug string, titulo string, categoria_slug string")
    got = publish.social_text(row).first()
    assert got.tags == ["enchente", "brasil"] and len(got.bluesky) <= 300
    raw = got.bluesky.encode()
    assert [raw[f.byte_start : f.byte_end].decode() for f in got.facets] == ["#enchente", "#brasil"]


def test_archive_files(spark, tmp_path):
    story = '{"clusterId": "c1", "titulo": "T", "resumo": "R", "categoria": "Enchente", "categoriaSlug": "enchente", "sources": [{"name": "n", "url": "u"}], "updatedAt": "2026-05-20T10:00:00Z"}'
    (tmp_path / "a.json").write_text(f'{{"date": "2026-05-20", "generatedAt": "2026-05-20T12:00:00Z", "home": [{story}], "categorias": [{{"slug": "enchente", "label": "Enchente", "stories": [{story}]}}]}}')
    (tmp_path / "b.json").write_text(f'{{"date": "2026-05-19", "generatedAt": "2026-05-19T12:00:00Z", "home": [], "categorias": {{"enchente": [{story}]}}}}')
    (tmp_path / "c.json").write_text('{"date": "2026-05-18", "home": [')
    rows = archive.read_editions(spark, str(tmp_path))
    got = sorted((str(r.date), r.section, r.slug, r.section_label) for r in rows.collect())
    assert got == [("2026-05-19", "enchente", "c1", "Enchente"), ("2026-05-20", "enchente", "c1", "Enchente"), ("2026-05-20", "home", "c1", None)]
    out = str(tmp_path / "out")
    archive.write_editions(rows, out)
    archive.write_editions(rows.limit(0), out)
    assert {str(r.date) for r in spark.read.parquet(out).collect()} == {"2026-05-20"}
    assert '"clusterId":"c1"' in archive.edition_json(rows).where("date = '2026-05-20'").first().json
    assert archive.read_or_empty(spark, str(tmp_path / "none"), "slug string").count() == 0


def test_feed_files(spark, tmp_path):
    (tmp_path / "rss.xml").write_text(
        '<rss xmlns:media="m"><channel><item><title>Um</title><link>https://x.com/1</link><pubDate>Wed, 20 May 2026 10:00:00 GMT</pubDate><description>d</description>'
        '<media:content url="https://i/x.jpg" medium="image"/></item></channel></rss>'
    )
    sources = spark.createDataFrame([(3, "G1", "rss.xml")], "feed_rank int, name string, file_name string")
    items = feeds.with_sources(feeds.read_rss(spark, str(tmp_path / "rss.xml"), F.lit(NOW)), sources)
    got = art.items_to_articles(items).first()
    assert (got.source, got.feed_rank, got.title, got.image_url, got.published_at) == ("G1", 3, "Um", "https://i/x.jpg", dt.datetime(2026, 5, 20, 10))


def test_stream_equals_batch(spark, tmp_path):
    rows = item(spark, title="T", link="https://x.com/a", isoDate="2026-05-20T10:00:00Z").unionByName(item(spark, title="U", link="https://www.x.com/a/?ref=1", isoDate="2026-05-20T10:00:00Z"))
    rows = rows.unionByName(item(spark, title="F", link="https://x.com/f", isoDate="2026-05-20T18:00:00Z"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_articles(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.norm_url for r in spark.sql("select norm_url from arrived").collect()] == ["https://x.com/a"]


def test_scope_terms_across_texts(spark):
    """Terms that begin in one member's text and end in the next one's, or in the one after a short text, by member order."""
    import dataclasses
    import random

    lexicon = dataclasses.replace(LEX, damage=("casa caiu", "rio a b"), standalone=("x y z w", "fim de"))
    rng = random.Random(12)
    rows = [("c1", "Perto da casa", None, 1), ("c1", "Caiu a ponte", "", 2), ("c2", "Caiu a ponte", "", 1), ("c2", "Perto da casa", None, 2), ("c3", "X", "y", 1), ("c3", "z", "w", 2), ("c4", "no rio", None, 1), ("c4", "a", None, 2), ("c4", "b", "", 3)]
    rows += [(f"r{k}", rng.choice("x y z w fim de rio a b casa caiu".split()), rng.choice(("", "x y", "de", "a")), n) for k in range(60) for n in range(1, rng.randrange(2, 7))]
    flagged = art.with_niche_flags(spark.createDataFrame(rows, "k string, title string, description string, member_rank int"), lexicon)
    got = {r.k: (r.damage, r.standalone) for r in clusters.scope_flags(flagged, ("k",), lexicon).collect()}
    texts = {}
    for k, title, description, n in sorted(rows, key=lambda r: (r[0], r[3])):
        texts.setdefault(k, []).append(" ".join(x for x in (title, description) if x is not None).lower())
    want = {k: tuple(any(t in " ".join(said) for t in terms) for terms in (lexicon.damage, lexicon.standalone)) for k, said in texts.items()}
    assert got == want and got["c1"] == (True, False) and got["c2"] == (False, False) and got["c3"] == (False, True) and len(set(want.values())) == 3

"""Queries that write the driver's rows with the library's sinks, read them back with its sources, and build whole editions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.operators import articles as art
from newsdesk.operators import build, clusters, editions, publish, summaries
from newsdesk.params import Params, SummaryParams
from newsdesk.plans import adapter, twins
from newsdesk.plans.adapter import LEXICON
from newsdesk.plans.queries import _RESOLVED, SITE, _home, _resolved, joined, query, stamp
from newsdesk.shared import shared_dir
from newsdesk.sources import archive, feeds
from newsdesk.streaming import ingest, state


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"


# Sources and sinks



def _folder_value(c: F.Column) -> F.Column:
    """What a partition's folder stands for: escaped by Spark, then as part of a URI; null has a folder too."""
    plain = lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    return F.nullif(plain(plain(c)), F.lit("__HIVE_DEFAULT_PARTITION__"))


# XML readers drop white space at the ends of values and cannot hold control characters.
_PLAIN = "regexp_replace({}, '[^\\x20-\\x7E\\x{{A0}}-\\x{{D7FF}}]+', ' ', 'g')"


@query(
    f"""SELECT doc_id, regexp_extract(source, '([0-9]+)$', 1)::INT AS feed_rank, source, nullif(trim({_PLAIN.format("regexp_extract(text, '^[^.\n]*')")}), '') AS title, nullif(trim({_PLAIN.format('text')}), '') AS said,
  {twins.rfc1123('pub')} AS pub, CASE WHEN doc_id % 5 = 0 THEN 'https://img.example.com/e' || doc_id || '.png?w=1' END AS image FROM raw"""
)
def feed_items(spark, sf):
    """Items written as RSS files, one folder a source, and read back: the link says which item it is."""
    plain = lambda c: F.regexp_replace(c, r"[^\x20-\x7E\x{A0}-\x{D7FF}]+", " ")
    items = adapter.items_of(adapter.spread(adapter.documents(spark, sf)))
    rows = items.select(
        "source", plain(F.col("title")).alias("title"), F.concat(F.lit("https://news.example.com/"), F.col("item_rank").cast("string")).alias("link"), "pubDate", plain(F.col("contentSnippet")).alias("description"),
        F.when(F.col("enclosure").isNotNull(), F.struct(F.col("enclosure.url").alias("_url"), F.lit("image/png").alias("_type"))).alias("enclosure"),
    )
    at = _folder(spark)
    rows.write.format("xml").option("rootTag", "channel").option("rowTag", "item").partitionBy("source").save(at)
    found = feeds.read_rss(spark, f"{at}/*", F.current_timestamp())
    name = _folder_value(F.regexp_extract("file", r"source=([^/]+)/", 1))
    held = lambda c: F.nullif(F.regexp_replace(c, r"^\p{Zs}+|\p{Zs}+\z", ""), F.lit(""))  # noqa: E731  an empty element is no value
    return found.select(
        F.regexp_extract("link", r"(-?\d+)$", 1).cast("long").alias("doc_id"), F.regexp_extract(name, r"(\d+)$", 1).cast("int").alias("feed_rank"), name.alias("source"), held("title").alias("title"), held("contentSnippet").alias("said"),
        F.col("pubDate").alias("pub"), F.col("enclosure.url").alias("image"),
    )


_EDITION = "date, section, section_label, section_rank, story_rank, slug, cluster_id, titulo, resumo, categoria"


@query(f"SELECT date::VARCHAR AS date, section, section_label, section_rank::INT AS section_rank, story_rank::INT AS story_rank, slug, cluster_id, titulo, resumo, categoria, {twins.stamp('updated_at')} AS updated_at, source || ' ' || url AS sources FROM rows")
def edition_archive(spark, sf):
    """Editions as JSON files, one a day, read back as rows."""
    at = _folder(spark)
    archive.edition_json(adapter.edition_rows(spark, sf)).repartition("date").select("json", "date").write.partitionBy("date").text(at)
    rows = archive.read_editions(spark, f"{at}/*")
    said = F.transform("sources", lambda s: F.concat_ws(" ", s["name"], s["url"]))
    return rows.select(F.col("date").cast("string").alias("date"), *_EDITION.split(", ")[1:], stamp("updated_at").alias("updated_at"), joined(said).alias("sources"))


@query("SELECT date::VARCHAR AS date, section, story_rank, slug FROM rows WHERE day(date) % 4 <> 0")
def written_editions(spark, sf):
    """Editions in the partitioned archive, the days written twice; those that have lost their home are not written."""
    at = _folder(spark)
    rows = adapter.edition_rows(spark, sf).where("section != 'home' or dayofmonth(date) % 4 != 0")
    archive.write_editions(rows.where("dayofmonth(date) % 2 = 0").withColumn("titulo", F.lit("older")), at)
    archive.write_editions(rows, at)
    return spark.read.schema(rows.schema).parquet(at).where("titulo != 'older'").select(F.col("date").cast("string").alias("date"), "section", "story_rank", "slug")


@query("SELECT date::VARCHAR AS date, 'Panorama' AS titulo, max(titulo) FILTER (story_rank = 1) AS linha_fina, string_agg(resumo, '|' ORDER BY story_rank) AS paragrafos, string_agg(slug || ' ' || titulo, '|' ORDER BY story_rank) AS destaques FROM home GROUP BY date")
def editorial_archive(spark, sf):
    """Editorials made of each edition's home, as JSON files, read back."""
    at = _folder(spark)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("story_rank", c.alias("x")))), lambda s: s["x"])
    pieces = _home(spark, sf).groupBy(F.col("date").cast("string").alias("date")).agg(
        F.lit("Panorama").alias("titulo"), F.max(F.when(F.col("story_rank") == 1, F.col("titulo"))).alias("linhaFina"),
        listed(F.col("resumo")).alias("paragrafos"), listed(F.struct("slug", "titulo", "categoria")).alias("destaques"),
    )
    pieces.repartition("date").select(F.to_json(F.struct(*pieces.columns)).alias("json"), "date").write.partitionBy("date").text(at)
    said = F.transform("destaques", lambda s: F.concat_ws(" ", s["slug"], s["titulo"]))
    return archive.read_editorials(spark, f"{at}/*").select(F.col("date").cast("string").alias("date"), "titulo", "linha_fina", joined("paragrafos").alias("paragrafos"), joined(said).alias("destaques"))


@query(
    _RESOLVED + """, made AS (SELECT slug, titulo, resumo, por_que_importa, categoria, date::TIMESTAMP + INTERVAL 2 DAY AS cached_at FROM resolved WHERE status = 'generated')
SELECT slug, titulo, categoria, strftime(cached_at, '%Y-%m-%d %H:%M:%S') AS cached_at FROM made WHERE epoch(cached_at) >= (SELECT max(epoch(cached_at)) FROM made) - 3600 * 72
QUALIFY row_number() OVER (PARTITION BY slug ORDER BY cached_at DESC) = 1"""
)
def summary_state(spark, sf):
    """The state table of summaries: absent at first, written, read again, pruned at its newest entry."""
    at = _folder(spark)
    none = archive.read_or_empty(spark, at, ingest.CACHE)
    made = summaries.generated(_resolved(spark, sf), F.date_add("edition_ts", 2).cast("timestamp"))
    none.unionByName(made).write.parquet(at)
    cache = archive.read_or_empty(spark, at, ingest.CACHE)
    now = cache.agg(F.max("cached_at")).first()[0]  # one value
    kept = summaries.prune_cache(summaries.newest(cache), F.lit(now), SummaryParams().prune_hours)
    return kept.select("slug", "titulo", "categoria", stamp("cached_at").alias("cached_at"))


# Stories


@query(
    _RESOLVED + f""", per AS (SELECT date, bucket, source, arg_min(url, (CASE WHEN is_anchor THEN 0 ELSE 1000000 END) + member_rank) AS url, min((CASE WHEN is_anchor THEN 0 ELSE 1000000 END) + member_rank) AS o FROM members GROUP BY ALL
), src AS (SELECT date, bucket, string_agg(source || ' ' || url, '|' ORDER BY o) AS sources FROM per GROUP BY ALL
), img AS (SELECT date, bucket, arg_min(image_url, (CASE WHEN is_anchor THEN 0 ELSE 1000000 END) + member_rank) FILTER (image_url IS NOT NULL) AS image_url FROM members GROUP BY ALL
), ids AS (SELECT date, bucket, substr(sha1(string_agg(id, '|' ORDER BY id)), 1, 16) AS cluster_id, max(published_at) AS latest_at FROM members GROUP BY ALL)
SELECT r.date::VARCHAR AS date, r.slug, cluster_id, r.titulo, r.categoria, {twins.category_slug('r.categoria')} AS categoria_slug, sources, image_url, {twins.stamp('ids.latest_at')} AS updated_at
FROM resolved r JOIN pool p ON p.date = r.date AND p.slug = r.slug JOIN src ON src.date = p.date AND src.bucket = p.bucket JOIN img ON img.date = p.date AND img.bucket = p.bucket JOIN ids ON ids.date = p.date AND ids.bucket = p.bucket"""
)
def stories(spark, sf):
    """Story rows of clusters with their resolved summaries."""
    rows = adapter.members(spark, sf).withColumn("edition_ts", F.col("date").cast("timestamp"))
    keys = ("edition_ts", "slug")
    rows = rows.join(rows.where("is_anchor").select("edition_ts", "bucket", F.col("id").alias("slug")), ["edition_ts", "bucket"])
    found = editions.to_stories(_resolved(spark, sf), clusters.cluster_stats(rows, keys), editions.story_sources(rows, keys), editions.story_image(rows, keys))
    said = F.transform("sources", lambda s: F.concat_ws(" ", s["name"], s["url"]))
    return found.select(F.date_format("edition_ts", "yyyy-MM-dd").alias("date"), "slug", "cluster_id", "titulo", "categoria", "categoria_slug", joined(said).alias("sources"), "image_url", stamp("updated_at").alias("updated_at"))


@query(
    f"""SELECT 'editorial' AS kind, date::VARCHAR AS key, 'Article' AS type, '{SITE.url}/editorial/' || date || '/' AS url, 'Panorama de ' || date AS name, string_agg(resumo, chr(10) || chr(10) ORDER BY story_rank) AS body FROM home GROUP BY date
UNION ALL SELECT 'list', date::VARCHAR, 'ItemList', '{SITE.url}/edicao/' || date || '/', count(*)::VARCHAR, string_agg(story_rank || ' ' || titulo || ' ' || url, '|' ORDER BY story_rank) FROM home GROUP BY date
UNION ALL SELECT 'site', '', 'WebSite', '{SITE.url}', '{SITE.name}', '{SITE.description}'"""
)
def json_ld_pages(spark, sf):
    """Structured data of editorials, lists and the site, read back with the JSON functions."""
    home = _home(spark, sf)
    get = lambda path: F.get_json_object("json", path)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("story_rank", "resumo"))), lambda s: s["resumo"])
    pieces = home.groupBy("date").agg(listed.alias("paragrafos"), F.max("updated_at").alias("generated_at"))
    pieces = pieces.withColumn("titulo", F.concat(F.lit("Panorama de "), F.col("date").cast("string"))).withColumn("linha_fina", F.lit("Linha fina"))
    one = publish.editorial_json_ld(pieces, SITE).select(F.lit("editorial").alias("kind"), F.col("date").cast("string").alias("key"), get("$['@type']").alias("type"), get("$.url").alias("url"), get("$.headline").alias("name"), get("$.articleBody").alias("body"))
    page = F.concat(F.lit(f"{SITE.url}/edicao/"), F.col("date").cast("string"), F.lit("/"))
    items = F.from_json(get("$.itemListElement"), "array<struct<position:int,name:string,url:string>>")
    said = joined(F.transform(items, lambda x: F.concat_ws(" ", x["position"].cast("string"), x["name"], x["url"])))
    lists = publish.item_list_json_ld(home, "date", page).select(F.lit("list").alias("kind"), F.col("date").cast("string").alias("key"), get("$['@type']").alias("type"), get("$.url").alias("url"), get("$.numberOfItems").alias("name"), said.alias("body"))
    site = publish.website_json_ld(spark, SITE).select(F.lit("site").alias("kind"), F.lit("").alias("key"), get("$['@type']").alias("type"), get("$.url").alias("url"), get("$.name").alias("name"), get("$.description").alias("body"))
    return one.unionByName(lists).unionByName(site)


# Whole runs

PARAMS = Params(lexicon=LEXICON)


def _answers(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A cache and responses for any article that may be an anchor: some missing, some with an invented name or a short reason."""
    n = F.col("item_rank")
    why = F.when(n % 7 == 1, "curto").otherwise("motivo suficiente para importar")
    made = lambda k: articles.select(F.col("id").alias("slug"), F.concat("title", F.when(n % 4 == k, " Joaquim Nogueira").otherwise("")).alias("titulo"), F.coalesce(F.nullif("description", F.lit("")), "title").alias("resumo"), why.alias("por_que_importa"), F.when(n % 5 == 0, "Geral").otherwise("Incêndio").alias("categoria"), "published_at", n.alias("n"))
    cache = made(2).where("n % 2 = 0").withColumn("cached_at", F.col("published_at")).drop("published_at", "n")
    return cache, made(1).where("n % 3 != 0").drop("published_at", "n")


def _shown(rows: DataFrame) -> DataFrame:
    sources = F.array_join(F.transform("sources", lambda s: F.concat_ws(" ", s["name"], s["url"])), "|")
    return rows.select(
        stamp("edition_ts").alias("edition_ts"), "section", "section_rank", "story_rank", "slug", "cluster_id", "titulo", "resumo", "por_que_importa", "categoria",
        stamp("updated_at").alias("updated_at"), F.size("sources").alias("n_sources"), sources.alias("sources"), "image_url",
    )


@query()
def edition_build(spark, sf):
    """Items to editions at every run instant: filter, greedy clusters, ranking, summaries, scope gate, stories, sections."""
    articles = adapter.firsts(spark, sf)
    return _shown(build.build(articles, *_answers(articles), PARAMS).rows)


@query()
def stream_editions(spark, sf):
    """The same as a stream of documents that ends with what is there: each day's last edition, from the archive."""
    at = _folder(spark)
    docs = spark.readStream.schema(adapter.table(spark, sf, "documents").schema).parquet(f"{sf}/documents.parquet*")  # a file or a folder
    items = adapter.items_of(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source"))
    builder = ingest.edition_builder(f"{at}/articles", f"{at}/editions", f"{at}/state", lambda rows: _answers(rows)[1], PARAMS)
    ingest.start_editions(ingest.stream_articles(items), builder, f"{at}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{at}/editions")
    return _shown(rows)


@query("SELECT DISTINCT id FROM articles WHERE item_rank % 19 <> 3")
def stream_timely(spark, sf):
    """A stream in which every nineteenth document is dated two hours after it was fetched: these go before the watermark sees them."""
    docs = spark.readStream.schema(adapter.table(spark, sf, "documents").schema).parquet(f"{sf}/documents.parquet*")
    items = adapter.items_of(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source"))
    early = F.col("item_rank") % 19 == 3
    ahead = F.date_format(F.timestamp_seconds(F.col("fetched_at").cast("long") + 7200), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    found = ingest.stream_articles(items.withColumn("isoDate", F.when(early, ahead).otherwise(F.col("isoDate")))).select("id", "published_at")
    at = _folder(spark)
    found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{at}/out").select("id")


_CLOSED = "generate_series((floor(epoch(published_at) / 14400) - 11)::BIGINT, floor(epoch(published_at) / 14400)::BIGINT)"


@query(
    f"""SELECT strftime(make_timestamp(w * 14400000000), '%Y-%m-%d %H:%M:%S') AS window_start, source, count(*) AS n
FROM (SELECT source, unnest({_CLOSED}) AS w FROM articles) WHERE w * 14400 + 48 * 3600 <= (SELECT max(epoch(published_at)) FROM articles) - 6 * 3600 GROUP BY ALL"""
)
def stream_volume(spark, sf):
    """Volumes of a stream of documents that ends with what is there: the windows that the watermark has closed."""
    docs = spark.readStream.schema(adapter.table(spark, sf, "documents").schema).parquet(f"{sf}/documents.parquet*")
    items = adapter.items_of(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source"))
    found, at = state.volume_stream(art.items_to_articles(items), "6 hours"), _folder(spark)
    state.run_stream(found, f"{at}/out", f"{at}/state")
    return spark.read.schema(found.schema).parquet(f"{at}/out").select(stamp("window_start").alias("window_start"), "source", "n")


_MADE = "SELECT 's' || (CASE WHEN doc_id % 3 = 0 THEN doc_id + 10000000 ELSE doc_id % 700 END) AS slug, substr(text, 1, 80) AS titulo, make_timestamp((1704067200 + doc_id * 300) * 1000000) AS cached_at FROM documents WHERE doc_id IS NOT NULL"


@query(
    f"""WITH made AS ({_MADE}), newest AS (SELECT slug, max(struct_pack(at := cached_at, titulo := titulo)) AS x FROM made GROUP BY slug)
SELECT slug, x.titulo AS titulo, strftime(x.at, '%Y-%m-%d %H:%M:%S') AS cached_at FROM newest WHERE x.at >= (SELECT max(cached_at) FROM made) - INTERVAL 72 HOUR""",
    chain=False,
)
def stream_summaries(spark, sf):
    """Summaries made of a stream of documents: what its state holds in the end, three days of them."""
    docs = spark.readStream.schema(adapter.table(spark, sf, "documents").schema).parquet(f"{sf}/documents.parquet*").where("doc_id is not null")
    d = F.col("doc_id")
    slug = F.concat(F.lit("s"), F.when(d % 3 == 0, d + 10000000).otherwise(d % 700).cast("string"))
    made = docs.select(slug.alias("slug"), F.substring("text", 1, 80).alias("titulo"), *[F.lit(x).alias(c) for c, x in (("resumo", "r"), ("por_que_importa", "p"), ("categoria", "c"))], F.timestamp_seconds(F.lit(adapter.START) + d * 300).alias("cached_at"))
    at = _folder(spark)
    state.run_stream(state.keep_summaries(made), f"{at}/changes", f"{at}/state")
    return state.summaries_in_state(spark, f"{at}/state").select("slug", "titulo", stamp("cached_at").alias("cached_at"))

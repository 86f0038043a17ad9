"""What an archive publishes: sitemap, RSS, structured data, routes, newsletter, social posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk.functions import dates, text
from newsdesk.params import Site


def recent_news(stories: DataFrame, now: Column, hours: int = 48, most: int = 1000) -> DataFrame:
    """Stories updated in the last `hours`, newest first, at most `most`: a top-k, not a full sort."""
    rows = stories.where(F.col("updated_at").cast("double") >= now.cast("double") - 3600 * hours)
    return rows.orderBy(F.col("updated_at").desc(), "slug").limit(most)


def recent_editorials(editorials: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    rows = editorials.where(F.col("generated_at").cast("double") >= now.cast("double") - 3600 * hours)
    return rows.orderBy(F.col("generated_at").desc())


def sitemap_entry(loc: Column, title: Column, at: Column, site: Site = Site()) -> Column:
    """One <url> element of a news sitemap."""
    return F.concat(
        F.lit("<url><loc>"), text.xml_escape(loc),
        F.lit(f"</loc><news:news><news:publication><news:name>{site.name}</news:name><news:language>pt</news:language></news:publication><news:publication_date>"),
        dates.w3c(at), F.lit("</news:publication_date><news:title>"), text.xml_escape(title), F.lit("</news:title></news:news></url>"),
    )


def news_sitemap(stories: DataFrame, editorials: DataFrame, now: Column, site: Site = Site()) -> DataFrame:
    """(part, at, slug, entry): stories, then editorials, of the last 48 hours."""
    one = recent_news(stories, now).select(
        F.lit(0).alias("part"), F.col("updated_at").alias("at"), "slug", sitemap_entry(F.concat(F.lit(f"{site.url}/noticia/"), "slug", F.lit("/")), F.col("titulo"), F.col("updated_at"), site).alias("entry")
    )
    day = F.col("date").cast("string")
    other = recent_editorials(editorials, now).select(
        F.lit(1).alias("part"), F.col("generated_at").alias("at"), day.alias("slug"), sitemap_entry(F.concat(F.lit(f"{site.url}/editorial/"), day, F.lit("/")), F.col("titulo"), F.col("generated_at"), site).alias("entry")
    )
    return one.unionByName(other)


def rss_items(home: DataFrame, site: Site = Site()) -> DataFrame:
    """(date, story_rank, item): an RSS item for each home story."""
    names = F.array_join(F.transform("sources", lambda s: s["name"]), ", ")
    why = text.blank_to_null(F.coalesce("por_que_importa", F.lit("")))
    said = F.concat("resumo", F.coalesce(F.concat(F.lit(" Por que importa: "), why), F.lit("")), F.lit(" (Fontes: "), names, F.lit(")"))
    link = F.concat(F.lit(f"{site.url}/edicao/"), F.col("date").cast("string"), F.lit("/"))
    item = F.concat(
        F.lit("<item><title>"), text.xml_escape(F.col("titulo")), F.lit("</title><link>"), text.xml_escape(link), F.lit("#"), "cluster_id",
        F.lit('</link><guid isPermaLink="false">'), "cluster_id", F.lit("</guid><description>"), text.xml_escape(said),
        F.lit("</description><pubDate>"), dates.rfc1123(F.col("updated_at")), F.lit("</pubDate></item>"),
    )
    return home.select("date", "story_rank", item.alias("item"))


def _organization(site: Site) -> list[Column]:
    return [F.lit("Organization").alias("@type"), F.lit(site.name).alias("name"), F.lit(site.url).alias("url")]


def website_json_ld(spark, site: Site = Site()) -> DataFrame:
    row = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("WebSite").alias("@type"), F.lit(site.name).alias("name"), F.lit(site.description).alias("description"), F.lit(site.url).alias("url"))
    return spark.range(1).select(F.to_json(row).alias("json"))


def news_article_json_ld(stories: DataFrame, site: Site = Site()) -> DataFrame:
    """(slug, json): NewsArticle; absent values leave their keys out."""
    page, at = F.concat(F.lit(f"{site.url}/noticia/"), "slug", F.lit("/")), dates.w3c(F.col("updated_at"))
    row = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("NewsArticle").alias("@type"), F.substring("titulo", 1, 110).alias("headline"),
        F.col("resumo").alias("description"), F.lit("pt-BR").alias("inLanguage"), at.alias("datePublished"), at.alias("dateModified"),
        text.blank_to_null(F.col("categoria")).alias("articleSection"), F.when(F.col("image_url").isNotNull(), F.array("image_url")).alias("image"), page.alias("url"),
        F.struct(F.lit("WebPage").alias("@type"), page.alias("@id")).alias("mainEntityOfPage"), F.struct(*_organization(site)).alias("author"),
        F.struct(*_organization(site), F.struct(F.lit("ImageObject").alias("@type"), F.lit(f"{site.url}/logo.png").alias("url")).alias("logo")).alias("publisher"),
        F.transform("sources", lambda s: F.struct(F.lit("CreativeWork").alias("@type"), s["name"].alias("name"), s["url"].alias("url"))).alias("citation"),
        F.transform("sources", lambda s: s["url"]).alias("isBasedOn"),
    )
    return stories.select("slug", F.to_json(row).alias("json"))


def editorial_json_ld(editorials: DataFrame, site: Site = Site()) -> DataFrame:
    """(date, json): Article with its whole body."""
    page, at = F.concat(F.lit(f"{site.url}/editorial/"), F.col("date").cast("string"), F.lit("/")), dates.w3c(F.col("generated_at"))
    row = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Article").alias("@type"), F.substring("titulo", 1, 110).alias("headline"), F.col("linha_fina").alias("description"),
        F.array_join("paragrafos", "\n\n").alias("articleBody"), F.lit("pt-BR").alias("inLanguage"), at.alias("datePublished"), at.alias("dateModified"),
        F.lit("Editorial").alias("articleSection"), page.alias("url"), F.struct(F.lit("WebPage").alias("@type"), page.alias("@id")).alias("mainEntityOfPage"),
        F.struct(*_organization(site)).alias("author"), F.struct(*_organization(site)).alias("publisher"),
    )
    return editorials.select("date", F.to_json(row).alias("json"))


def item_list_json_ld(lists: DataFrame, key: str, page: Column) -> DataFrame:
    """(key, json): ItemList of each list's stories (key, story_rank, titulo, sources), in order."""
    item = F.struct(F.col("story_rank").alias("position"), F.col("titulo").alias("name"), F.coalesce(F.get(F.col("sources"), F.lit(0))["url"], page).alias("url"))
    listed = F.transform(
        F.array_sort(F.collect_list(item)),
        lambda x: F.struct(F.lit("ListItem").alias("@type"), x["position"].alias("position"), x["name"].alias("name"), x["url"].alias("url")),
    )
    rows = lists.groupBy(key).agg(listed.alias("items"))
    row = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("ItemList").alias("@type"), page.alias("url"), F.size("items").alias("numberOfItems"), F.col("items").alias("itemListElement"))
    return rows.select(key, F.to_json(row).alias("json"))


def breadcrumb_json_ld(stories: DataFrame, site: Site = Site()) -> DataFrame:
    """(slug, json): home, category, story."""
    crumb = lambda n, name, url: F.struct(F.lit("ListItem").alias("@type"), F.lit(n).alias("position"), name.alias("name"), url.alias("item"))
    items = F.array(
        crumb(1, F.lit(site.name), F.lit(f"{site.url}/")),
        crumb(2, F.col("categoria"), F.concat(F.lit(f"{site.url}/"), "categoria_slug", F.lit("/"))),
        crumb(3, F.col("titulo"), F.concat(F.lit(f"{site.url}/noticia/"), "slug", F.lit("/"))),
    )
    row = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), items.alias("itemListElement"))
    return stories.select("slug", F.to_json(row).alias("json"))


def url_inventory(categories: DataFrame, stories: DataFrame, topics: DataFrame, editions: DataFrame, editorials: DataFrame, site: Site = Site()) -> DataFrame:
    """(kind, loc, description, noindex) of every page."""
    row = lambda df, kind, path, said, noindex=F.lit(False): df.select(F.lit(kind).alias("kind"), F.concat(F.lit(f"{site.url}/"), path).alias("loc"), said.alias("description"), noindex.alias("noindex"))
    day = F.col("date").cast("string")
    parts = [
        row(categories, "category", F.concat("categoria_slug", F.lit("/")), F.substring(F.concat(F.lit("Notícias de "), "label"), 1, 160)),
        row(stories, "story", F.concat(F.lit("noticia/"), "slug", F.lit("/")), F.substring("resumo", 1, 200)),
        row(topics, "topic", F.concat(F.lit("tema/"), "slug", F.lit("/")), F.substring(F.concat(F.lit("Tudo sobre "), "label"), 1, 160), ~F.col("indexable")),
        row(editions.select("date").distinct(), "edition", F.concat(F.lit("edicao/"), day, F.lit("/")), F.concat(F.lit("Edição de "), dates.date_label(day))),
        row(editorials, "editorial", F.concat(F.lit("editorial/"), day, F.lit("/")), F.substring("linha_fina", 1, 200)),
        row(categories.sparkSession.range(1), "home", F.lit(""), F.lit(site.description)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compose_email(home: DataFrame, site: Site = Site(), most: int = 8) -> DataFrame:
    """(date, subject, body): a Markdown digest of each edition's first home stories; an edition without any has none."""
    said = text.blank_to_null(F.coalesce(text.blank_to_null(F.coalesce("por_que_importa", F.lit(""))), F.col("resumo"), F.lit("")))
    category = F.coalesce(F.concat(F.lit("**"), text.blank_to_null(F.col("categoria")), F.lit("** · ")), F.lit(""))
    block = F.concat(
        F.lit("---\n\n## "), "titulo", F.lit("\n\n"), F.coalesce(F.concat(said, F.lit("\n\n")), F.lit("")), category,
        F.lit(f"[Ler mais]({site.url}/noticia/"), "slug", F.lit("/)\n"),
    )
    rows = home.where(F.col("story_rank") <= most).select("date", "story_rank", block.alias("block"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("story_rank", "block"))), lambda x: x["block"]), "\n")
    label = dates.date_label(F.col("date").cast("string"))
    body = F.concat(F.lit("Os destaques de "), label, F.lit(f" — {site.tagline}.\n\n"), F.col("blocks"), F.lit(f"\n---\n\n[Ver todas as notícias em {site.name}]({site.url}/)"))
    return rows.groupBy("date").agg(joined.alias("blocks")).select("date", F.concat(F.lit(f"{site.name} · "), label).alias("subject"), body.alias("body"))


def newsletter_gate(editions: DataFrame, sent: DataFrame, hour_from: int = 12, force: bool = False) -> DataFrame:
    """(date, hour_utc, send, reason) for editions (date, hour_utc); sent: log of (date, sent_at)."""
    last = sent.agg(F.max_by("date", "sent_at").alias("last"))
    rows = editions.join(F.broadcast(last))  # one row
    reason = F.when(F.lit(force), "forced").when(F.coalesce(F.col("last") == F.col("date"), F.lit(False)), "already sent").when(F.col("hour_utc") < hour_from, "too early").otherwise("due")
    return rows.select("date", "hour_utc", reason.isin("forced", "due").alias("send"), reason.alias("reason"))


def next_post(home: DataFrame, posted: DataFrame, key: str = "date") -> DataFrame:
    """The first home story of each edition that isn't in the posted log."""
    rows = home.join(posted.select("slug").distinct(), "slug", "left_anti")
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), "story_rank").alias("row")).select(key, "row.*")


def hashtags(category_slug: Column, common: str = "brasil", least: int = 3) -> Column:
    first = F.get(F.split(F.coalesce(category_slug, F.lit("")), "-"), F.lit(0))
    own = (F.char_length(first) >= least) & (first != common)
    return F.when(own, F.array(first, F.lit(common))).otherwise(F.array(F.lit(common)))


def social_text(stories: DataFrame, site: Site = Site()) -> DataFrame:
    """(slug, tags, bluesky, facets, mastodon): post texts; a facet is a tag's byte range in the first."""
    tags = hashtags(F.col("categoria_slug"))
    line = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " ")
    rows = stories.select("slug", "titulo", tags.alias("tags"), line.alias("line"))
    post = F.concat(text.clip(F.col("titulo"), F.lit(295) - F.char_length("line")), F.lit("\n\n"), F.col("line"))
    page = F.concat(F.lit(f"{site.url}/noticia/"), "slug", F.lit("/"))
    toot = F.concat(text.clip(F.col("titulo"), 380), F.lit("\n\n"), page, F.lit("\n\n"), F.col("line"))
    rows = rows.withColumn("bluesky", post).withColumn("mastodon", toot)

    def facet(acc: Column, t: Column) -> Column:
        """The next tag is looked for behind the one before."""
        needle = F.concat(F.lit("#"), t)
        at = F.position(needle, F.col("bluesky"), acc["next"])
        start = F.octet_length(F.substring(F.col("bluesky"), F.lit(1), at - 1))
        found = F.struct(start.alias("byte_start"), (start + F.octet_length(needle)).alias("byte_end"), t.alias("tag"))
        return F.struct((at + F.char_length(needle)).alias("next"), F.concat(acc["out"], F.array(found)).alias("out"))

    empty = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<byte_start:int,byte_end:int,tag:string>>").alias("out"))
    facets = F.aggregate("tags", empty, facet, lambda acc: acc["out"])
    return rows.select("slug", "tags", "bluesky", facets.alias("facets"), "mastodon")


def keep_last(log: DataFrame, most: int, *order: str) -> DataFrame:
    """The newest `most` rows of a log."""
    return log.orderBy(*[F.col(c).desc() for c in order]).limit(most)

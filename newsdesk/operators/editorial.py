"""Editorials: material, checks of what a model wrote, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk.functions import text
from newsdesk.operators.summaries import date_inconsistent
from newsdesk.params import FALLBACK_CATEGORY, Lexicon


def category_distribution(rows: DataFrame, key: str = "date") -> DataFrame:
    """(key, distribution): `label (n), ...` of an edition's sections in order."""
    per = rows.where("section != 'home'").groupBy(key, "section").agg(F.first("section_label").alias("label"), F.first("section_rank").alias("at"), F.count("*").alias("n"))
    said = F.concat("label", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    listed = F.array_sort(F.collect_list(F.struct("at", said.alias("said"))))
    return per.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["said"]), ", ").alias("distribution"))


def is_common(entity: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """A term that names nobody: generic, the plural of a generic term, or with a digit."""
    words = (*lexicon.generic, *lexicon.editorial_generic)
    return entity.isin(*words) | entity.rlike(r"\d") | (entity.endswith("s") & F.regexp_replace(entity, "s$", "").isin(*words))


def unknown_entities(texts: Column, folded_corpus: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Distinct names in the texts that neither the corpus holds nor are common terms."""
    named = F.array_distinct(F.flatten(F.transform(texts, text.named_entities)))
    # as a variable of its own: an expression would be moved into the inner function and folded again for each name
    return F.get(F.transform(F.array(folded_corpus), lambda corpus: F.filter(named, lambda e: ~is_common(e, lexicon) & ~F.contains(corpus, e))), F.lit(0))


def validate_editorial(rows: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Adds ok and reason, the texts trimmed and the paragraphs that count (40 characters at least, the first six).

    rows: (titulo, linha_fina, paragrafos, corpus, at), `at` being the instant that months are judged by.
    """
    paragraphs = F.filter(F.transform(F.coalesce("paragrafos", F.array().cast("array<string>")), lambda p: text.trim(F.coalesce(p, F.lit("")))), lambda p: F.char_length(p) >= 40)
    clean = rows.withColumns({"titulo": text.trim(F.coalesce("titulo", F.lit(""))), "linha_fina": text.trim(F.coalesce("linha_fina", F.lit(""))), "_all": paragraphs})
    clean = clean.withColumn("paragrafos", F.slice("_all", 1, 6))
    unknown = unknown_entities(F.concat(F.array("titulo"), F.col("paragrafos")), F.col("corpus"), lexicon)
    words = F.concat_ws(" ", F.col("titulo"), F.array_join("paragrafos", " "), F.col("linha_fina"))
    reason = (
        F.when(F.char_length("titulo") < 12, "title too short")
        .when(F.char_length("linha_fina") < 15, "standfirst too short")
        .when(F.size("_all") < 2, "too few paragraphs")
        .when(F.size(unknown) > 0, "unknown names")
        .when(date_inconsistent(words, F.col("at")), "incoherent date")
    )
    return clean.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).drop("_all")


def validate_intro(rows: DataFrame, most_unknown: int = 4, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Adds ok and reason; `intro` squeezed and cut at 600 characters to a whole word. rows: (intro, corpus)."""
    plain = text.trim(text.squeeze(F.coalesce("intro", F.lit(""))))
    rows = rows.withColumn("intro", plain)
    unknown = F.size(unknown_entities(F.array("intro"), F.col("corpus"), lexicon))
    reason = (
        F.when(F.char_length("intro") < 80, "too short").when(F.col("intro").rlike(r"^[-*•#>]"), "list or heading").when(unknown > most_unknown, "unknown names")
    )
    cut = F.concat(F.regexp_replace(F.substring("intro", 1, 600), r"\s+\S*$", ""), F.lit("…"))
    rows = rows.withColumn("unknown_count", unknown).withColumn("reason", reason)
    return rows.withColumn("intro", F.when(F.char_length("intro") > 600, cut).otherwise(F.col("intro"))).withColumn("ok", F.col("reason").isNull())


def editorial_gate(editions: DataFrame, editorials: DataFrame, hour_from: int = 11, force: bool = False) -> DataFrame:
    """(date, hour_utc, generate, reason) for editions (date, hour_utc)."""
    done = editorials.select("date", F.lit(True).alias("done")).distinct()
    rows = editions.join(done, "date", "left")
    reason = F.when(F.lit(force), "forced").when(F.col("done"), "exists").when(F.col("hour_utc") < hour_from, "too early").otherwise("due")
    return rows.select("date", "hour_utc", reason.isin("forced", "due").alias("generate"), reason.alias("reason"))


def highlights(home: DataFrame, key: str = "date", most: int = 6) -> DataFrame:
    """The first `most` home stories of each edition: (key, story_rank, slug, titulo, categoria)."""
    category = F.coalesce(text.blank_to_null(F.col("categoria")), F.lit(FALLBACK_CATEGORY))
    return home.where(F.col("story_rank") <= most).select(key, "story_rank", "slug", "titulo", category.alias("categoria"))

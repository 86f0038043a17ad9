"""Summaries of clusters: checks, cache, budget, requests and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.functions import text
from newsdesk.params import FALLBACK_CATEGORY, FALLBACK_WHY, MONTHS, SummaryParams

FIELDS = ("titulo", "resumo", "por_que_importa", "categoria")
MONTH_KEYS = tuple(m.replace("ç", "c") for m in MONTHS)


def sanitize(rows: DataFrame, least_why: int = 15) -> DataFrame:
    """The summary columns trimmed, a blank category as the fallback's, and `reason` (null if the summary is complete)."""
    clean = {c: text.trim(F.coalesce(c, F.lit(""))) for c in FIELDS}
    clean["categoria"] = F.coalesce(F.nullif(clean["categoria"], F.lit("")), F.lit(FALLBACK_CATEGORY))
    reason = F.when((F.col("titulo") == "") | (F.col("resumo") == ""), F.lit("incomplete")).when(F.char_length("por_que_importa") < least_why, F.lit("why too short"))
    return rows.withColumns(clean).withColumn("reason", reason)


def date_inconsistent(words: Column, at: Column) -> Column:
    """Whether a month is named that is neither the date's own, the one before nor one of the two after."""
    named = F.regexp_extract_all(text.fold_plain(words), F.lit(rf"\b({'|'.join(MONTH_KEYS)})\b"), F.lit(1))
    months = F.array(*[F.lit(m) for m in MONTH_KEYS])
    diff = lambda m: F.pmod(F.month(at) - F.array_position(months, m).cast("int"), F.lit(12))
    return F.coalesce(F.exists(named, lambda m: ~diff(m).isin(0, 1, 10, 11)), F.lit(False))


def unknown_names(title: Column, folded_corpus: Column) -> Column:
    """Names of a title (see named_entities) that the folded corpus doesn't hold."""
    return F.filter(text.named_entities(title), lambda e: ~F.contains(folded_corpus, e))


def cluster_corpus(members: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, corpus): folded titles and descriptions of a cluster's members, in order."""
    said = F.concat_ws(" ", "title", "description")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member_rank", said.alias("said")))), lambda x: x["said"]), " ")
    return members.groupBy(*keys).agg(joined.alias("corpus")).withColumn("corpus", text.fold_plain(F.col("corpus")))


def fallback_summary(members: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Title and description of the member with the longest description, the first of equals."""
    best = F.max_by(F.struct("title", "description"), F.struct(F.char_length(F.coalesce("description", F.lit(""))), -F.col("member_rank")))
    return members.groupBy(*keys).agg(best.alias("m")).select(
        *keys,
        F.col("m.title").alias("titulo"),
        F.coalesce(F.nullif(F.col("m.description"), F.lit("")), F.col("m.title")).alias("resumo"),
        F.lit(FALLBACK_WHY).alias("por_que_importa"),
        F.lit(FALLBACK_CATEGORY).alias("categoria"),
    )


def valid(rows: DataFrame, p: SummaryParams = SummaryParams()) -> Column:
    """A summary that holds: no unknown names, no incoherent month, a substantial reason why."""
    words = F.concat_ws(" ", "titulo", "resumo", "por_que_importa")
    why = F.char_length(text.trim(F.coalesce("por_que_importa", F.lit(""))))
    return (F.size(unknown_names(F.col("titulo"), F.col("corpus"))) == 0) & ~date_inconsistent(words, F.col("latest_at")) & (why >= p.least_why)


def resolve(pool: DataFrame, cache: DataFrame, responses: DataFrame, fallback: DataFrame, now: Column, p: SummaryParams = SummaryParams()) -> DataFrame:
    """Each cluster's summary and status: fresh, generated, stale or fallback.

    pool: (edition_ts, slug, rank, latest_at, corpus). A valid cached summary of at most `ttl_hours` is fresh;
    otherwise a cluster within the edition's budget takes a response that passes all checks; otherwise a valid
    cached one is stale; otherwise the fallback serves.
    """
    keys = ["edition_ts", "slug"]
    cached = cache.select("slug", *[F.col(c).alias(f"c_{c}") for c in FIELDS], "cached_at")
    answered = responses.select("slug", *[F.col(c).alias(f"r_{c}") for c in FIELDS])
    rows = pool.join(cached, "slug", "left").join(answered, "slug", "left")
    rows = rows.join(fallback.select(*keys, *[F.col(c).alias(f"f_{c}") for c in FIELDS]), keys)

    def checked(prefix: str) -> Column:
        t = {c: text.trim(F.coalesce(f"{prefix}_{c}", F.lit(""))) for c in FIELDS}
        words = F.concat_ws(" ", *[t[c] for c in FIELDS[:3]])
        ok = (t["titulo"] != "") & (t["resumo"] != "") & (F.char_length(t["por_que_importa"]) >= p.least_why)
        ok = ok & (F.size(unknown_names(t["titulo"], F.col("corpus"))) == 0) & ~date_inconsistent(words, F.col("latest_at"))
        return F.col(f"{prefix}_titulo").isNotNull() & ok

    young = F.col("cached_at").cast("double") >= now.cast("double") - 3600 * p.ttl_hours
    rows = rows.withColumn("cache_ok", checked("c")).withColumn("response_ok", checked("r"))
    rows = rows.withColumn("is_fresh", F.coalesce(F.col("cache_ok") & young, F.lit(False)))
    asked = F.sum((~F.col("is_fresh")).cast("int")).over(Window.partitionBy("edition_ts").orderBy("rank"))
    rows = rows.withColumn("request_rank", F.when(~F.col("is_fresh"), asked))
    in_budget = F.coalesce(F.col("request_rank") <= p.budget, F.lit(False))
    status = F.when(F.col("is_fresh"), "fresh").when(in_budget & F.col("response_ok"), "generated").when(F.col("cache_ok"), "stale").otherwise("fallback")
    rows = rows.withColumn("status", status)
    chosen = {}
    for c in FIELDS:
        response = text.trim(F.col(f"r_{c}"))
        if c == "categoria":
            response = F.coalesce(text.blank_to_null(F.col("r_categoria")), F.lit(FALLBACK_CATEGORY))
        chosen[c] = F.when(F.col("status").isin("fresh", "stale"), F.col(f"c_{c}")).when(F.col("status") == "generated", response).otherwise(F.col(f"f_{c}"))
    return rows.select(*keys, "rank", "status", "request_rank", *[chosen[c].alias(c) for c in FIELDS])


def newest(cache: DataFrame) -> DataFrame:
    """The newest summary of each slug; of equally new ones the greatest by its fields."""
    return cache.groupBy("slug").agg(F.max(F.struct("cached_at", *FIELDS)).alias("row")).select("slug", *[F.col(f"row.{c}").alias(c) for c in (*FIELDS, "cached_at")])


def generated(resolved: DataFrame, now: Column) -> DataFrame:
    """What a run adds to the cache."""
    return resolved.where("status = 'generated'").select("slug", *FIELDS, now.alias("cached_at"))


def next_cache(cache: DataFrame, resolved: DataFrame, now: Column, p: SummaryParams = SummaryParams()) -> DataFrame:
    """The cache after a run: generated summaries over the old ones, the newest of each slug, pruned."""
    both = cache.select("slug", *FIELDS, "cached_at").unionByName(generated(resolved, now))
    return prune_cache(newest(both), now, p.prune_hours)


def prune_cache(cache: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    return cache.where(F.col("cached_at").cast("double") >= now.cast("double") - 3600 * hours)


def request_text(members: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, request): numbered `(source) title` and description blocks, in member order; the instruction is the caller's."""
    block = F.struct("member_rank", "source", "title", "description")
    said = F.transform(
        F.array_sort(F.collect_list(block)),
        lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), F.coalesce(x["source"], F.lit("")), F.lit(") "), x["title"], F.lit("\n"), F.coalesce(x["description"], F.lit(""))),
    )
    return members.groupBy(*keys).agg(said.alias("blocks")).select(*keys, F.array_join("blocks", "\n\n").alias("request"))


def parse_response(c: Column, schema: str) -> Column:
    """The JSON object between the first { and the last } of a response; null if there is none or it doesn't parse."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), schema)

"""The adapter's tables in SQL: a chain of common table expressions that each oracle starts with."""

from __future__ import annotations

from newsdesk.functions.text import PUNCTUATION, WS
from newsdesk.functions.urls import TRACKING
from newsdesk.params import CAPTION_ENDS, MONTHS, Lexicon
from newsdesk.plans.adapter import CATEGORIES, LEXICON


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, {q(WS + '+')}, ' ', 'g')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def fold_plain(x: str) -> str:
    return f"lower(strip_accents({x}))"


def fold(x: str) -> str:
    return squeeze(fold_plain(x))


def slugify(x: str) -> str:
    return f"regexp_replace(regexp_replace({fold_plain(x)}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def category_slug(x: str) -> str:
    return f"coalesce(nullif({slugify(x)}, ''), 'geral')"


def any_of(x: str, terms) -> str:
    return f"regexp_matches({x}, {q('|'.join(terms))})"


def listed(terms) -> str:
    return "[" + ", ".join(q(t) for t in terms) + "]"


def xml(x: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        x = f"replace({x}, {q(raw)}, {q(safe)})"
    return x


def html_steps(x: str, p: str) -> str:
    """Select items p1 .. p9 that strip HTML; p9 is the result."""
    numeric = (
        f"array_to_string(list_transform(range(1, len({p}4) + 1), lambda i: {p}4[i] || "
        f"CASE WHEN i <= len({p}5) THEN chr((coalesce(try_cast({p}5[i] AS BIGINT), 0) % 65536)::INT) ELSE '' END), '')"
    )
    entities = f"{p}6"
    for name, text in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        entities = f"regexp_replace({entities}, '&{name};', {q(text)}, 'gi')"
    return f"""
  regexp_replace({x}, '(?is)<\\s*script[^>]*>.*?<\\s*/\\s*script\\s*>', '', 'g') AS {p}1,
  regexp_replace({p}1, '(?is)<\\s*style[^>]*>.*?<\\s*/\\s*style\\s*>', '', 'g') AS {p}2,
  regexp_replace({p}2, '<[^>]+>', ' ', 'g') AS {p}3,
  regexp_split_to_array({p}3, '&#[0-9]+;') AS {p}4,
  regexp_extract_all({p}3, '&#([0-9]+);', 1) AS {p}5,
  CASE WHEN contains({p}3, '&#') THEN {numeric} ELSE {p}3 END AS {p}6,
  {entities} AS {p}7,
  {trim(squeeze(f'{p}7'))} AS {p}9"""


def caption_steps(x: str, p: str) -> str:
    """Select items for stripping a caption; {p} is the result. The engine has no look-ahead, so a group leaves it out."""
    steps, tries = [], []
    for k, end in enumerate(CAPTION_ENDS):
        pattern = "(" + end.removesuffix(")").replace("(?=", ")")
        a, f, b = f"{p}at{k}", f"{p}f{k}", f"{p}b{k}"
        steps.append(f"regexp_extract({x}, {q(pattern)}, 1) AS {f}")
        steps.append(f"strpos({x}, regexp_extract({x}, {q(pattern)}, 0)) - 1 AS {a}")
        steps.append(f"{trim(f'substr({x}, {a} + length({f}) + 1)')} AS {b}")
        tries.append(f"WHEN {f} <> '' AND {a} BETWEEN 5 AND 120 AND length({b}) >= 40 AND {a} < length({b}) THEN {b}")
    return ",\n  ".join(steps) + f",\n  CASE WHEN length({x}) < 50 THEN {x} {' '.join(tries)} ELSE {x} END AS {p}"


def truncate(x: str, most: int = 600) -> str:
    cut = f"substr({x}, 1, {most})"
    space = f"({most} - strpos(reverse({cut}), ' '))"
    word = f"CASE WHEN strpos({cut}, ' ') > 0 AND {space} > {most * 0.6} THEN substr({cut}, 1, {space}) ELSE {cut} END"
    return f"CASE WHEN length({x}) > {most} THEN {trim(word)} || '…' ELSE {x} END"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def local(x: str) -> str:
    return f"(({x}) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Sao_Paulo')"


def tokens(x: str, stopwords=LEXICON.stopwords) -> str:
    words = f"regexp_split_to_array(regexp_replace({fold_plain(x)}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+')"
    return f"list_filter({words}, lambda w: length(w) > 2 AND NOT list_contains({listed(stopwords)}, w))"


def entities(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(regexp_replace({x}, {q('[' + PUNCTUATION + ']+')}, '', 'g'), {q(WS + '+')}), lambda w: w <> '')"
    named = f"list_filter({words}[2:], lambda w: regexp_matches(w, '^[A-ZÀ-Ý][A-Z0-9À-Ý\\-]+$') OR (regexp_matches(w, '^[A-ZÀ-Ý]') AND length(w) >= 4))"
    return f"list_distinct(list_transform({named}, lambda w: {fold_plain('w')}))"


def month_name(x: str) -> str:
    return f"{listed(MONTHS)}[month({x})]"


def date_label(x: str) -> str:
    return f"day({x}) || ' de ' || {month_name(x)} || ' de ' || year({x})"


def rfc1123(x: str) -> str:
    return f"strftime({x}, '%a, %d %b %Y %H:%M:%S GMT')"


def w3c(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%SZ')"


def date_bad(words: str, at: str) -> str:
    keys = [m.replace("ç", "c") for m in MONTHS]
    named = f"regexp_extract_all({fold_plain(words)}, '\\b({'|'.join(keys)})\\b', 1)"
    return f"coalesce(len(list_filter({named}, lambda m: (month({at}) - list_position({listed(keys)}, m) + 12) % 12 NOT IN (0, 1, 10, 11))) > 0, false)"


def unknown(title_entities: str, corpus: str) -> str:
    return f"list_filter({title_entities}, lambda e: NOT contains({corpus}, e))"


def normal_url(x: str) -> str:
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({x}, '^(?i)https?://([^/?#]+)', 1)), '^www\\.', ''), ':(80|443)$', '')"
    path = f"regexp_replace(regexp_extract({x}, '^(?i)https?://[^/?#]+([^?#]*)', 1), '/$', '')"
    query = f"list_filter(string_split(regexp_extract({x}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), {q(TRACKING)}))"
    return f"'https://' || {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN len({query}) > 0 THEN '?' || array_to_string({query}, '&') ELSE '' END"


CATEGORY = f"{listed(CATEGORIES)}[(item_rank % 5 + 1)::INT]"

CHAIN = rf"""WITH RECURSIVE raw AS (
  SELECT doc_id, coalesce(text, '') AS text, source, lang,
         TIMESTAMP '2024-01-01' + to_minutes(5 * doc_id) AS pub, TIMESTAMP '2024-01-01 00:10:00' + to_minutes(5 * doc_id) AS fetched_at
  FROM documents
), body AS (
  SELECT doc_id, source, pub, fetched_at,{html_steps("regexp_extract(text, '^[^.\n]*')", "h")},{html_steps("text", "b")}
  FROM raw
), caption AS (
  SELECT doc_id, source, pub, fetched_at, h9 AS title, b9,
  {caption_steps("b9", "c")}
  FROM body
), articles AS (
  SELECT substr(sha1('https://news.example.com/n/' || (doc_id - CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END)), 1, 16) AS id,
         'https://www.news.example.com/n/' || (doc_id - CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END) || '/?utm_source=' || source || '#t' AS url,
         'https://news.example.com/n/' || (doc_id - CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END) AS norm_url,
         source, title, {truncate("c")} AS description,
         CASE WHEN doc_id % 17 = 0 THEN 'https://img.example.com/n' || doc_id || '.jpg'
              WHEN doc_id % 3 = 0 THEN 'https://img.example.com/m' || doc_id
              WHEN doc_id % 5 = 0 THEN 'https://img.example.com/e' || doc_id || '.png?w=1'
              WHEN doc_id % 11 = 0 THEN 'https://img.example.com/h' || doc_id || '.gif' END AS image_url,
         CASE WHEN doc_id % 13 = 5 THEN fetched_at ELSE pub END AS published_at, fetched_at,
         regexp_extract(source, '([0-9]+)$', 1)::INT AS feed_rank, doc_id AS item_rank
  FROM caption WHERE title <> ''
), firsts AS (
  SELECT * FROM articles QUALIFY row_number() OVER (PARTITION BY id ORDER BY feed_rank, item_rank) = 1
), flags AS (
  SELECT *, {fold("title || ' ' || description")} AS hay,
         {any_of("hay", LEXICON.standalone)} AS standalone, {any_of("hay", LEXICON.ambiguous)} AS ambiguous, {any_of("hay", LEXICON.damage)} AS damage
  FROM firsts
), niche AS (
  SELECT * FROM flags WHERE standalone OR (ambiguous AND damage)
), members AS (
  SELECT *, {local("published_at")}::DATE AS date, item_rank % 100 % 7 AS bucket,
         row_number() OVER (PARTITION BY {local("published_at")}::DATE, item_rank % 100 % 7 ORDER BY published_at DESC, id) AS member_rank,
         row_number() OVER (PARTITION BY {local("published_at")}::DATE, item_rank % 100 % 7 ORDER BY published_at, norm_url) = 1 AS is_anchor
  FROM flags
), once AS (
  SELECT id AS slug, substr(sha1('c' || id), 1, 16) AS cluster_id, title AS titulo, description AS resumo,
         CASE WHEN item_rank % 4 = 0 THEN '' ELSE substr(description, 1, 120) END AS por_que_importa,
         {CATEGORY} AS categoria, {category_slug(CATEGORY)} AS categoria_slug, source, url, image_url,
         published_at AS updated_at, {local("published_at")}::DATE AS date, item_rank
  FROM firsts
), stories AS (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY updated_at DESC, slug) AS rank FROM (
    SELECT * FROM once
    UNION ALL SELECT * REPLACE (titulo || ' (2)' AS titulo, (date + 1)::DATE AS date) FROM once WHERE item_rank % 3 = 0)
), sec AS (
  SELECT date, categoria_slug, count(*) AS section_size, arg_min(categoria, rank) AS section_label, min(rank) AS first
  FROM stories GROUP BY ALL
), secs AS (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY section_size DESC, first) AS section_rank FROM sec
), sectioned AS (
  SELECT s.*, k.section_size, k.section_label, k.section_rank,
         row_number() OVER (PARTITION BY s.date, s.categoria_slug ORDER BY rank) AS story_rank
  FROM stories s JOIN secs k USING (date, categoria_slug)
), top AS (
  SELECT *, min(CASE WHEN image_url IS NOT NULL THEN rank END) OVER (PARTITION BY date) AS first_image FROM stories WHERE rank <= 10
), home AS (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY CASE WHEN rank = first_image THEN 0 ELSE 1 END, rank) AS story_rank FROM top
), rows AS (
  SELECT date, slug, cluster_id, titulo, resumo, por_que_importa, categoria, categoria_slug, source, url, image_url, updated_at,
         'home' AS section, NULL::VARCHAR AS section_label, 0 AS section_rank, story_rank FROM home
  UNION ALL
  SELECT date, slug, cluster_id, titulo, resumo, por_que_importa, categoria, categoria_slug, source, url, image_url, updated_at,
         categoria_slug, section_label, section_rank, story_rank FROM sectioned
), catalog AS (
  SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY slug ORDER BY date = (SELECT max(date) FROM rows) DESC, date DESC, section <> 'home', section_rank, story_rank) = 1
)
"""


def generic(lexicon: Lexicon = LEXICON) -> str:
    return listed(lexicon.generic)

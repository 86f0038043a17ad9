"""Canonical URLs and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsdesk.functions.text import trim

# Query parameters that only track, any case.
TRACKING = r"(?i)^(utm_.*|fbclid|gclid|igshid|mc_.*|ref|ref_.*|spm|_ga|cmpid|xtor|s_cid)$"
ODD = r"[^\x21-\x7E]|[\"<>`{}]"
URL = r"(?i)^(https?):/*([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, f"(?s){URL}", group)


def _encoded_path(c: Column) -> Column:
    """A path with the characters that URLs don't hold as they are percent-encoded (UTF-8); what is encoded stays so."""
    one = lambda x: F.when(x.rlike(ODD), F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))).otherwise(x)
    return F.when(c.rlike(ODD), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


def _slashes(c: Column) -> Column:
    """Backslashes before the query are slashes."""
    front = F.regexp_extract(c, r"(?s)^[^?#]*", 0)
    turned = F.concat(F.translate(front, "\\", "/"), F.substring(c, F.char_length(front) + 1, F.lit(1 << 30)))
    return F.when(F.contains(front, F.lit("\\")) & c.rlike(r"(?i)^https?:"), turned).otherwise(c)


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments (also percent-encoded ones) resolved: a stack of segments."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/")

    def step(stack: Column, segment: Column) -> Column:
        plain = F.regexp_replace(segment, "(?i)%2e", ".")
        up = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.when(plain == "..", up).when(plain == ".", stack).otherwise(F.concat(stack, F.array(segment)))

    resolved = F.concat(F.lit("/"), F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/"))
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), resolved).otherwise(path)


def _ascii_host(host: Column) -> Column:
    """An internationalised host name in its ASCII form; one that has none stays."""
    wide = F.lower(F.coalesce(F.try_url_decode(host), host))
    name, port = F.regexp_extract(wide, r"^(.*?)(:\d*)?$", 1), F.regexp_extract(wide, r"^(.*?)(:\d*)?$", 2)
    found = F.concat(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), name), port)
    return F.when(host.rlike(r"[^\x00-\x7F]|%"), F.coalesce(found, host)).otherwise(host)


def normalize_url(raw: Column) -> Column:
    """https, host in lower case without one leading www., no fragment, no tracking parameters, no trailing slash.

    A repeated parameter keeps its first place and its last value. What is no http(s) URL is returned trimmed.
    Paths are percent-encoded and free of dot segments, backslashes before the query count as slashes, and host names of
    any alphabet are in their ASCII form.
    """
    c = _slashes(trim(raw))
    authority = _part(c, 2)
    user = F.regexp_extract(authority, r"^(.*@)?", 1)
    host = F.regexp_replace(_ascii_host(F.lower(F.regexp_replace(authority, r"^.*@", ""))), r"^www\.", "")
    host = F.regexp_replace(host, F.when(F.lower(_part(c, 1)) == "http", F.lit(r":(80|443)?$")).otherwise(F.lit(r":(443)?$")), F.lit(""))
    path = F.regexp_replace(_without_dots(_encoded_path(_part(c, 3))), r"/$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    given = F.filter(F.split(F.substring(_part(c, 4), 2, 1 << 30), "&"), lambda p: p != "")
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(given, lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), plain(F.regexp_replace(p, r"^[^=]*=?", "")).alias("v")))
    keys = F.filter(F.array_distinct(F.transform(pairs, lambda x: x["k"])), lambda k: ~k.rlike(TRACKING))
    last = lambda k: F.element_at(F.filter(pairs, lambda x: x["k"] == k), -1)["v"]
    query = F.array_join(F.transform(keys, lambda k: F.concat(F.url_encode(k), F.lit("="), F.url_encode(last(k)))), "&")
    url = F.concat(F.lit("https://"), user, host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(c.rlike(f"(?s){URL}"), url).otherwise(c)


def article_id(url: Column, normalised: bool = False) -> Column:
    return F.substring(F.sha1((url if normalised else normalize_url(url)).cast("binary")), 1, 16)

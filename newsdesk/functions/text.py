"""Column functions over text. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsdesk.params import CAPTION_ENDS, CONNECTORS

#: White space as feeds' consumers understand it: Java's \s leaves the Unicode spaces out.
WS = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&"))  # amp last: one pass
PUNCTUATION = '.,;:!?()"“”'


#: A run of white space that isn't one plain space; the first test passes over ordinary characters quickly.
_RUN = rf"(?![\x21-\x7E])(?:\x20{WS}+|(?!\x20){WS}+)"
_SPACES = rf"(?![\x21-\x7E]){WS}+"


def squeeze(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, _RUN, " ")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{_SPACES}$", "")


@functools.cache
def accent_map() -> tuple[str, str]:
    """BMP letters that decompose into a base and marks of U+0300-036F, and their bases."""
    found = {}
    for code in range(0xC0, 0xFFFF):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xF8FF:
            continue
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(0x300 <= ord(p) <= 0x36F for p in parts[1:]):
            found[chr(code)] = parts[0]
    return "".join(found), "".join(found.values())


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *accent_map()), r"[\x{300}-\x{36F}]", "")


def fold(c: Column) -> Column:
    """Without accents, in lower case, white space squeezed."""
    return squeeze(F.lower(strip_accents(c)))


def fold_plain(c: Column) -> Column:
    """As fold(), white space as it is."""
    return F.lower(strip_accents(c))


class Pattern(str):
    """A term that is read as a regular expression, of one character for each of its own."""


def alternatives(terms) -> str:
    """A pattern that finds any of the terms as a substring."""
    return "|".join(f"(?d:{t})" if isinstance(t, Pattern) else re.escape(t).replace("\\ ", " ") for t in terms) or r"(?!)"


def contains_any(folded: Column, terms) -> Column:
    return folded.rlike(alternatives(terms))


def decode_numeric(c: Column) -> Column:
    """`&#N;` as the UTF-16 unit N."""
    between = F.split(c, r"&#\d+;")
    unit = lambda n: F.decode(F.unhex(F.lpad(F.hex(F.coalesce(n.try_cast("bigint"), F.lit(0)) % 65536), 4, "0")), "UTF-16BE")
    units = F.transform(F.regexp_extract_all(c, F.lit(r"&#(\d+);"), F.lit(1)), unit)
    joined = F.array_join(F.zip_with(between, units, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(c.contains("&#"), joined).otherwise(c)


def strip_html(c: Column) -> Column:
    """Text of a fragment: scripts and styles go, tags become spaces, numeric and seven named entities are decoded."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?is)<\s*(script|style)[^>]*>.*?<\s*/\s*\1\s*>", ""), r"<[^>]+>", " ")
    plain = F.when(c.contains("<"), plain).otherwise(c)
    decoded = decode_numeric(plain)
    for name, text in ENTITIES:
        decoded = F.regexp_replace(decoded, f"(?i)&{name};", text)
    return F.trim(squeeze(F.when(c.contains("&"), decoded).otherwise(plain)))


def truncate(c: Column, most: int = 600) -> Column:
    """At most `most` characters and an ellipsis, cut at the last space if that is in the last 40 %."""
    cut = F.substring(c, 1, most)
    space = most - F.instr(F.reverse(cut), " ")  # characters before the last space
    at_word = F.when((F.instr(cut, " ") > 0) & (space > most * 0.6), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.char_length(c) > most, F.concat(trim(at_word), F.lit("…"))).otherwise(c)


def strip_caption(c: Column) -> Column:
    """The body behind a photo caption and credit at the front; the text itself where it is not clearly one."""
    tries = []
    for end in CAPTION_ENDS:
        front = rf"(?s)^(.{{0,120}}?){end}"  # the first match, if it begins by character 120
        whole, at = F.regexp_extract(c, front, 0), F.char_length(F.regexp_extract(c, front, 1))
        body = trim(F.substring(c, F.char_length(whole) + 1, F.char_length(c)))
        good = (at >= 5) & (F.char_length(body) >= 40) & (at < F.char_length(body))
        tries.append(F.when((whole != "") & good, body))
    return F.when(F.char_length(c) >= 50, F.coalesce(*tries, c)).otherwise(c)


def tokens(c: Column, stopwords) -> Column:
    """Folded words of three or more of [a-z0-9] that are no stopwords."""
    words = F.split(F.regexp_replace(fold_plain(c), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda t: (F.char_length(t) > 2) & ~t.isin(*stopwords))


def named_entities(c: Column) -> Column:
    """Distinct folded names in a title: from the second word on, acronyms or capitalised words of four or more."""
    words = F.filter(F.split(F.regexp_replace(c, rf"[{re.escape(PUNCTUATION)}]+", ""), _SPACES), lambda t: t != "")
    named = F.filter(F.slice(words, 2, 1 << 30), lambda t: t.rlike(r"(?s)^[A-ZÀ-Ý](?:.{3}|[A-Z0-9À-Ý\-]+$)"))
    return F.array_distinct(F.transform(named, fold_plain))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold_plain(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def category_slug(c: Column, fallback: str = "geral") -> Column:
    return F.coalesce(F.nullif(slugify(c), F.lit("")), F.lit(fallback))


def xml_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def clip(c: Column, most) -> Column:
    most = most if isinstance(most, Column) else F.lit(most)
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, F.lit(1), most - 1), F.lit("…"))).otherwise(c)


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim(c), F.lit(""))


def capitalised_runs(title: Column, connectors=CONNECTORS) -> Column:
    """Runs of capitalised words in a title, joined by single connectors where a capitalised word follows."""
    proper = r"^[A-ZÀ-Ý][A-Za-zÀ-ÿ0-9'’.-]*$"
    tail = rf"[{re.escape(PUNCTUATION)}]+$"
    raw = F.filter(F.split(title, f"{WS}+"), lambda t: t != "")
    clean = lambda t: F.regexp_replace(F.regexp_replace(t, tail, ""), r'^["“”(]+', "")
    after = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), tail, "")
    words = F.zip_with(raw, F.slice(raw, 2, 1 << 30), lambda t, n: F.struct(clean(t).alias("w"), after(n).alias("next")))
    # what is asked of a word is computed once
    words = F.transform(words, lambda x: F.struct(x["w"].alias("w"), x["w"].rlike(proper).alias("proper"), slugify(x["w"]).isin(*connectors).alias("connects"), x["next"].rlike(proper).alias("goes_on")))
    kind = "array<struct<w:string,connects:boolean>>"

    def step(acc: Column, x: Column) -> Column:
        inside = F.size(acc["run"]) > 0
        joins = x["connects"] & inside & x["goes_on"]
        own = lambda w: F.array(F.struct(w.alias("w"), x["connects"].alias("connects")))
        run = F.when(x["proper"], F.concat(acc["run"], own(x["w"]))).when(joins, F.concat(acc["run"], own(F.lower(x["w"])))).otherwise(F.array().cast(kind))
        closes = ~x["proper"] & ~joins & inside
        out = F.when(closes, F.concat(acc["out"], F.array(acc["run"]))).otherwise(acc["out"])
        return F.struct(out.alias("out"), run.alias("run"))

    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.array().cast(kind).alias("run"))
    runs = F.aggregate(words, start, step, lambda a: F.when(F.size(a["run"]) > 0, F.concat(a["out"], F.array(a["run"]))).otherwise(a["out"]))
    ends = lambda run: F.aggregate(  # noqa: E731  connectors at the end go
        F.reverse(run),
        F.array().cast("array<string>"),
        lambda kept, x: F.when((F.size(kept) == 0) & x["connects"], kept).otherwise(F.concat(F.array(x["w"]), kept)),
    )
    return F.transform(F.filter(F.transform(runs, ends), lambda r: F.size(r) > 0), lambda r: F.array_join(r, " "))

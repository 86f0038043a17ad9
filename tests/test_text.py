import pytest
from pyspark.sql import functions as F

from newsdesk.functions import dates, text
from newsdesk.functions.urls import article_id, normalize_url
from newsdesk.params import STOPWORDS


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_normalize_url(spark):
    cases = {
        "http://www.g1.globo.com/noticia/?utm_source=x&fbclid=y#topo": "https://g1.globo.com/noticia",
        "https://site.com/n?id=42&utm_medium=rss": "https://site.com/n?id=42",
        "not a url": "not a url",
        " HTTPS://WWW.Site.COM:443/A/ ": "https://site.com/A",
        "http://site.com:80/": "https://site.com/",
        "https://site.com/p?a=1&reference=2&ref=3&UTM_X=4&a=5": "https://site.com/p?a=5&reference=2",
        "https://site.com/p?q=a%20b~*&z=%zz": "https://site.com/p?q=a+b%7E*&z=%25zz",
        "https://site.com": "https://site.com/",
    }
    cases["https://x.com/notícia/a b\"<c>/{d}/%C3%A9/"] = "https://x.com/not%C3%ADcia/a%20b%22%3Cc%3E/%7Bd%7D/%C3%A9"
    cases["https://x.com/a/😀"] = "https://x.com/a/%F0%9F%98%80"
    assert values(spark, normalize_url(F.col("x")), list(cases)) == list(cases.values())
    a, b, n = values(spark, article_id(F.col("x")), ["http://www.a.com/n/?ref=1", "https://a.com/n", None])
    assert a == b and len(a) == 16 and n is None


def test_strip_html(spark):
    cases = {
        "Título <b>X</b>": "Título X",
        "<script>var a='<p>'</script>a<style>x</style> b": "a b",
        "&#8220;oi&#8221; &AMP;lt; &lt;p&gt; &eacute; &nbsp;x": "“oi” &lt; <p> &eacute; x",
        "a   b﻿": "a b",
        "": "",
    }
    assert values(spark, text.strip_html(F.col("x")), list(cases)) == list(cases.values())


def test_truncate(spark):
    words = "palavra " * 100
    short, long, solid = values(spark, text.truncate(F.col("x")), ["curto", words, "x" * 700])
    assert short == "curto" and long == ("palavra " * 75).strip() + "…" and solid == "x" * 600 + "…"


def test_strip_caption(spark):
    body = "Dois homens foram detidos nesta manhã depois de uma perseguição na rodovia."
    cut = [f"Base alvo dos criminosos {mark} {body}" for mark in ("PRF", "Arquivo pessoal", "Kelvin Ramirez/Só Notícias", "Foto: Maria")]
    assert values(spark, text.strip_caption(F.col("x")), cut) == [body] * 4
    kept = [body, f"PRF {body}", "Uma legenda muito longa que domina o texto inteiro da nota PRF Corpo curto.", "curto PRF Texto", ""]
    assert values(spark, text.strip_caption(F.col("x")), kept) == kept


def test_tokens_and_entities(spark):
    assert values(spark, text.tokens(F.col("x"), STOPWORDS), ["A inflação não cai, segundo o Governo!"]) == [["inflacao", "cai", "governo"]]
    cases = {
        "Acidente na BR-251 em Minas Gerais": ["br-251", "minas", "gerais"],
        "Polícia Civil prende, diz MG": ["civil", "mg"],
        "Brasil": [],
        "o de Rio, Pantanal (Bélgica)": ["pantanal", "belgica"],
    }
    assert values(spark, text.named_entities(F.col("x")), list(cases)) == list(cases.values())


def test_slugs(spark):
    assert values(spark, text.slugify(F.col("x")), ["Acidente de Trânsito!", "--", "É já"]) == ["acidente-de-transito", "", "e-ja"]
    assert values(spark, text.category_slug(F.col("x")), [" ", None, "Onda de calor"]) == ["geral", "geral", "onda-de-calor"]


def test_capitalised_runs(spark):
    cases = {
        "Chuva no Rio Grande do Sul, Defesa Civil alerta": ["Chuva no Rio Grande do Sul Defesa Civil"],
        "A Defesa Civil de": ["A Defesa Civil"],
        "acidente na BR-163 em 2026": ["BR-163"],
        "Vale do e": ["Vale"],
        "vale, Rio Doce sobe": ["Rio Doce"],
        "": [],
    }
    assert values(spark, text.capitalised_runs(F.col("x")), list(cases)) == list(cases.values())


def test_dates(spark):
    rows = spark.createDataFrame([("2026-05-20T10:00:00.000Z", None), (None, "Wed, 20 May 2026 07:00:00 -0300"), ("data-zoada", None), (None, None)], "iso string, pub string")
    got = [r[0] for r in rows.select(F.date_format(dates.parse_date(F.col("iso"), F.col("pub"), F.lit("2020-01-01").cast("timestamp")), "yyyy-MM-dd HH")).collect()]
    assert got == ["2026-05-20 10", "2026-05-20 10", "2020-01-01 00", "2020-01-01 00"]
    at = F.to_timestamp("x")
    assert values(spark, dates.edition_date(at).cast("string"), ["2026-05-21T02:00:00Z"]) == ["2026-05-20"]
    assert values(spark, dates.time_label(at), ["2026-05-20T17:30:00Z", None]) == ["às 14h30", ""]
    assert values(spark, dates.date_label(F.col("x")), ["2026-06-03", "ontem"]) == ["3 de junho de 2026", "ontem"]
    assert values(spark, dates.full_label(F.col("x")), ["2026-05-19"]) == ["terça-feira, 19 de maio de 2026"]
    assert values(spark, dates.rfc1123(at), ["2026-06-02T12:00:00Z"]) == ["Tue, 02 Jun 2026 12:00:00 GMT"]


@pytest.mark.parametrize("given,want", [("<a & 'b'>\"", "&lt;a &amp; &apos;b&apos;&gt;&quot;")])
def test_xml(spark, given, want):
    assert values(spark, text.xml_escape(F.col("x")), [given]) == [want]


def test_hosts_and_paths_as_a_parser_sees_them(spark):
    cases = {
        "https://São.com/x": "https://xn--so-sia.com/x",
        "https://a.com/b/../c": "https://a.com/c",
        "https://a.com\\x": "https://a.com/x",
        "https://a.com/./b/.": "https://a.com/b",
        "https://a.com/..": "https://a.com/",
        "https://a.com/a/b/../../../c/": "https://a.com/c",
        "https://a.com/a/%2E%2e/b": "https://a.com/b",
        "https://a.com/a/.%2E": "https://a.com/",
        "https://a.com/a..b/.c/d.": "https://a.com/a..b/.c/d.",
        "http:\\\\a.com\\b?x=\\y": "https://a.com/b?x=%5Cy",
        "https://www.MÜNCHEN.de:443/ä": "https://xn--mnchen-3ya.de/%C3%A4",
        "https://b%C3%BCcher.example/": "https://xn--bcher-kva.example/",
        "https://日本.jp:8080/..//x": "https://xn--wgv71a.jp:8080//x",
        "mailto:a\\b": "mailto:a\\b",
    }
    assert values(spark, normalize_url(F.col("x")), list(cases)) == list(cases.values())

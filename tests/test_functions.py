"""Columns on small rows: URLs, HTML, tokens, queries, spelling edits."""

import pytest
from pyspark.sql import functions as F

from pagelode.config import Scope
from pagelode.functions import html, query, text, urls
from pagelode.operators import ranking, spell


def values(spark, rows, column, ddl="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], ddl).select(column).collect()]



def test_normalize(spark):
    cases = {
        "HTTP://A.Example.org:80//x//y/#f": "http://a.example.org/x/y/",
        "http://a/?": "http://a/",
        "http://a": "http://a",
        "https://A:443/p;q?b=1//2#x": "https://a/p;q?b=1//2",
        "https://a:80/": "https://a:80/",
        "": "",
        "/rel//path#x": "/rel/path",
    }
    assert values(spark, list(cases), urls.normalize(F.col("x"))) == list(cases.values())
    again = values(spark, list(cases.values()), urls.normalize(F.col("x")))
    assert again == list(cases.values())
    assert values(spark, [None], urls.normalize(F.col("x"))) == [None]


def test_url_parts(spark):
    rows = ["http://A.b:8080/x/y/", "ftp://h/", "no url", "https:///x"]
    assert values(spark, rows, urls.domain(F.col("x"))) == ["a.b", "h", "", ""]
    assert values(spark, rows, urls.host(F.col("x"))) == ["a.b:8080", "h", "", ""]
    assert values(spark, rows, urls.is_valid(F.col("x"))) == [True, False, False, False]
    assert values(spark, rows[:1], urls.depth(F.col("x"), F.lit("http://A.b:8080/"))) == [2]
    assert values(spark, rows[:1], urls.depth(F.col("x"), F.lit("http://c/"))) == [-1]


def test_scope(spark):
    scope = Scope(suffixes=(".example.org",), ipv4_ranges=("172.20.0.0/14",))
    rows = ["http://example.org/", "http://a.example.org", "http://badexample.org", "http://172.20.0.0/", "http://172.23.255.255:80/", "http://172.24.0.0", "http://172.20.0.256", "http://172.020.0.1", "x"]
    assert values(spark, rows, urls.in_scope(F.col("x"), scope)) == [True, True, False, True, True, False, False, False, False]


def test_resolve(spark):
    from urllib.parse import urljoin

    base = "http://h.example/a/b?c"
    for href in ["/x", "x/y", "//o/p", "http://q/", "?z", "../up", "./same", "a/../b"]:
        got = values(spark, [(base, href)], F.coalesce(urls.resolve(F.col("b"), F.col("x")), urls.resolve_any(F.col("b"), F.col("x"))), "b string, x string")
        assert got == [urljoin(base, href)]


PAGE = """<html><head><title> A &amp; B </title><meta content="de sc" name='description'><style>p{}</style></head><body>
<h2>Two <b>x</b></h2><h1> One </h1><!-- no --><script>var a = "</p>";</script><p>Text&middot;more <a href="/l?a=1&amp;b=2" title="T"></a>
<a class="k" href='rel'>Go <i>on</i></a><a href="#f">f</a><a href="mailto:x">m</a></body></html>"""


def test_html(spark):
    assert values(spark, [PAGE], html.title(F.col("x"))) == ["A & B"]
    assert values(spark, [PAGE], html.meta(F.col("x"), "description")) == ["de sc"]
    assert values(spark, [PAGE], html.visible_text(F.col("x"))) == ["A & B Two x One Text·more Go on f m"]
    assert values(spark, [PAGE], html.visible_text_lenient(F.col("x"))) == ["A & B Two x One Text·more Go on f m"]
    assert [tuple(h) for h in values(spark, [PAGE], html.headings(F.col("x")))[0]] == [("h1", "One"), ("h2", "Twox")]
    assert [tuple(a) for a in values(spark, [PAGE], html.anchors(F.col("x")))[0]] == [("/l?a=1&b=2", "T"), ("rel", "Go on"), ("#f", "f"), ("mailto:x", "m")]
    assert values(spark, ["", None], html.title(F.col("x"))) == ["", None]


STEMS = {"king": "k", "famous": "famou", "networks": "network", "running": "runn", "routing": "rout", "darkness": "darkness", "registry": "registry", "cat": "cat", "classes": "class", "cities": "citi", "agreed": "agree", "national": "nate", "ipv6": "ipv6"}


def test_stem(spark):
    assert values(spark, list(STEMS), text.stem(F.col("x"))) == list(STEMS.values())


def test_tokenize(spark):
    rows = {"4ever": ["ev"], "café": ["caf"], "IPv6 of the Kings": ["ipv6", "king"], "": [], "互联网路由": ["互联", "联网", "网路", "路由", "互联网", "联网路", "网路由"], "字": [], "因为 网络": ["网络"]}
    assert values(spark, list(rows), text.tokenize(F.col("x"))) == list(rows.values())
    assert values(spark, [None], text.tokenize(F.col("x"))) == [[]]
    assert values(spark, ["Running dogs"], text.tokenize(F.col("x"), stemming=False)) == [["running", "dogs"]]


def test_query_columns(spark):
    q = 'site:a.org "exact words" running Wiki running'
    assert values(spark, [q], query.terms(F.col("x"))) == [["runn", "site", "wiki"]]
    assert values(spark, [q], query.phrases(F.col("x"))) == [["exact words"]]
    assert values(spark, [q, "x"], query.filter_value(F.col("x"), "site")) == ["a.org", None]
    assert values(spark, [q, "sign up now", "why"], query.intent(F.col("x"))) == ["navigational", "transactional", "informational"]
    assert values(spark, ['"only this"', "a"], query.is_valid(F.col("x"))) == [False, False]
    got = spark.createDataFrame([(["routing", "action", "sing", "cats", "walked"],)], "x array<string>").select(query.expand(F.col("x"))).first()[0]
    assert got == sorted({"routing", "rout", "action", "ac", "sing", "cats", "walked", "walk"})


@pytest.mark.parametrize("word", ["", "a", "ab", "word"])
def test_edits1(spark, word):
    splits = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    want = {a + b[1:] for a, b in splits if b} | {a + b[1] + b[0] + b[2:] for a, b in splits if len(b) > 1}
    want |= {a + c + b[1:] for a, b in splits if b for c in spell.LETTERS} | {a + c + b for a, b in splits for c in spell.LETTERS}
    assert set(values(spark, [word], spell.edits1(F.col("x")))[0]) == want


def test_snippet(spark):
    long = "y" * 120 + " Needle " + "z" * 200
    got = values(spark, ["Needle and thread", long], ranking.snippet(F.col("x"), ["needle", "a+b"]))
    assert got[0] == "<em>needle</em> and thread"
    assert got[1].startswith("...") and got[1].endswith("...") and "<em>needle</em>" in got[1]
    assert len(got[1].replace("<em>", "").replace("</em>", "")) == 206


def test_page_window():
    assert ranking.page_window(0, 20, 0) == [1]
    assert ranking.page_window(1000, 20, 200) == list(range(7, 17))
    assert [ranking.clamp(x) for x in (None, 0, 5, 500)] == [20, 20, 5, 100]


def test_resolve_dots(spark):
    bases = ["http://h.example.org", "http://h.example.org/a/b/c.html", "http://h.example.org/a/b/?q=1"]
    hrefs = ["../x", "./x", "..", ".", "../", "./", "../../../x", "/a/../b", "/a/./b/", "x/../y?z=/../w#f", "x//../y", "/..", "a/b/..", "../x/?q", "a/.b/..c/../d..", "?x=/../y"]
    pairs = [(b, h) for b in bases for h in hrefs]
    got = spark.createDataFrame(pairs, "b string, h string").select("b", "h", urls.normalize(urls.resolve_dots(F.col("b"), F.col("h"))).alias("got"), urls.normalize(urls.resolve_any(F.col("b"), F.col("h"))).alias("want")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_links_with_dot_segments(spark):
    from pagelode.sources import pages

    page = '<a href="../up">1</a><a href="./here">2</a><a href="/x/../y">3</a><a href="//o.example.org/a/../b">4</a><a href="plain">5</a>'
    raw = spark.createDataFrame([(1, "http://h.example.org/a/b/c", page)], "page_id bigint, url string, html string")
    want = ["http://h.example.org/a/b/here", "http://h.example.org/a/b/plain", "http://h.example.org/a/up", "http://h.example.org/y", "http://o.example.org/a/../b"]
    assert sorted(r["to_url"] for r in pages.links(raw).collect()) == want


def test_numeric_references_and_unclosed_elements(spark):
    import html as plain

    texts = ["a&#65;b&#x1F600;&#X20ac; &#39;", "&#0;&#xD800;|&#1114112;", "&#;&#x;&#xZ;&#12", "&amp;#65; &#228;&uuml", "none", "&#8364", ""]
    got = values(spark, texts, html.unescape(F.col("x")))
    assert got[0] == plain.unescape(texts[0]) and got[1] == "��|�" and got[2:] == ["&#;&#x;&#xZ;&#12", "&#65; ä&uuml", "none", "&#8364", ""]
    pages = ["<p>one</p><script>var a = '<p>two</p>'", "<p>x</p><style>p {}</style>y<svg><g>z", "<p>a<b>c"]
    assert values(spark, pages, html.visible_text(F.col("x"))) == values(spark, pages, html.visible_text_lenient(F.col("x"))) == ["one", "x y", "a c"]

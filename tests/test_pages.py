"""Pages, candidates and previews."""

import os

import pytest
from pyspark.sql import functions as F

from stallkit.operators import pages as H
from stallkit.plans.core import QUERIES
from stallkit.sources import html as D

SMALL = "/root/testdata/sf0.001"

PAGE = (
    '<html><head><title>Foo</title><meta property="og:title" content="Sony Kamera | eBay.de"><meta property="product:price:amount" content="99.50"><meta property="product:price:currency" content="EUR"></head>'
    '<body><h1>Sony Kamera</h1><span class="price">99,50 €</span><div id="ship">Versand 4,90 €</div></body></html>'
)
NODE = "array<struct<xpath:string,css:string,role:string,text:string,x:double,y:double,width:double,height:double,price:double,currency:string,confidence:double>>"


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id int, url string, html string, selected_selector string")


def test_a_static_page(spark):
    pages = frame(spark, [(1, "https://www.ebay.de/itm/1", PAGE, None)])
    r = H.previews(pages, D.parse_pages(pages)).collect()[0]
    assert (r.host, r.marketplace, r.listing.title, r.listing.search_query, r.requires_selection) == ("www.ebay.de", "Ebay", "Sony Kamera | eBay.de", "Sony Kamera", False)
    assert [tuple(c) for c in r.candidates] == [
        ("html > head:nth-of-type(1) > meta:nth-of-type(2)", "99.50 EUR", 99.5, "EUR", 9, "meta"),
        ("html > body:nth-of-type(1) > span:nth-of-type(1)", "99,50 €", 99.5, "EUR", 8, "markup"),
        ("div#ship", "Versand 4,90 €", 4.9, "EUR", 1, "markup"),
    ]
    assert (r.selected.price, r.selected.source, r.selected.auto) == (99.5, "meta", True)
    assert [(e.id, e.role, e.confidence, e.auto) for e in r.elements] == [("title", "title", 6, False), ("price-2", "price", 9, True), ("price-3", "price", 8, False), ("price-4", "price", 1, False), ("element-5", "heading", 5, False)]
    f = r.suggested_filter
    assert (f.search_term, f.marketplace, f.min_price, f.max_price, f.reference_marketplace, f.reference_currency) == ("Sony Kamera", "all", 0.0, 99.5, "Ebay", "EUR")


def test_summaries_of_pages_that_carry_their_addresses(spark):
    image = '<html><body><img src="/a.png"></body></html>'
    pages = frame(spark, [(1, "https://x.de/i/1", PAGE, None), (2, "https://y.de/", image, None), (3, None, None, None), (None, "https://z.de/", image, None)])
    got = H.summaries(D.parse_pages(pages, keep=["url"]))
    assert sorted(((r.page_id, r.url, r.title, r.image_urls) for r in got.collect()), key=repr) == [
        (1, "https://x.de/i/1", "Sony Kamera | eBay.de", []), (2, "https://y.de/", "", ["https://y.de/a.png"]), (3, None, "", []), (None, "https://z.de/", "", ["https://z.de/a.png"])
    ]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
def test_summaries_of_a_table_send_no_rows_through_the_driver(spark):
    plan = QUERIES["h2_summaries"](spark, SMALL)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "BroadcastExchange" not in plan


def test_odd_pages_have_defined_previews(spark):
    deep = "<body>" + "<div>" * 200 + "5 €" + "</div>" * 200 + "</body>"
    pages = frame(spark, [(1, "https://x.de/", None, None), (2, "https://x.de/", "", ""), (3, None, "<p>a<p>b", "nope"), (4, "https://x.de/", deep, None), (5, "https://x.de/", PAGE, "nope"), (6, "https://x.de/", PAGE, "div#ship")])
    rows = {r.page_id: r for r in H.previews(pages, D.parse_pages(pages)).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6}
    assert rows[1].candidates == [] and rows[1].elements == [] and rows[1].selected is None and not rows[1].requires_selection
    assert len(rows[4].candidates) == 18 and rows[4].requires_selection
    assert rows[5].selected.price == 99.5 and rows[5].selected.auto is False
    assert rows[6].selected.price == 4.9 and rows[6].selected.auto is False


def test_clear_price(spark):
    cases = [([], None), ([(6, 10.0)], None), ([(8, 10.0)], 10.0), ([(10, 10.0), (8, 5.0)], 10.0), ([(9, 10.0), (8, 10.005)], 10.0), ([(9, 10.0), (8, 12.0)], None), ([(9, 10.0), (8, 10.0), (7, 99.0)], 10.0)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c array<struct<confidence:int,price:double>>")
    got = [r.p and r.p.price for r in df.select("i", H.clear_price(F.col("c")).alias("p")).orderBy("i").collect()]
    assert got == [w for _, w in cases]


def test_a_rendered_page(spark):
    node = lambda xpath, css, text, price, currency, confidence: (xpath, css, "price", text, 0.0, 0.0, 1.0, 1.0, price, currency, confidence)
    nodes = [node("/html/a", "div#ship", "Versand", 4.9, " ", 2.5), node("/html/b", "x", "no price", None, None, 9.0), node("/html/c", "y", "20", 20.0, "CHF", 9.5), node("/html/c", "z", "again", 1.0, "EUR", 12.0)]
    pages = spark.createDataFrame([(1, "https://shop.example/p", PAGE, None, None, nodes), (2, "https://shop.example/p", PAGE, "div#ship", ["/html/c", "/html/c", "span", " "], nodes)], f"page_id int, url string, html string, selected_selector string, additional_selectors array<string>, nodes {NODE}")
    rows = {r.page_id: r for r in H.rendered_previews(pages, D.parse_pages(pages)).collect()}
    assert [(c.selector, c.confidence, c.source) for c in rows[1].candidates][0] == ("/html/c", 10, "render")
    assert [c.currency for c in rows[1].candidates if c.selector == "/html/a"] == ["EUR"]
    assert rows[1].selected is None and rows[1].requires_selection
    s = rows[2].selected
    assert (s.price, s.text, s.source, s.auto) == (44.9, "Versand 4,90 € + 20 + 20", "summed", False)
    assert rows[2].primary_path == "/html/a"


def test_sandbox():
    text = '<html><body onload="x()"><form action="/buy"><input name="a" onclick="y()"><script>evil()</script><p>T &amp; U</p></form></body></html>'
    out = D.sandboxed(text, "https://shop.example:8080/p?q=1")
    assert "evil" not in out and "onload" not in out and "onclick" not in out
    assert 'action="javascript:void(0)"' in out and "T &amp; U" in out
    assert out.startswith('<html><head><style id="banner-strip">') and '<base href="https://shop.example:8080/" />' in out
    assert D.sandboxed("  ", "https://x") is None and D.sandboxed(None, None) is None


@pytest.mark.parametrize(("text", "tag", "want"), [("<ul><li>a<li>b</ul>", "li", ["a", "b"]), ("<p>a<div>b</div>", "p", ["a"]), ("<div><script>x</script>y<svg><g>z</g></svg></div>", "div", ["y"]), ("<p>&euro; &amp;euro; 5&nbsp;</p>", "p", ["€ € 5"])])
def test_the_tree(text, tag, want):
    root = D.parse(text)
    texts = D.inner_texts(root)
    assert [texts[id(e)] for e in root.elements() if e.tag == tag] == want

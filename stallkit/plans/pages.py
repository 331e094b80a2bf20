"""Previews of listing pages. The pages are made of the listings table: a title, metas, a price, images and the description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallkit.operators import pages as H
from stallkit.plans.registry import query
from stallkit.plans.scalars import price_sql, text_sql
from stallkit.sources import html as D
from stallkit.sources.tables import table

_LISTINGS = "(SELECT DISTINCT ON (id) * FROM listings ORDER BY id, found_at)"


def _escaped(c: str) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, url, html, selected_selector`` of every listing."""
    rows = table(spark, folder, "listings").dropDuplicates(["id"])
    price = F.coalesce(F.format_string("%.2f", "price"), F.lit(""))
    images = F.array_join(F.transform(F.coalesce("image_urls", F.array().cast("array<string>")), lambda u: F.concat(F.lit('<img src="'), u, F.lit('">'))), "")
    parts = [
        F.lit("<html><head><title>Page</title><script>var a = '<b>';</script>"), F.lit('<meta property="og:title" content="'), _escaped("title"), F.lit('"><meta name="description" content="'), _escaped("description"),
        F.lit('"><meta property="product:price:amount" content="'), price, F.lit('"></head><body><h1>'), _escaped("title"), F.lit('</h1><span class="price">'), F.when(price != "", F.concat(F.regexp_replace(price, r"\.", ","), F.lit(" €"))).otherwise(""),
        F.lit('</span><div id="x">a<style>b</style>c</div>'), images, F.lit("<p>"), _escaped("description"), F.lit("</p></body></html>"),
    ]
    host = F.element_at(F.array(*[F.lit(h) for h in ("www.ebay.de", "m.vinted.fr", "shop.example")]), (F.coalesce("platform", F.lit(0)) % 3 + 1).cast("int"))
    return rows.select(F.col("id").alias("page_id"), F.concat(F.lit("https://"), host, F.lit("/item/"), "id").alias("url"), F.concat(*parts).alias("html"), F.when(F.col("platform") == 2, "div#x").alias("selected_selector"))


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return D.parse_pages(_pages(spark, folder))


@query(f"""
    SELECT id AS page_id, tag, text FROM (SELECT id, 'h1' AS tag, {text_sql("title")} AS text FROM {_LISTINGS} UNION ALL SELECT id, 'p', {text_sql("description")} FROM {_LISTINGS})
    WHERE text <> '' AND length(text) <= 220""")
def s5_page_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Headings and paragraphs of every page."""
    nodes = _parsed(spark, folder).select("page_id", F.explode("nodes").alias("n")).filter(F.col("n.tag").isin("h1", "p"))
    return nodes.select("page_id", "n.tag", "n.text")


@query(f"SELECT id AS page_id, 'ac' AS text FROM {_LISTINGS}")
def s6_texts_without_noise(spark: SparkSession, folder: str) -> DataFrame:
    """The text of an element with a style sheet inside."""
    return _parsed(spark, folder).select("page_id", F.explode("nodes").alias("n")).filter("n.id = 'x'").select("page_id", "n.text")


@query(f"SELECT id AS page_id, {text_sql('title')} AS content FROM {_LISTINGS}")
def h1_meta_contents(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).select("page_id", H.meta_content(F.col("metas"), "OG:title").alias("content"))


@query(f"SELECT id AS page_id, coalesce(nullif({text_sql('title')}, ''), 'Page') AS title, {text_sql('description')} AS description, coalesce(array_to_string(image_urls[1:6], '|'), '') AS images FROM {_LISTINGS}")
def h2_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Title, description and images of every page."""
    return H.summaries(D.parse_pages(_pages(spark, folder), keep=["url"])).select("page_id", "title", "description", F.array_join("image_urls", "|").alias("images"))


@query(f"SELECT id AS page_id, len(image_urls[1:6])::INT AS n, image_urls[1] AS first FROM {_LISTINGS} WHERE len(image_urls) > 0")
def h3_images(spark: SparkSession, folder: str) -> DataFrame:
    pages = _pages(spark, folder)
    images = H.summaries(D.parse_pages(pages), pages).filter(F.size("image_urls") > 0)
    return images.select("page_id", F.size("image_urls").alias("n"), F.get("image_urls", F.lit(0)).alias("first"))


@query("SELECT id AS page_id, amount AS price, currency FROM (" + price_sql("t", True, f"(SELECT id, found_at, 'EUR ' || printf('%.2f', price) AS t FROM {_LISTINGS})") + ") WHERE amount IS NOT NULL")
def h5_meta_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Prices that the metas of pages state, as they are read."""
    return H.price_candidates(_parsed(spark, folder)).filter("source = 'meta'").select("page_id", "price", "currency")


@query("SELECT id AS page_id, amount AS price, currency, 8 AS confidence FROM (" + price_sql("t", True, f"(SELECT id, found_at, replace(printf('%.2f', price), '.', ',') || ' €' AS t FROM {_LISTINGS})") + ") WHERE amount IS NOT NULL")
def h7_marked_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Prices in elements whose names speak of a price, and how sure they are."""
    rows = H.price_candidates(_parsed(spark, folder)).filter("source = 'markup' and selector like '%span:nth-of-type(1)'")
    return rows.select("page_id", "price", "currency", "confidence")


_WORDS = "['', 'shipping', 'ab ', 'from vat', 'Preis']"


@query(f"""
    SELECT product_seo_id, listing_id, found_at, sum(CASE WHEN regexp_matches(t, '(?i)€|EUR|CHF|GBP') OR currency <> 'EUR' THEN 4 ELSE 1 END + CASE WHEN platform % 2 = 0 THEN 4 ELSE 0 END
        - CASE WHEN regexp_matches(lower(t), 'shipping|versand|liefer|vat|mwst') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(t), 'from|ab |starting') THEN 1 ELSE 0 END)::BIGINT AS score
    FROM (SELECT *, {_WORDS}[platform % 5 + 1] || ' ' || price || ' €' AS t FROM product_listings WHERE price IS NOT NULL AND currency IS NOT NULL) GROUP BY ALL""")
def h9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """How sure a text made of every product listing states its price."""
    words = F.element_at(F.array(*[F.lit(w) for w in ("", "shipping", "ab ", "from vat", "Preis")]), F.col("platform") % 5 + 1)
    rows = table(spark, folder, "product_listings").filter("price is not null and currency is not null").withColumn("t", F.concat_ws(" ", words, "price", F.lit("€")))
    names = F.struct(F.lit("span").alias("tag"), F.lit("").alias("id"), F.when(F.col("platform") % 2 == 0, "Preis").otherwise("x").alias("class"), *[F.lit("").alias(n) for n in ("itemprop", "testid", "label")])
    s = H.score(F.col("t"), F.col("currency"), H.price_like(names), F.lit(""))
    return rows.groupBy("product_seo_id", "listing_id", "found_at").agg(F.sum(s).alias("score"))


_CANDIDATES = """SELECT product_seo_id AS page_id, row_number() OVER (PARTITION BY product_seo_id ORDER BY found_at, listing_id) AS ord, listing_id AS selector, coalesce(title, '') AS text, price, currency, platform % 11 AS confidence
    FROM product_listings WHERE price > 0"""
_RANKED = f"""SELECT page_id, selector, text, price, confidence, place FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, price, ord)::INT AS place FROM (
    SELECT page_id, selector, price, text, max(confidence) AS confidence, min(ord) AS ord FROM ({_CANDIDATES}) GROUP BY ALL)) WHERE place <= 18"""


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    ord_ = F.row_number().over(Window.partitionBy("product_seo_id").orderBy("found_at", "listing_id"))
    rows = table(spark, folder, "product_listings").filter("price > 0").select(
        F.col("product_seo_id").alias("page_id"), ord_.alias("ord"), F.col("listing_id").alias("selector"), F.coalesce("title", F.lit("")).alias("text"), "price", "currency", (F.col("platform") % 11).alias("confidence"), F.lit("markup").alias("source"))
    return H.ranked_candidates(rows)


@query(_RANKED)
def h10_ranked_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The surest candidates of every page; product listings stand for candidates."""
    return _ranked(spark, folder).select("page_id", "selector", "text", "price", "confidence", "place")


@query(f"""
    WITH l AS (SELECT page_id, list({{'c': confidence, 'p': price, 's': selector}} ORDER BY place) AS x FROM ({_RANKED}) GROUP BY 1)
    SELECT page_id, CASE WHEN x[1].c >= 7 AND (len(x) = 1 OR x[1].c >= x[2].c + 2 OR (len(list_filter(x, lambda y: y.c >= x[1].c - 1)) > 1 AND len(list_filter(x, lambda y: y.c >= x[1].c - 1 AND NOT abs(y.p - x[1].p) < 0.01)) = 0))
        THEN x[1].s END AS selector FROM l""")
def h12_clear_prices(spark: SparkSession, folder: str) -> DataFrame:
    """The candidate that is a page's price without doubt."""
    lists = H.candidate_lists(_ranked(spark, folder))
    return lists.select("page_id", H.clear_price(F.col("candidates"))["selector"].alias("selector"))


@query(f"""
    WITH l AS (SELECT page_id, list({{'c': confidence, 'p': price, 's': selector}} ORDER BY place) AS x FROM ({_RANKED}) GROUP BY 1)
    SELECT page_id, x[2].s AS wanted, CASE WHEN len(x) > 1 THEN x[2].s WHEN x[1].c >= 7 THEN x[1].s END AS selector, CASE WHEN len(x) > 1 THEN false WHEN x[1].c >= 7 THEN true END AS auto FROM l""")
def h11_selected_prices(spark: SparkSession, folder: str) -> DataFrame:
    """The candidate asked for, here the second, else the clear one."""
    lists = H.candidate_lists(_ranked(spark, folder)).withColumn("wanted", F.get("candidates", F.lit(1))["selector"])
    one = H.selected_price(F.col("candidates"), F.col("wanted"))
    return lists.select("page_id", "wanted", one["selector"].alias("selector"), one["auto"].alias("auto"))


@query(f"""
    WITH l AS (SELECT page_id, list({{'c': confidence, 'p': price, 's': selector}} ORDER BY place) AS x FROM ({_RANKED}) GROUP BY 1)
    SELECT page_id, round_even((x[1].p + 2 * coalesce(list_filter(x, lambda y: y.s = x[2].s)[1].p, 0)) * 100, 0)::DOUBLE / 100 AS price FROM l""")
def h21_summed_prices(spark: SparkSession, folder: str) -> DataFrame:
    """The first candidate with the second added twice."""
    lists = H.candidate_lists(_ranked(spark, folder))
    first, second = F.get("candidates", F.lit(0)), F.get("candidates", F.lit(1))["selector"]
    one = H.selected_price(F.col("candidates"), first["selector"])
    none = F.array().cast("array<struct<xpath:string,text:string,price:double>>")
    return lists.select("page_id", H.summed_price(one, F.col("candidates"), F.array(second, second), none)["price"].alias("price"))


def _shown(previews: DataFrame) -> DataFrame:
    return previews.select("page_id", "marketplace", F.size("candidates").alias("n_candidates"), F.size("elements").alias("n_elements"), "selected.price", "selected.auto", "requires_selection", "suggested_filter.search_term", "suggested_filter.max_price")


@query()
def h13_preview_elements(spark: SparkSession, folder: str) -> DataFrame:
    """The numbered elements of every page's preview."""
    pages = _pages(spark, folder)
    rows = H.previews(pages, D.parse_pages(pages)).select("page_id", F.explode("elements").alias("e"))
    return rows.select("page_id", "e.id", "e.selector", "e.role", "e.text", "e.price", "e.confidence", "e.candidate", "e.auto")


@query(f"SELECT id AS page_id, 'div#x' AS selector FROM {_LISTINGS}")
def h17_selectors(spark: SparkSession, folder: str) -> DataFrame:
    """The selector of an element with an id."""
    return _parsed(spark, folder).select("page_id", F.explode("nodes").alias("n")).filter("n.id = 'x'").select("page_id", "n.selector")


@query()
def h19_previews(spark: SparkSession, folder: str) -> DataFrame:
    """The preview of every listing's page."""
    pages = _pages(spark, folder)
    return _shown(H.previews(pages, D.parse_pages(pages)))


@query()
def h20_rendered_previews(spark: SparkSession, folder: str) -> DataFrame:
    """The preview of every listing's page as a browser rendered it, with one node more and an extra price."""
    node = F.struct(F.lit("/html/body/b").alias("xpath"), F.lit("div#x").alias("css"), F.lit("price").alias("role"), F.lit("5 EUR").alias("text"), *[F.lit(1.0).alias(k) for k in ("x", "y", "width", "height")], F.lit(5.0).alias("price"), F.lit("").alias("currency"), F.lit(6.5).alias("confidence"))
    pages = _pages(spark, folder).withColumn("nodes", F.array(node)).withColumn("additional_selectors", F.array(F.lit("/html/body/b")))
    done = H.rendered_previews(pages, D.parse_pages(pages))
    return _shown(done).join(done.select("page_id", "primary_path"), "page_id")


@query()
def h23_sandboxed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every listing's page made safe to be shown apart from its site."""
    return D.sandbox_pages(_pages(spark, folder)).select("page_id", F.length("sandbox_html").alias("length"), F.col("sandbox_html").contains("<script").alias("scripts"))


@query("SELECT id AS page_id, array_to_string(list_filter(image_urls, lambda u: trim(u) <> ''), '|') AS images FROM listings WHERE image_urls IS NOT NULL")
def h4_distinct_images(spark: SparkSession, folder: str) -> DataFrame:
    """Every listing's images, named again in capitals and with a blank: each comes once."""
    rows = table(spark, folder, "listings").filter("image_urls is not null")
    twice = F.concat("image_urls", F.array(F.lit(" ")), F.transform("image_urls", lambda u: F.upper(u)))
    return rows.select(F.col("id").alias("page_id"), F.array_join(H.distinct_images(twice), "|").alias("images"))


@query("SELECT id AS page_id, found_at, regexp_matches(concat_ws(' ', 'span', locality, title, '', description_short, description), '(?i)price|preis|amount|currentbid|buyitnow') AS price_like FROM listings")
def h8_price_like(spark: SparkSession, folder: str) -> DataFrame:
    """Whether names, here a listing's texts, speak of a price."""
    names = F.struct(F.lit("span").alias("tag"), F.col("locality").alias("id"), F.col("title").alias("class"), F.lit("").alias("itemprop"), F.col("description_short").alias("testid"), F.col("description").alias("label"))
    return table(spark, folder, "listings").select(F.col("id").alias("page_id"), "found_at", H.price_like(names).alias("price_like"))


@query(f"""
    SELECT id AS page_id, tag, text FROM (SELECT id, 'h1' AS tag, {text_sql("title")} AS text FROM {_LISTINGS} UNION ALL SELECT id, 'p', {text_sql("description")} FROM {_LISTINGS})
    WHERE length(text) BETWEEN 3 AND 220""")
def h15_shown_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of every page that its preview may show."""
    nodes = _parsed(spark, folder).select("page_id", F.explode("nodes").alias("n")).filter("n.shown and length(n.text) between 3 and 220")
    return nodes.select("page_id", "n.tag", "n.text")


_CLEAR = f"""WITH l AS (SELECT page_id, list({{'c': confidence, 'p': price, 's': selector}} ORDER BY place) AS x FROM ({_RANKED}) GROUP BY 1),
    k AS (SELECT page_id, x, x[1].c >= 7 AND (len(x) = 1 OR x[1].c >= x[2].c + 2 OR (len(list_filter(x, lambda y: y.c >= x[1].c - 1)) > 1 AND len(list_filter(x, lambda y: y.c >= x[1].c - 1 AND NOT abs(y.p - x[1].p) < 0.01)) = 0)) AS clear FROM l)"""


@query(_CLEAR + " SELECT page_id, CASE WHEN clear THEN len(list_filter(x, lambda y: y.s = x[1].s)) ELSE 0 END::INT AS n_auto FROM k")
def h16_marked_elements(spark: SparkSession, folder: str) -> DataFrame:
    """How many of a page's elements are those of the price that was chosen unasked."""
    lists = H.candidate_lists(_ranked(spark, folder)).withColumn("chosen", H.selected_price(F.col("candidates"), F.lit(None).cast("string")))
    return lists.select("page_id", F.size(F.filter(H.marked(F.col("candidates"), F.col("candidates"), F.col("chosen")), lambda e: e["auto"])).alias("n_auto"))


@query(_CLEAR + " SELECT page_id, page_id AS search_term, 'Ebay' AS reference_marketplace, 'all' AS marketplace, 0.0::DOUBLE AS min_price, CASE WHEN clear THEN x[1].p END AS max_price, CASE WHEN clear THEN x[1].s END AS reference_selector FROM k")
def h18_suggested_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The search to suggest for every page."""
    lists = H.candidate_lists(_ranked(spark, folder)).withColumn("chosen", H.selected_price(F.col("candidates"), F.lit(None).cast("string")))
    f = H.suggested_filter(F.lit("https://www.ebay.de/"), F.lit("www.ebay.de"), F.col("page_id"), F.col("page_id"), F.col("chosen"))
    return lists.select("page_id", f.alias("f")).select("page_id", "f.search_term", "f.reference_marketplace", "f.marketplace", "f.min_price", "f.max_price", "f.reference_selector")


@query(_CLEAR + " SELECT page_id, CASE WHEN x[1].s LIKE '/%' THEN x[1].s WHEN x[2].s = x[1].s THEN '/x/1' ELSE '/x/2' END AS path FROM k")
def h22_primary_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The path of every page's first candidate among rendered nodes."""
    lists = H.candidate_lists(_ranked(spark, folder))
    css = lambda i: F.coalesce(F.get("candidates", F.lit(i))["selector"], F.lit(""))
    nodes = F.array(F.struct(F.lit("/x/1").alias("xpath"), css(1).alias("css")), F.struct(F.lit("/x/2").alias("xpath"), css(0).alias("css")))
    return lists.select("page_id", H.primary_path(F.get("candidates", F.lit(0)), nodes).alias("path"))

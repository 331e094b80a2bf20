"""Reference prices and previews of listing pages, as columns over parsed pages.

A page's candidates are rows with their place in the document, so every order has a tie-break; equal selectors keep the
first. Pages are told apart by ``page_id``; all work after parsing groups by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallkit.functions.links import marketplace, resolved_urls, url_host
from stallkit.functions.price_text import names_currency, price_in
from stallkit.functions.text import first_non_empty, is_blank, search_query
from stallkit.session import Workspace

#: How many are kept, and the least sure price that is taken unasked. Fixed values.
IMAGES, STATIC_CANDIDATES, RENDERED_CANDIDATES, PREVIEW = 6, 18, 64, 48
SURE, LEAD, NEAR = 7, 2, 0.01
CANDIDATE = "array<struct<selector:string,text:string,price:double,currency:string,confidence:int,source:string>>"


def meta_content(metas: Column, name: str) -> Column:
    """Content of the first meta element whose property, name or itemprop is ``name``, or ``""``."""
    low = name.lower()
    fits = F.filter(metas, lambda m: (F.lower(m["property"]) == low) | (F.lower(m["name"]) == low) | (F.lower(m["itemprop"]) == low))
    return F.coalesce(F.get(fits, F.lit(0))["content"], F.lit(""))


def distinct_images(urls: Column) -> Column:
    """Addresses without blanks; of those that differ by case only the first stays."""
    return F.aggregate(urls, F.array().cast("array<string>"), lambda acc, x: F.when((F.trim(x) == "") | F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def summaries(parsed: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``page_id, url, title, description, image_urls, search_query`` of every page.

    The addresses are those that ``parsed`` carries along, else those of ``pages``. Carried along they need no join, which
    a planner that thinks the addresses few sends through the driver.
    """
    both = parsed if pages is None else parsed.join(pages.select("page_id", "url"), "page_id")
    metas = F.col("metas")
    both = both.withColumn("title", first_non_empty(meta_content(metas, "og:title"), meta_content(metas, "twitter:title"), F.col("h1"), F.col("title")))
    both = both.withColumn("description", first_non_empty(meta_content(metas, "og:description"), meta_content(metas, "description")))
    found = F.filter(F.concat(F.array(meta_content(metas, "og:image"), meta_content(metas, "twitter:image")), "images"), lambda x: F.trim(x) != "")
    kept = F.filter(resolved_urls(F.col("url"), found), lambda x: F.trim(x) != "")
    seen = distinct_images(kept)
    query = F.when(is_blank(search_query(F.col("title"))), search_query(F.col("description"))).otherwise(search_query(F.col("title")))
    return both.select("page_id", "url", "title", "description", F.slice(seen, 1, IMAGES).alias("image_urls"), query.alias("search_query"))


def price_like(n: Column) -> Column:
    """Whether an element's names speak of a price."""
    names = F.concat_ws(" ", n["tag"], n["id"], n["class"], n["itemprop"], n["testid"], n["label"])
    return names.rlike("(?i)price|preis|amount|currentbid|buyitnow")


def score(text: Column, currency: Column, like: Column, itemprop: Column) -> Column:
    """How sure an element's text states the price."""
    low = F.lower(text)
    return (
        F.when(names_currency(text) | (currency != "EUR"), 4).otherwise(1)
        + F.when(like, 4).otherwise(0)
        - F.when(low.rlike("shipping|versand|liefer|vat|mwst"), 3).otherwise(0)
        + F.when(low.rlike("from|ab |starting"), 1).otherwise(0)
        + F.when(itemprop.rlike("(?i)price"), 3).otherwise(0)
    )


def price_candidates(parsed: DataFrame) -> DataFrame:
    """``page_id, ord, selector, text, price, currency, confidence, source``: what may be the price of a page.

    Meta elements that speak of a price, then elements of the body in document order.
    """
    told = first_non_empty(meta_content(F.col("metas"), "product:price:currency"), meta_content(F.col("metas"), "og:price:currency"), F.lit("EUR"))
    metas = parsed.select("page_id", told.alias("told"), F.posexplode("metas").alias("ord", "m"))
    metas = metas.filter(F.concat_ws(" ", "m.property", "m.name", "m.itemprop").rlike("(?i)price") & ~is_blank(F.col("m.content")) & (F.lower("m.content") != F.lower("told")))
    metas = metas.withColumn("p", price_in(F.concat_ws(" ", "told", "m.content"), True)).filter("p is not null")
    head = metas.select("page_id", (F.col("ord") - (1 << 30)).alias("ord"), "m.selector", F.trim(F.concat_ws(" ", "m.content", "told")).alias("text"), F.col("p.amount").alias("price"), "p.currency", F.lit(9).alias("confidence"), F.lit("meta").alias("source"))
    nodes = parsed.select("page_id", F.explode("nodes").alias("n")).filter("n.in_body and length(n.text) <= 180").withColumn("like", price_like(F.col("n")))
    nodes = nodes.filter((F.col("like") | names_currency(F.col("n.text"))) & (F.col("like") | (F.col("n.children") <= 5)))
    nodes = nodes.withColumn("p", price_in(F.col("n.text"), F.col("like"))).filter("p is not null")
    nodes = nodes.withColumn("confidence", score(F.col("n.text"), F.col("p.currency"), F.col("like"), F.col("n.itemprop"))).filter("confidence > 0")
    body = nodes.select("page_id", "n.ord", "n.selector", "n.text", F.col("p.amount").alias("price"), "p.currency", "confidence", F.lit("markup").alias("source"))
    return head.unionByName(body)


def _first_places(rows: DataFrame, limit: int) -> DataFrame:
    """The surest of every page with their ``place`` from 1, dearer ones later, then by document order."""
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("confidence"), "price", "ord"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit)


def ranked_candidates(candidates: DataFrame, limit: int = STATIC_CANDIDATES) -> DataFrame:
    """Of equal selector, price and text the surest, then the surest ``limit`` of every page, with ``place``."""
    best = candidates.groupBy("page_id", "selector", "price", "text").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("ord").alias("o"), "currency", "source")).alias("b"), F.min("ord").alias("ord"))
    return _first_places(best.select("page_id", "ord", "selector", "text", "price", "b.currency", (-F.col("b.c")).cast("int").alias("confidence"), "b.source"), limit)


def merged_candidates(ranked: DataFrame, render_nodes: DataFrame) -> DataFrame:
    """``ranked`` with the priced nodes of a rendered page whose path is no selector yet, the surest of all.

    ``render_nodes`` have page_id, pos, xpath, css, text, price, currency, confidence. A half confidence rounds to the even.
    """
    priced = render_nodes.filter(F.col("price").isNotNull() & ~is_blank(F.col("xpath")))
    own = priced.groupBy("page_id", "xpath").agg(F.min_by(F.struct("pos", "text", "price", "currency", "confidence"), "pos").alias("n"))
    own = own.join(ranked.select("page_id", F.col("selector").alias("xpath")).distinct(), ["page_id", "xpath"], "left_anti")
    more = own.select("page_id", (F.col("n.pos") + (1 << 30)).alias("ord"), F.col("xpath").alias("selector"), "n.text", "n.price", F.when(is_blank(F.col("n.currency")), "EUR").otherwise(F.col("n.currency")).alias("currency"), F.bround("n.confidence").cast("int").alias("confidence"), F.lit("render").alias("source"))
    # Ranked ones come first among equals, in the order they were ranked.
    return _first_places(ranked.withColumn("ord", F.col("place")).drop("place").unionByName(more), RENDERED_CANDIDATES)


def candidate_lists(ranked: DataFrame) -> DataFrame:
    """``page_id, candidates``: the ranked candidates of every page that has any, as an array in order."""
    fields = ("selector", "text", "price", "currency", "confidence", "source")
    rows = ranked.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("place", *fields))).alias("c"))
    return rows.select("page_id", F.transform("c", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("candidates"))


def clear_price(candidates: Column) -> Column:
    """The candidate that is the price without doubt: sure, and alone, ahead, or one of several as sure that agree."""
    best = F.get(candidates, F.lit(0))
    lead = F.filter(candidates, lambda c: c["confidence"] >= best["confidence"] - 1)
    ahead = (F.size(candidates) == 1) | (best["confidence"] >= F.get(candidates, F.lit(1))["confidence"] + LEAD)
    agree = (F.size(lead) > 1) & F.forall(lead, lambda c: F.abs(c["price"] - best["price"]) < NEAR)
    return F.when((F.size(candidates) > 0) & (best["confidence"] >= SURE) & (ahead | agree), best)


def selected_price(candidates: Column, wanted: Column) -> Column:
    """The candidate of a selector asked for, else the clear one; ``auto`` tells that none was asked for."""
    asked = F.when(~is_blank(wanted), F.get(F.filter(candidates, lambda c: c["selector"] == wanted), F.lit(0)))
    one = F.coalesce(asked, clear_price(candidates))
    return F.when(one.isNotNull(), one.withField("auto", is_blank(wanted)))


def summed_price(selected: Column, candidates: Column, extras: Column, nodes: Column) -> Column:
    """``selected`` with the prices of further selectors added: candidates, else nodes by path. A repeated selector counts again.

    ``nodes`` is an array of structs with xpath, text and price.
    """
    asked = F.filter(extras, lambda x: ~is_blank(x))
    node = lambda x: F.get(F.filter(nodes, lambda n: (n["xpath"] == x) & n["price"].isNotNull()), F.lit(0))
    hit = lambda x: F.coalesce(F.get(F.transform(F.filter(candidates, lambda c: c["selector"] == x), lambda c: F.struct(c["text"].alias("text"), c["price"].alias("price"))), F.lit(0)), F.when(node(x).isNotNull(), F.struct(node(x)["text"].alias("text"), node(x)["price"].alias("price"))))
    found = F.filter(F.transform(asked, hit), lambda x: x.isNotNull())
    total = F.aggregate(found, selected["price"], lambda acc, x: acc + x["price"])
    text = F.array_join(F.concat(F.array(selected["text"]), F.transform(found, lambda x: x["text"])), " + ")
    summed = selected.withField("price", F.bround(total * 100, 0) / 100).withField("text", text).withField("source", F.lit("summed")).withField("auto", F.lit(False))
    return F.when(selected.isNotNull() & (F.coalesce(F.size(extras), F.lit(0)) > 0), summed).otherwise(selected)


def primary_path(selected: Column, nodes: Column) -> Column:
    """Path of the selected element: the selector if it is one, else that of the first node with it."""
    found = F.get(F.filter(nodes, lambda n: n["css"] == selected["selector"]), F.lit(0))["xpath"]
    return F.when(selected["selector"].startswith("/"), selected["selector"]).otherwise(found)


def preview_elements(parsed: DataFrame, summary: DataFrame, lists: DataFrame) -> DataFrame:
    """``page_id, elements``: title, description, prices and texts of a page, each once, numbered as they come."""
    schema = "array<struct<ord:bigint,name:string,selector:string,role:string,text:string,price:double,currency:string,confidence:int,candidate:boolean>>"
    none = F.lit(None)
    made = lambda ord_, name, selector, role, text, price, currency, confidence, candidate: F.struct(
        ord_.cast("bigint").alias("ord"), F.lit(name).alias("name"), selector.alias("selector"), role.alias("role"), text.alias("text"), price.cast("double").alias("price"), currency.cast("string").alias("currency"), confidence.cast("int").alias("confidence"), candidate.alias("candidate"))
    pages = parsed.select("page_id", "nodes").join(summary.select("page_id", "title", "description"), "page_id").join(lists, "page_id", "left")
    found = F.coalesce("candidates", F.array().cast(CANDIDATE))
    head = F.array(
        made(F.lit(0), "title", F.lit("title"), F.lit("title"), F.col("title"), none, none, F.lit(6), F.lit(False)),
        made(F.lit(1), "description", F.lit("meta[name='description']"), F.lit("description"), F.col("description"), none, none, F.lit(3), F.lit(False)),
    )
    prices = F.transform(found, lambda c, i: made(i + 2, "price", c["selector"], F.lit("price"), c["text"], c["price"], c["currency"], c["confidence"], F.lit(True)))
    own = lambda n: F.get(F.filter(found, lambda c: F.lower(c["selector"]) == F.lower(n["selector"])), F.lit(0))
    role = lambda n: F.when(n["tag"].startswith("h"), "heading").otherwise("text")
    texts = F.transform(
        F.filter("nodes", lambda n: n["shown"] & F.length(n["text"]).between(3, 220)),
        lambda n: made(n["ord"] + (1 << 20), "element", n["selector"], F.when(own(n).isNotNull(), "price").otherwise(role(n)), n["text"], own(n)["price"], own(n)["currency"], F.coalesce(own(n)["confidence"], F.when(n["tag"].startswith("h"), 5).otherwise(1)), own(n).isNotNull()),
    )
    rows = pages.select("page_id", F.explode(F.concat(head.cast(schema), prices.cast(schema), texts.cast(schema))).alias("e")).select("page_id", "e.*").filter(~is_blank(F.col("text")))
    first = rows.withColumn("_key", F.lower(F.concat_ws("|", "selector", "text"))).groupBy("page_id", "_key").agg(F.min(F.struct("ord", "name", "selector", "role", "text", "price", "currency", "confidence", "candidate")).alias("e"))
    at = F.row_number().over(Window.partitionBy("page_id").orderBy("e.ord"))
    placed = first.withColumn("at", at).filter(F.col("at") <= PREVIEW)
    name = F.when(F.col("e.name").isin("title", "description"), F.col("e.name")).otherwise(F.concat_ws("-", "e.name", "at"))
    fields = ("selector", "role", "text", "price", "currency", "confidence", "candidate")
    out = placed.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", name.alias("id"), *[F.col(f"e.{f}").alias(f) for f in fields]))).alias("x"))
    return out.select("page_id", F.transform("x", lambda e: F.struct(e["id"].alias("id"), *[e[f].alias(f) for f in fields])).alias("elements"))


def marked(elements: Column, candidates: Column, selected: Column) -> Column:
    """Elements with ``auto``: that of the selected candidate where the selector is its own, false elsewhere."""
    own = lambda e: F.coalesce((e["selector"] == selected["selector"]) & selected["auto"], F.lit(False))
    return F.transform(elements, lambda e: e.withField("auto", own(e)))


def suggested_filter(url: Column, host: Column, query: Column, title: Column, selected: Column) -> Column:
    """The search to suggest for a page: its product on all marketplaces up to its price."""
    return F.struct(
        query.alias("search_term"), F.lit("all").alias("marketplace"), F.lit(0.0).alias("min_price"), selected["price"].alias("max_price"), url.alias("reference_url"), title.alias("reference_title"),
        marketplace(host).alias("reference_marketplace"), selected["price"].alias("reference_price"), selected["currency"].alias("reference_currency"), selected["selector"].alias("reference_selector"),
    )


def _response(pages: DataFrame, parsed: DataFrame, lists: DataFrame, selected: Column, extra: list[Column]) -> DataFrame:
    summary = summaries(parsed, pages)
    asked = pages.select("page_id", *[c for c in ("selected_selector", "additional_selectors", "nodes") if c in pages.columns])
    rows = summary.join(asked, "page_id").join(lists, "page_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(CANDIDATE))).withColumn("selected", selected)
    rows = rows.join(preview_elements(parsed, summary, lists), "page_id", "left").withColumn("host", url_host(F.col("url")))
    auto = F.coalesce(F.col("elements"), F.array().cast("array<struct<id:string,selector:string,role:string,text:string,price:double,currency:string,confidence:int,candidate:boolean>>"))
    return rows.select(
        "page_id", "url", "host", marketplace(F.col("host")).alias("marketplace"), F.struct("title", "description", "image_urls", "search_query").alias("listing"), "candidates",
        marked(auto, F.col("candidates"), F.col("selected")).alias("elements"), "selected", (F.col("selected").isNull() & (F.size("candidates") > 0)).alias("requires_selection"),
        suggested_filter(F.col("url"), F.col("host"), F.col("search_query"), F.col("title"), F.col("selected")).alias("suggested_filter"), *extra,
    )


def previews(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """The preview of every static page. ``pages`` have page_id, url and selected_selector; ``parsed`` is of the same pages."""
    parsed = Workspace(pages.sparkSession, "pages").cut(parsed, "parsed")
    lists = candidate_lists(ranked_candidates(price_candidates(parsed)))
    return _response(pages, parsed, lists, selected_price(F.col("candidates"), F.col("selected_selector")), [])


def rendered_previews(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """The preview of every rendered page. ``pages`` have also additional_selectors and nodes, the rendered nodes."""
    parsed = Workspace(pages.sparkSession, "pages").cut(parsed, "parsed")
    nodes = pages.select("page_id", F.posexplode("nodes").alias("pos", "n")).select("page_id", "pos", "n.*")
    lists = candidate_lists(merged_candidates(ranked_candidates(price_candidates(parsed)), nodes))
    one = selected_price(F.col("candidates"), F.col("selected_selector"))
    return _response(pages, parsed, lists, summed_price(one, F.col("candidates"), F.col("additional_selectors"), F.col("nodes")), [primary_path(F.col("selected"), F.col("nodes")).alias("primary_path")])

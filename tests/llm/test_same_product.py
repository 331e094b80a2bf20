"""Listings of the same product."""

import pytest
from pyspark.sql import functions as F

from stallkit.llm.queries import QUERIES
from stallkit.llm import same_product as sp
from stallkit.llm.same_product import classes, measures, same_product
from stallkit.session import Workspace, local_session


@pytest.fixture(scope="module")
def spark():
    return local_session(cores="2", shuffle_partitions=2)


def test_measures_agree_after_conversion():
    assert measures('22" monitor')["mm"] == measures("55,9 cm")["mm"] == {559}
    assert measures("0.512 TB") == measures("512 Go") == measures("512 G B") == {"gb": {512}}
    assert measures("0,7kilos")["g"] == {700}


def test_pairs(spark):
    products = spark.createDataFrame(
        [("acme-fosufase-wp7623-700-black", "Acme Fosufase WP-7623", ["goods", "tents"], {"weight": "700 g", "color": "black"}), ("acme-fosufase-wp7623-2500-red", "Acme Fosufase WP-7623", ["goods", "tents"], {"weight": "2.5 kg", "color": "red"})],
        "seo_id string, name string, category array<string>, attributes map<string,string>",
    )
    listings = spark.createDataFrame(
        [
            ("a", "Acme Fosufase wp/7623 0,7 kg schwarz", None, None),
            ("a", "Acme Fosufase wp/7623 0,7 kg schwarz", None, None),
            ("b", "Zelt noir", {"type": "WP 7623", "poids": "700 Gramm"}, None),
            ("c", "Acme Fosuafse 700g", None, None),
            ("d", "Acme Fosufase rot", None, None),
            ("e", "Tasche für Acme Fosufase WP-7623 700 g schwarz", None, None),
            ("f", "Acme Fosufase 700 g schwarz", None, "acme-fosufase-wp7623-700-black"),
        ],
        "id string, title string, attributes map<string,string>, seo_id string",
    )
    found = classes(listings, products)
    assert {(r.id, r.code, r.measure, r.colour) for r in found.collect()} == {("a", "wp7623", 700, "black"), ("b", "wp7623", 700, "black"), ("c", "wp7623", 700, "black"), ("d", "wp7623", 2500, "red")}
    assert sorted(map(tuple, same_product(found).collect())) == [("a", "b"), ("a", "c"), ("b", "c")]


def products_of(spark, *names):
    rows = [(f"{n.lower().replace(' ', '-').replace('-', '', 0)}-700-red", n, ["goods", "tents"], {"weight": "700 g", "color": "red"}) for n in names]
    return spark.createDataFrame(rows, "seo_id string, name string, category array<string>, attributes map<string,string>")


def listings_of(spark, titles):
    rows = [(k, t, None, None) for k, t in titles.items()]
    return spark.createDataFrame(rows, "id string, title string, attributes map<string,string>, seo_id string")


def test_weights_decide_between_models(spark):
    """Two line names fit equally; the one that elsewhere stands beside other models' codes says less."""
    products = products_of(spark, "Acme Alphaline AB-1111", "Acme Betaline CD-2222", "Acme Gammaline EF-3333")
    titles = {"x": "Alphaline Betaline rot 700 g"} | {f"n{i}": f"Alphaline EF-3333 Gammaline 700 g rot {i}" for i in range(5)} | {f"b{i}": f"Betaline CD-2222 700 g rot {i}" for i in range(3)}
    listings = listings_of(spark, titles)
    found = {r.id: r.code for r in classes(listings, products).collect()}
    assert found["x"] == "cd2222" and {found[f"n{i}"] for i in range(5)} == {"ef3333"}
    ws = Workspace(spark, "test")
    variants = sp.variants_of(products, ws)
    signs = sp.signatures(sp.read_traits(listings), variants).selectExpr("concat_ws(' ', terms) AS sig", "terms").groupBy("sig").agg(F.count("*").alias("n"), F.first("terms").alias("terms"))
    pairs = sp.pairs_of(signs, variants, ws)
    links = sp.pair_links(pairs)
    even = sp.pair_scores(links, links.select("term").distinct().withColumn("x", F.lit(1.0))).join(pairs, "pid").where("sig = 'colour:red g:700 line:alphaline line:betaline'").collect()
    assert len(even) == 2 and len({r.s for r in even}) == 1
    weights, rounds = sp.reinforced(links, ws)
    x = {r.term: r.x for r in weights.collect()}
    assert rounds < sp.MOST_ROUNDS and x["line:betaline"] > x["line:alphaline"] and 0 <= min(x.values()) and max(x.values()) <= 1


def test_ties_nulls_and_long_texts(spark):
    products = products_of(spark, "Acme Alphaline AB-1111", "Acme Betaline CD-2222")
    titles = {"tie": "Alphaline Betaline rot 700 g", "alone": "Alphaline rot 700 g", "null": None, "empty": "", "long": "Betaline rot 700 g " + "wort " * 40_000, "other": "nothing known", "brand": "Acme rot"}
    found = {r.id: (r.code, r.measure, r.colour) for r in classes(listings_of(spark, titles), products).collect()}
    assert found == {"long": ("cd2222", 700, "red"), "alone": ("ab1111", 700, "red")}
    clash = listings_of(spark, titles).withColumn("score", F.lit(1)).withColumn("code", F.lit("x")).withColumn("sig", F.lit(""))
    assert {r.id for r in classes(clash, products).collect()} == {"long", "alone"}
    assert classes(listings_of(spark, titles).limit(0), products).collect() == [] and classes(listings_of(spark, titles), products.limit(0)).collect() == []


def test_registered():
    assert {"p3_found", "p3_classes"} <= set(QUERIES)

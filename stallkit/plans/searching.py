"""Listing search and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkit.operators import search as S
from stallkit.plans.registry import query
from stallkit.sources.tables import table

LAT, LON, FAR = 50.0, 9.0, "250km"
_TOKENS = r"list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_METRES = f"2 * {S.EARTH_METRES} * asin(sqrt(least(1.0, pow(sin(radians(latitude::DOUBLE - {LAT}) / 2), 2) + cos(radians(latitude::DOUBLE)) * cos(radians({LAT})) * pow(sin(radians(longitude::DOUBLE - {LON}) / 2), 2))))"


def _where(spark: SparkSession, folder: str, condition) -> DataFrame:
    return table(spark, folder, "listings").filter(condition).select("id", "found_at", "title", "price", "platform")


def _sql(condition: str) -> str:
    return f"SELECT id, found_at, title, price, platform FROM listings WHERE {condition}"


@query(_sql(f"list_has_all({_TOKENS}, ['mit', 'ovp'])"))
def f1_title_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Listings whose title holds every word asked for."""
    return _where(spark, folder, S.matches_all(F.col("title"), "OVP, mit"))


@query(_sql("price >= 0 AND price <= 120"))
def f2_price_range(spark: SparkSession, folder: str) -> DataFrame:
    return _where(spark, folder, S.price_between(F.col("price"), None, 120.0))


@query(_sql("platform IN (1, 7)"))
def f3_platform_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _where(spark, folder, S.of_platforms(F.col("platform"), ["Ebay", "Vinted"]))


@query(_sql(f"{_METRES} <= 250000"))
def f4_near(spark: SparkSession, folder: str) -> DataFrame:
    """Listings within a distance of a place."""
    return _where(spark, folder, S.within(F.col("latitude"), F.col("longitude"), LAT, LON, FAR))


@query(_sql("true"))
def f5_all(spark: SparkSession, folder: str) -> DataFrame:
    """A search without any condition leaves all; a price from below alone is no condition."""
    return _where(spark, folder, S.matches_all(F.col("title"), " ") & S.price_between(F.col("price"), 50.0, None) & S.within(F.col("latitude"), F.col("longitude"), LAT, None, None))


@query(_sql(f"list_has_all({_TOKENS}, ['ovp']) AND price BETWEEN 20 AND 900 AND platform IN (1, 2, 3) AND {_METRES} <= 900000"))
def f6_all_conditions(spark: SparkSession, folder: str) -> DataFrame:
    fits = S.matches_all(F.col("title"), "ovp") & S.price_between(F.col("price"), 20.0, 900.0) & S.of_platforms(F.col("platform"), ["Ebay", "Kleinanzeigen", "Marktplaats"])
    return _where(spark, folder, fits & S.within(F.col("latitude"), F.col("longitude"), LAT, LON, "900km"))


@query(_sql(f"list_has_all({_TOKENS}, ['mit']) AND price BETWEEN 0 AND 500 ORDER BY found_at DESC, id LIMIT 25"))
def f7_latest_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The latest matches of a search."""
    found = S.search_listings(table(spark, folder, "listings"), "mit", max_price=500.0, limit=25)
    return found.select("id", "found_at", "title", "price", "platform")


@query(_sql("user_id = 'u-shop-0001'") + " UNION ALL " + _sql(f"user_id IS DISTINCT FROM 'u-shop-0001' AND list_has_all({_TOKENS}, ['top'])"))
def f8_keywords_and_words(spark: SparkSession, folder: str) -> DataFrame:
    """A keyword is compared whole, a text by its words."""
    key = F.col("user_id") == "u-shop-0001"
    return _where(spark, folder, key | S.matches_all(F.col("title"), "top"))


@query("SELECT seo_id FROM products WHERE attributes['color'] = 'black'")
def f9_nested_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Products with an attribute of a key and value that belong together."""
    pairs = F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return table(spark, folder, "products").filter(S.has_attribute(pairs, "color", "black")).select("seo_id")


@query("""
    WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)
    SELECT vec_id FROM embeddings, q ORDER BY list_cosine_similarity(embeddings.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, vec_id LIMIT 20""")
def f10_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The rows nearest to the first row's vector."""
    vectors = table(spark, folder, "embeddings")
    return S.nearest_vectors(vectors, vectors.orderBy("vec_id").first()["embedding"], 20).select("vec_id")

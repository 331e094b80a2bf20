"""Statistics of products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkit.operators import metrics as M
from stallkit.plans.registry import query
from stallkit.sources.tables import table


def _stats(keys: str, source: str) -> str:
    return f"""SELECT {keys}, sum(price::DECIMAL(18,2))::DOUBLE / count(*) AS average_price, median(price) AS median_price, min(price) AS min_price, max(price) AS max_price, count(*)::BIGINT AS sample_count
        FROM ({source}) WHERE price > 0 GROUP BY ALL"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("average_price", F.round("average_price", 6)).withColumn("median_price", F.round("median_price", 6))


def _rounded_sql(sql: str) -> str:
    return f"SELECT * REPLACE (round(average_price, 6) AS average_price, round(median_price, 6) AS median_price) FROM ({sql})"


@query(_rounded_sql(_stats("product_seo_id", "SELECT product_seo_id, price FROM product_listings WHERE currency = 'EUR'")))
def a1_price_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Average, median, least and greatest price of every product."""
    return _rounded(M.price_stats(table(spark, folder, "product_listings").filter("currency = 'EUR'"), ["product_seo_id"], "price"))


@query("SELECT product_seo_id, count(*) AS listing_count, count(*) FILTER (is_sold) AS sold_count FROM product_listings GROUP BY 1")
def a2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return M.listing_counts(table(spark, folder, "product_listings"))


@query("""
    SELECT product_seo_id, string_agg(title, '|' ORDER BY rn) AS sample_titles FROM (
        SELECT product_seo_id, title, row_number() OVER (PARTITION BY product_seo_id ORDER BY max(found_at) DESC, title) AS rn FROM product_listings WHERE title IS NOT NULL GROUP BY product_seo_id, title)
    WHERE rn <= 3 GROUP BY 1""")
def a3_sample_titles(spark: SparkSession, folder: str) -> DataFrame:
    return M.sample_titles(table(spark, folder, "product_listings")).select("product_seo_id", F.array_join("sample_titles", "|").alias("sample_titles"))


@query("SELECT product_seo_id, string_agg(c, '|' ORDER BY c) AS categories FROM (SELECT DISTINCT product_seo_id, unnest(categories) AS c FROM product_listings) GROUP BY 1")
def a4_categories(spark: SparkSession, folder: str) -> DataFrame:
    return M.category_roll_up(table(spark, folder, "product_listings")).select("product_seo_id", F.array_join("categories", "|").alias("categories"))


@query("""
    WITH p AS (SELECT seo_id, unnest(map_keys(attributes)) AS key, unnest(map_values(attributes)) AS value FROM listings WHERE seo_id IS NOT NULL),
        c AS (SELECT seo_id, key, value, count(*) AS n FROM p GROUP BY ALL)
    SELECT seo_id, key, value, n FROM (SELECT *, row_number() OVER (PARTITION BY seo_id, key ORDER BY n DESC, value) AS rn FROM c) WHERE rn = 1""")
def a4_attributes(spark: SparkSession, folder: str) -> DataFrame:
    return M.attribute_roll_up(table(spark, folder, "listings"))


@query(_rounded_sql(_stats("product_seo_id, date", "SELECT product_seo_id, date_trunc('day', found_at) AS date, price FROM product_listings WHERE currency = 'EUR'")))
def a5_price_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Price statistics of every product and day."""
    return _rounded(M.price_snapshots(table(spark, folder, "product_listings")))


@query("SELECT product_seo_id, string_agg(c, '|' ORDER BY c) AS countries FROM (SELECT DISTINCT product_seo_id, upper(country) AS c FROM product_listings WHERE country IS NOT NULL) GROUP BY 1")
def a6_countries(spark: SparkSession, folder: str) -> DataFrame:
    return M.countries(table(spark, folder, "product_listings")).select("product_seo_id", F.array_join("countries", "|").alias("countries"))


@query("SELECT seo_id, NULL::DOUBLE AS estimated_value FROM products")
def a7_estimated_values(spark: SparkSession, folder: str) -> DataFrame:
    """No formula is stated for the estimate; new rows start without one."""
    return table(spark, folder, "products").select("seo_id", F.lit(None).cast("double").alias("estimated_value"))


@query("""
    SELECT l.product_seo_id, l.listing_id, l.found_at, round_even((p.median_price - l.price) * 100, 0)::DOUBLE AS profit_cents FROM product_listings l JOIN products p ON p.seo_id = l.product_seo_id
    WHERE l.is_active AND l.currency = 'EUR' AND l.price > 0 AND p.median_price IS NOT NULL""")
def a8_flip_profits(spark: SparkSession, folder: str) -> DataFrame:
    return M.flip_profits(table(spark, folder, "product_listings"), table(spark, folder, "products"))


@query("SELECT coalesce(canonical_seo_id, seo_id) AS canonical, string_agg(DISTINCT seo_id, '|' ORDER BY seo_id) AS related_seo_ids FROM products GROUP BY 1")
def a9_canonical_groups(spark: SparkSession, folder: str) -> DataFrame:
    return M.canonical_groups(table(spark, folder, "products")).select("canonical", F.array_join("related_seo_ids", "|").alias("related_seo_ids"))


@query("SELECT (n // 100)::INT AS partition_id, (n % 100)::INT AS entry_index, seo_id FROM (SELECT seo_id, row_number() OVER (ORDER BY seo_id) - 1 AS n FROM products)")
def a10_sitemap(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of a sitemap, of 100 products here."""
    return M.sitemap(table(spark, folder, "products"), 100)

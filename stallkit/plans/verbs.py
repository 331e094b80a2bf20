"""The relational verbs the domain is written with, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallkit.plans.registry import query
from stallkit.sources.tables import table


@query("SELECT id, found_at, title FROM listings WHERE commercial AND price > 100")
def v_where(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "listings").filter(F.col("commercial") & (F.col("price") > 100)).select("id", "found_at", "title")


@query("SELECT product_seo_id || '/' || listing_id AS key, round(price * 1.19, 4) AS gross, platform + 1 AS next FROM product_listings")
def v_select(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "product_listings")
    return rows.select(F.concat("product_seo_id", F.lit("/"), "listing_id").alias("key"), F.round(F.col("price") * 1.19, 4).alias("gross"), (F.col("platform") + 1).alias("next"))


@query("""SELECT product_seo_id, listing_id, found_at, price FROM (
    SELECT *, row_number() OVER (PARTITION BY product_seo_id ORDER BY price DESC, found_at, listing_id) AS rn FROM product_listings WHERE price IS NOT NULL) WHERE rn = 1""")
def v_group_first(spark: SparkSession, folder: str) -> DataFrame:
    """Of every group the first row by an order; groups meet as one row a task."""
    rows = table(spark, folder, "product_listings").filter("price is not null")
    best = rows.groupBy("product_seo_id").agg(F.min(F.struct((-F.col("price")).alias("m"), "found_at", "listing_id", "price")).alias("b"))
    return best.select("product_seo_id", "b.listing_id", "b.found_at", "b.price")


@query("SELECT seo_id, listing_count, row_number() OVER (ORDER BY listing_count DESC NULLS LAST, seo_id) AS place FROM products ORDER BY place LIMIT 200")
def v_order_then(spark: SparkSession, folder: str) -> DataFrame:
    """The first rows by two orders, with their places; only these are numbered in one task."""
    top = table(spark, folder, "products").select("seo_id", "listing_count").orderBy(F.desc_nulls_last("listing_count"), "seo_id").limit(200)
    return top.select("*", F.row_number().over(Window.orderBy(F.desc_nulls_last("listing_count"), "seo_id")).cast("bigint").alias("place"))


@query("SELECT event_id, ts, value FROM events ORDER BY value DESC, event_id LIMIT 40")
def v_take(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "ts", "value").orderBy(F.desc("value"), "event_id").limit(40)


@query(r"SELECT id, found_at, regexp_extract(title, '^\p{L}+') AS letters FROM listings")
def v_take_while(spark: SparkSession, folder: str) -> DataFrame:
    """The letters a title begins with."""
    return table(spark, folder, "listings").select("id", "found_at", F.regexp_extract("title", r"^\p{L}+", 0).alias("letters"))


@query("SELECT DISTINCT lower(locality) AS locality, country FROM listings")
def v_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "listings").select(F.lower("locality").alias("locality"), "country").distinct()


@query("SELECT id, found_at, list_filter(image_urls, lambda u: u LIKE '%/1.jpg')[1] AS second FROM listings")
def v_first_or_default(spark: SparkSession, folder: str) -> DataFrame:
    """The first element that fits, or null."""
    return table(spark, folder, "listings").select("id", "found_at", F.get(F.filter("image_urls", lambda u: u.like("%/1.jpg")), F.lit(0)).alias("second"))


@query("""SELECT id, found_at, len(list_filter(image_urls, lambda u: contains(u, '/0'))) > 0 AS any_first, len(list_filter(image_urls, lambda u: NOT contains(u, 'img'))) = 0 AS all_hosted
    FROM listings WHERE image_urls IS NOT NULL""")
def v_any_all(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "listings").filter("image_urls is not null")
    return rows.select("id", "found_at", F.exists("image_urls", lambda u: u.contains("/0")).alias("any_first"), F.forall("image_urls", lambda u: u.contains("img")).alias("all_hosted"))


@query("SELECT id, found_at, len(list_filter(image_urls, lambda u: u LIKE '%.jpg'))::INT AS n FROM listings WHERE image_urls IS NOT NULL")
def v_count_where(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "listings").filter("image_urls is not null")
    return rows.select("id", "found_at", F.size(F.filter("image_urls", lambda u: u.endswith(".jpg"))).alias("n"))


@query("SELECT l.product_seo_id, l.listing_id, l.found_at, p.brand FROM product_listings l LEFT JOIN products p ON p.seo_id = l.product_seo_id")
def v_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A field of another table by key; the side that is looked up is broadcast by Spark while it is small."""
    brands = table(spark, folder, "products").select(F.col("seo_id").alias("product_seo_id"), "brand")
    return table(spark, folder, "product_listings").select("product_seo_id", "listing_id", "found_at").join(brands, "product_seo_id", "left")


@query("""SELECT product_seo_id, date, sum(sample_count) OVER (PARTITION BY product_seo_id ORDER BY date)::BIGINT AS samples
    FROM (SELECT DISTINCT product_seo_id, date, sample_count FROM price_history)""")
def v_running_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of a product up to each day."""
    days = table(spark, folder, "price_history").select("product_seo_id", "date", "sample_count").distinct()
    return days.select("product_seo_id", "date", F.sum("sample_count").over(Window.partitionBy("product_seo_id").orderBy("date")).alias("samples"))


@query("SELECT id, found_at, array_to_string(categories, ' > ') AS path FROM listings")
def v_join_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "listings").select("id", "found_at", F.array_join("categories", " > ").alias("path"))

"""Stored tables and reads from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkit.operators import reads
from stallkit.plans.registry import query
from stallkit.sources import store
from stallkit.sources.schemas import DOCUMENTS, MESSAGES, TABLES
from stallkit.sources.tables import table

#: Moments the queries are asked at.
BEFORE, AS_OF = datetime(2025, 9, 1, 12), datetime(2025, 10, 1)
LISTING_COLUMNS = ("product_seo_id", "listing_id", "found_at", "price", "currency")
#: The product of most listings, the smallest key of those.
_MOST = "(SELECT product_seo_id FROM product_listings WHERE product_seo_id <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _fields() -> list[tuple[str, str, str]]:
    kinds = {n: s.columns for n, s in TABLES.items()} | DOCUMENTS | MESSAGES
    out = []
    for name, ddl in kinds.items():
        depth, part = 0, ""
        for c in ddl + ",":
            depth += (c == "<") - (c == ">")
            if c == "," and not depth:
                out.append((name, *part.strip().split(" ", 1)))
                part = ""
            else:
                part += c
    return out


def _busiest(spark: SparkSession, folder: str) -> str:
    counts = table(spark, folder, "product_listings").filter(F.col("product_seo_id") != "").groupBy("product_seo_id").count()
    return counts.orderBy(F.desc("count"), "product_seo_id").first()[0]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _fields()) + ") t(table_name, column_name, column_type)")
def s1_table_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of the tables, documents and messages as Spark reads their schemas."""
    from pyspark.sql.types import StructType

    kinds = {n: s.columns for n, s in TABLES.items()} | DOCUMENTS | MESSAGES
    rows = [(name, f.name, f.dataType.simpleString().replace("bigint", "long")) for name, ddl in kinds.items() for f in StructType.fromDDL(ddl)]
    return spark.createDataFrame(rows, "table_name string, column_name string, column_type string")


@query("SELECT 'listings' AS name, count(*) AS n FROM listings UNION ALL SELECT 'price_history', count(*) FROM price_history UNION ALL SELECT 'product_listings', count(*) FROM product_listings UNION ALL SELECT 'products', count(*) FROM products")
def s2_handles(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every stored table that has data, read by its schema."""
    parts = [spark.read.schema(TABLES[n].columns).parquet(f"{folder}/{n}.parquet").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("listings", "price_history", "product_listings", "products")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT id, platform, max(found_at) AS found_at, min(title) AS title, min(price) AS price FROM listings GROUP BY id, platform")
def s3_upserted_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Listings written in the order they were found: one row a key, that of the last write."""
    rows = table(spark, folder, "listings").select("id", "platform", "found_at", "title", "price")
    late = rows.filter(F.col("found_at") >= F.lit(BEFORE).cast("timestamp_ntz"))
    early = rows.filter(F.col("found_at") < F.lit(BEFORE).cast("timestamp_ntz"))
    return store.upserted(early, late, ["id", "platform"], ["found_at"])


@query("SELECT id, found_at, platform FROM listings WHERE date_trunc('day', found_at) + INTERVAL 15 DAY > TIMESTAMP '2025-10-01'")
def s9_retained_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Listings whose day's table is still there."""
    return store.retained(table(spark, folder, "listings").select("id", "found_at", "platform"), "found_at", AS_OF)


@query("SELECT seo_id, last_updated, coalesce(last_updated <= TIMESTAMP '2025-09-24', false) AS warm FROM products")
def s10_warm_products(spark: SparkSession, folder: str) -> DataFrame:
    """Products whose last change is long enough ago for their table to be compacted."""
    return table(spark, folder, "products").select("seo_id", "last_updated", F.coalesce(store.is_warm(F.col("last_updated"), AS_OF), F.lit(False)).alias("warm"))


@query("SELECT 'listings' AS alias, count(*) AS n FROM (SELECT id FROM listings UNION ALL SELECT id FROM listings)")
def s11_alias_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows behind a view over a series of two tables."""
    at = f"{folder}/listings.parquet"
    return store.bootstrap(spark, "stallkit_listing_series", [at, at]).agg(F.lit("listings").alias("alias"), F.count("*").alias("n"))


@query("SELECT seo_id, array_to_string(string_split(seo_id, '-')[:-2], '-') || '-*' AS pattern FROM products")
def s12_index_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "products").select("seo_id", store.index_pattern(F.col("seo_id")).alias("pattern"))


@query("SELECT id, title, description, price, currency, contact, user_id, found_at, platform, price_kind, NULL::VARCHAR AS seo_id, NULL::INT AS n_categories FROM listings")
def u3_copied_listings(spark: SparkSession, folder: str) -> DataFrame:
    copied = store.copied_listings(table(spark, folder, "listings")).withColumn("n_categories", F.when(F.col("categories").isNotNull(), F.size("categories")))
    return copied.select("id", "title", "description", "price", "currency", "contact", "user_id", "found_at", "platform", "price_kind", "seo_id", "n_categories")


@query("SELECT count(*) AS n, 36 AS id_length, 0 AS price_kind, 0 AS n_attributes FROM listings")
def u4_new_listings(spark: SparkSession, folder: str) -> DataFrame:
    """What new listings start with."""
    new = store.new_listings(table(spark, folder, "listings").select("title"))
    return new.agg(F.count("*").alias("n"), F.max(F.length("id")).alias("id_length"), F.max("price_kind").alias("price_kind"), F.max(F.size("attributes")).alias("n_attributes"))


@query("SELECT seo_id, name, brand, model, median_price FROM products WHERE seo_id = (SELECT min(seo_id) FROM products)")
def q1_product(spark: SparkSession, folder: str) -> DataFrame:
    products = table(spark, folder, "products")
    return reads.product_by_key(products, products.agg(F.min("seo_id")).first()[0]).select("seo_id", "name", "brand", "model", "median_price")


@query(f"SELECT product_seo_id, listing_id, found_at, price, currency FROM product_listings WHERE product_seo_id = {_MOST} AND found_at < TIMESTAMP '2025-09-01 12:00:00' ORDER BY found_at DESC, listing_id LIMIT 50")
def q2_cursor_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page of the busiest product's listings."""
    return reads.listings_page(table(spark, folder, "product_listings").select(*LISTING_COLUMNS), _busiest(spark, folder), BEFORE)


@query("""
    SELECT product_seo_id, listing_id, found_at, price, currency, rn FROM (
        SELECT *, row_number() OVER (PARTITION BY product_seo_id ORDER BY found_at DESC, listing_id)::INT AS rn FROM product_listings) WHERE rn <= 5""")
def q2b_batched_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The five latest listings of every product."""
    return reads.latest_per_product(table(spark, folder, "product_listings").select(*LISTING_COLUMNS), 5)


@query(f"SELECT product_seo_id, listing_id, found_at, price, currency FROM product_listings WHERE product_seo_id = {_MOST} ORDER BY found_at DESC, listing_id LIMIT 1000")
def q3_latest_listings(spark: SparkSession, folder: str) -> DataFrame:
    return reads.latest_listings(table(spark, folder, "product_listings").select(*LISTING_COLUMNS), _busiest(spark, folder))


@query(f"SELECT product_seo_id, date, average_price, median_price, min_price, max_price, sample_count FROM price_history WHERE product_seo_id = {_MOST} AND date >= TIMESTAMP '2025-10-01' - INTERVAL 90 DAY")
def q4_price_history(spark: SparkSession, folder: str) -> DataFrame:
    return reads.price_history_of(table(spark, folder, "price_history"), _busiest(spark, folder), AS_OF)


@query("SELECT id, platform, found_at, title FROM listings WHERE id = (SELECT max(id) FROM listings WHERE platform = 2) AND platform = 2 ORDER BY found_at DESC LIMIT 1")
def q5_listing(spark: SparkSession, folder: str) -> DataFrame:
    listings = table(spark, folder, "listings")
    id_ = listings.filter("platform = 2").agg(F.max("id")).first()[0]
    return reads.listing_by_key(listings, id_, 2).select("id", "platform", "found_at", "title")


@query("SELECT 'o-' || o_orderkey AS report_id, o_orderdate AS created_at, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderstatus = 'O' ORDER BY created_at DESC, report_id LIMIT 100")
def q6_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Newest reports of a status; orders stand for reports."""
    orders = table(spark, folder, "orders")
    reports = orders.select(F.concat(F.lit("o-"), "o_orderkey").alias("report_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return reads.reports_of(reports, "O")


@query("SELECT product_seo_id, listing_id, found_at, price, currency FROM product_listings WHERE listing_id = (SELECT max(listing_id) FROM product_listings)")
def q7_by_listing_id(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "product_listings").select(*LISTING_COLUMNS)
    return reads.by_listing_id(rows, rows.agg(F.max("listing_id")).first()[0])

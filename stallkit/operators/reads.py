"""Keyed reads, cursor pages and latest rows.

Every read filters on key columns as they are stored, so filters reach the scan, and takes its first rows by an order
that tells rows apart, so pages are the same each time.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE, LATEST, HISTORY_DAYS, REPORTS = 50, 1000, 90, 100


def product_by_key(products: DataFrame, seo_id: str) -> DataFrame:
    """The product of a key, or no row."""
    return products.filter(F.col("seo_id") == seo_id).limit(1)


def listing_by_key(listings: DataFrame, id_: str, platform: int) -> DataFrame:
    """The listing of an id and marketplace, the latest crawl of it, or no row."""
    return listings.filter((F.col("id") == id_) & (F.col("platform") == platform)).orderBy(F.desc("found_at")).limit(1)


def by_listing_id(product_listings: DataFrame, listing_id: str) -> DataFrame:
    """All product listings of a listing id."""
    return product_listings.filter(F.col("listing_id") == listing_id)


def listings_page(product_listings: DataFrame, seo_id: str, before: datetime | None = None, limit: int = PAGE) -> DataFrame:
    """Listings of a product found before a time, which is not included, latest first; ties by listing id."""
    rows = product_listings.filter(F.col("product_seo_id") == seo_id)
    if before is not None:
        rows = rows.filter(F.col("found_at") < F.lit(before).cast("timestamp_ntz"))
    return rows.orderBy(F.desc("found_at"), "listing_id").limit(limit)


def latest_listings(product_listings: DataFrame, seo_id: str, limit: int = LATEST) -> DataFrame:
    return listings_page(product_listings, seo_id, None, limit)


def latest_per_product(product_listings: DataFrame, limit: int) -> DataFrame:
    """The latest listings of every product with their place ``rn``. Each task keeps its ``limit`` a product before the shuffle."""
    rn = F.row_number().over(Window.partitionBy("product_seo_id").orderBy(F.desc("found_at"), "listing_id"))
    return product_listings.withColumn("rn", rn).filter(F.col("rn") <= limit)


def price_history_of(price_history: DataFrame, seo_id: str, as_of: datetime, days: int = HISTORY_DAYS) -> DataFrame:
    """Price snapshots of a product of the last days, the first moment included, latest first."""
    since = F.lit(as_of - timedelta(days=days)).cast("timestamp_ntz")
    return price_history.filter((F.col("product_seo_id") == seo_id) & (F.col("date") >= since)).orderBy(F.desc("date"))


def reports_of(flip_reports: DataFrame, status: str, limit: int = REPORTS) -> DataFrame:
    """Reports of a status, newest first."""
    return flip_reports.filter(F.col("status") == status).orderBy(F.desc("created_at"), "report_id").limit(limit)

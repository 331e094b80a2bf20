"""Queries of price percentiles per product."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkit.llm.quantiles import build_runs, select_quantiles
from stallkit.sources.tables import table


def usable_prices(product_listings: DataFrame) -> DataFrame:
    """``product_seo_id, listing_id, found_at, price``: one row per row key, in EUR and above 0.

    Copies of a key are merged before the shuffle. A null in the key is a value like any other.
    """
    rows = product_listings.filter((F.col("currency") == "EUR") & (F.col("price") > 0))
    return rows.groupBy("product_seo_id", "listing_id", "found_at").agg(F.min("price").alias("price"))


def price_quantiles(product_listings: DataFrame, qs: tuple[float, ...]) -> DataFrame:
    """``k, n, q``: percentiles of the usable prices of every product."""
    return select_quantiles(build_runs(usable_prices(product_listings), "product_seo_id", "price", ["listing_id", "found_at"]), qs)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Products with 20 usable prices or more whose median_price is off the true median by more than 10 % of it."""
    medians = price_quantiles(table(spark, folder, "product_listings"), (0.5,)).filter(F.col("n") >= 20)
    medians = medians.select(F.col("k").alias("seo_id"), F.element_at("q", 1).alias("true_median"))
    both = table(spark, folder, "products").select("seo_id", "median_price").join(medians, "seo_id")
    return both.filter(F.abs(F.col("median_price") - F.col("true_median")) > 0.1 * F.col("true_median")).select("seo_id")


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Quartiles and the 90th percentile of the usable prices of every product."""
    q = price_quantiles(table(spark, folder, "product_listings"), (0.25, 0.5, 0.75, 0.9))
    return q.select(F.col("k").alias("product_seo_id"), "n", *[F.round(F.element_at("q", i + 1), 6).alias(f"p{p}") for i, p in enumerate((25, 50, 75, 90))])

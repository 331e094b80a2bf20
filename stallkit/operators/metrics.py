"""Statistics of products over their listings.

Every operator aggregates before it shuffles, so the rows of a busy product meet only as partial sums. Money is summed as
decimals, so sums do not depend on the order of rows. These are derivations of ours from the stored fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallkit.session import Workspace, shuffle_width

#: Products in one part of a sitemap at most.
SITEMAP_PART = 5000


def money_sum(c: Column) -> Column:
    return F.sum(c.cast("decimal(28,2)")).cast("double")


def price_stats(rows: DataFrame, keys: Sequence[str], price: str) -> DataFrame:
    """``keys`` with ``average_price, median_price, min_price, max_price, sample_count`` over prices above 0.

    Equal prices are counted before they meet, so what one group gathers grows with its different prices, not its rows.
    Null, NaN and other prices don't count; a group without any has no row.
    """
    counted = rows.filter((F.col(price) > 0) & ~F.isnan(price)).groupBy(*keys, F.col(price).alias("_p")).agg(F.count("*").alias("_n"))
    total = F.sum((F.col("_p").cast("decimal(18,2)") * F.col("_n")).cast("decimal(38,2)")).cast("double")
    return counted.groupBy(*keys).agg(
        (total / F.sum("_n")).alias("average_price"), F.percentile("_p", F.lit(0.5), F.col("_n")).alias("median_price"), F.min("_p").alias("min_price"), F.max("_p").alias("max_price"), F.sum("_n").alias("sample_count")
    )


def listing_counts(product_listings: DataFrame) -> DataFrame:
    """``product_seo_id, listing_count, sold_count``: rows, and rows that are sold; a null sold state is unsold."""
    return product_listings.groupBy("product_seo_id").agg(F.count("*").alias("listing_count"), F.count_if(F.coalesce("is_sold", F.lit(False))).alias("sold_count"))


def sample_titles(product_listings: DataFrame, k: int = 3) -> DataFrame:
    """``product_seo_id, sample_titles``: the titles of a product's ``k`` latest different titles, latest first, ties by title."""
    titles = product_listings.filter(F.col("title").isNotNull()).groupBy("product_seo_id", "title").agg(F.max("found_at").alias("at"))
    ranked = titles.withColumn("rn", F.row_number().over(Window.partitionBy("product_seo_id").orderBy(F.desc("at"), "title"))).filter(F.col("rn") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("rn", "title")))
    return ranked.groupBy("product_seo_id").agg(F.transform(ordered, lambda x: x["title"]).alias("sample_titles"))


def category_roll_up(product_listings: DataFrame) -> DataFrame:
    """``product_seo_id, categories``: the categories any listing of a product is in, sorted."""
    pairs = product_listings.select("product_seo_id", F.explode("categories").alias("c")).distinct()
    return pairs.groupBy("product_seo_id").agg(F.array_sort(F.collect_list("c")).alias("categories"))


def attribute_roll_up(listings: DataFrame) -> DataFrame:
    """``seo_id, key, value, n``: of every attribute of a product the value most listings state, ties by value."""
    pairs = listings.filter(F.col("seo_id").isNotNull()).select("seo_id", F.explode("attributes").alias("key", "value"))
    counts = pairs.groupBy("seo_id", "key", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("seo_id", "key").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("b"))
    return best.select("seo_id", "key", "b.value", (-F.col("b.m")).alias("n"))


def price_snapshots(product_listings: DataFrame) -> DataFrame:
    """Price statistics per product and day, prices in euros only."""
    rows = product_listings.filter(F.col("currency") == "EUR").select("product_seo_id", F.date_trunc("day", "found_at").cast("timestamp_ntz").alias("date"), "price")
    return price_stats(rows, ["product_seo_id", "date"], "price")


def countries(product_listings: DataFrame) -> DataFrame:
    """``product_seo_id, countries``: where a product's listings are, in capitals, sorted."""
    pairs = product_listings.filter(F.col("country").isNotNull()).select("product_seo_id", F.upper("country").alias("c")).distinct()
    return pairs.groupBy("product_seo_id").agg(F.array_sort(F.collect_list("c")).alias("countries"))


def flip_profits(product_listings: DataFrame, products: DataFrame) -> DataFrame:
    """``product_seo_id, listing_id, found_at, profit``: the product's stored median less the listing's price, active listings in euros."""
    rows = product_listings.filter(F.col("is_active") & (F.col("currency") == "EUR") & (F.col("price") > 0)).select("product_seo_id", "listing_id", "found_at", "price")
    medians = products.select(F.col("seo_id").alias("product_seo_id"), "median_price").filter("median_price is not null")
    return rows.join(medians, "product_seo_id").select("product_seo_id", "listing_id", "found_at", F.bround((F.col("median_price") - F.col("price")) * 100, 0).alias("profit_cents"))


def canonical_groups(products: DataFrame) -> DataFrame:
    """``canonical, related_seo_ids``: the products that name another as theirs, itself included, sorted."""
    named = products.select(F.coalesce("canonical_seo_id", "seo_id").alias("canonical"), "seo_id")
    return named.groupBy("canonical").agg(F.array_sort(F.collect_set("seo_id")).alias("related_seo_ids"))


def sitemap(products: DataFrame, part: int = SITEMAP_PART) -> DataFrame:
    """``partition_id, entry_index, seo_id``: products in order of key, cut into parts.

    Places come from counts of sorted ranges, so no task numbers all rows. A null key has no place; a repeated one has one.
    """
    ws = Workspace(products.sparkSession, "sitemap")
    keyed = products.filter(F.col("seo_id").isNotNull()).select("seo_id").distinct()
    ranges = keyed.repartitionByRange(shuffle_width(keyed), "seo_id").sortWithinPartitions("seo_id")
    # The row number has the range's number in its upper bits and the place in the range in the 33 lower ones.
    n = F.monotonically_increasing_id()
    rows = ws.cut(ranges.select("seo_id", F.shiftright(n, 33).alias("_range"), n.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "rows")
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    first = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(sizes.select("_range", first.alias("_first")), "_range").select("seo_id", (F.col("_at") + F.col("_first")).alias("at"))
    return placed.select((F.col("at") / part).cast("int").alias("partition_id"), (F.col("at") % part).cast("int").alias("entry_index"), "seo_id")

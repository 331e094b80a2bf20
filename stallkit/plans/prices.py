"""Counts of product listings and prices in common units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkit.functions.folding import fold_for_match
from stallkit.functions.money import SCALES, asking_price, money_in, stated_unit, unit_of
from stallkit.functions.text import once
from stallkit.operators.skew import balanced_counts
from stallkit.operators.units import assign_units, candidates
from stallkit.plans.registry import query
from stallkit.session import Workspace
from stallkit.sources.tables import table


@query("""
    SELECT p.seo_id FROM products p
    LEFT JOIN (SELECT product_seo_id, count(DISTINCT listing_id) AS n FROM product_listings GROUP BY 1) l ON l.product_seo_id = p.seo_id
    WHERE p.listing_count IS NOT NULL AND p.listing_count <> coalesce(l.n, 0)""")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Products whose listing_count is not the number of distinct listings that name them."""
    counts = balanced_counts(table(spark, folder, "product_listings"), "product_seo_id", "listing_id")
    stored = table(spark, folder, "products").filter(F.col("listing_count").isNotNull()).select("seo_id", "listing_count")
    both = stored.join(counts.select(F.col("product_seo_id").alias("seo_id"), "n_distinct"), "seo_id", "left")
    return both.filter(F.col("listing_count") != F.coalesce("n_distinct", F.lit(0))).select("seo_id")


@query("""
    SELECT product_seo_id, count(*) AS n_rows, count(DISTINCT listing_id) AS n_distinct FROM product_listings GROUP BY 1""")
def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and distinct listings of every product_seo_id, null and blank ones included."""
    return balanced_counts(table(spark, folder, "product_listings"), "product_seo_id", "listing_id")


#: Ratio of two amounts, in log10, within which they state the same price; stored amounts are rounded.
_SAME = 0.004


def _stated(u: Column, stored: Column, blank: Column) -> Column:
    """``struct<number, from_text, code, scale>`` of the units ``told`` by the currency, ``asked`` and ``named`` by the texts."""
    ratio = F.log10(stored) - F.log10(F.when(u["amount"] > 0, u["amount"]))
    close = lambda at: F.coalesce(F.abs(ratio - at) < _SAME, F.lit(False))
    in_units = F.coalesce(u["asked"]["scale"] == "unit", F.lit(False))
    seen = F.when(in_units & close(2), "cent").when(in_units & close(-3), "thousand").when(close(0), u["asked"]["scale"])
    from_text = blank & u["amount"].isNotNull()
    code = F.coalesce(u["told"]["code"], F.when(from_text | seen.isNotNull(), u["asked"]["code"]), u["named"]["code"], u["asked"]["code"])
    odd = lambda unit: F.when(unit["scale"] != "unit", unit["scale"])
    scale = F.when(from_text, F.coalesce(u["asked"]["scale"], u["told"]["scale"])).otherwise(F.coalesce(odd(u["told"]), seen, u["told"]["scale"], odd(u["named"])))
    return F.struct(F.when(from_text, u["amount"]).otherwise(stored).alias("number"), from_text.alias("from_text"), code.alias("code"), scale.alias("scale"))


def priced_listings(listings: DataFrame, rates: DataFrame) -> DataFrame:
    """Every listing's asking price in euros: ``id, unit_code, unit_scale, probability, uncertain, common, hinted``.

    Evidence, in this order: the currency column, the asking price in the texts, words that name the currency. A text
    that shows the stored amount at a hundred times less, or a thousand times more, tells the scale. Where a part is
    still missing the mixture of the price's category decides. ``common`` is the price in euros, null without any price;
    ``hinted`` tells whether anything but the number itself speaks for the unit. Copies of an id give one row.
    """
    one = listings.select("id", "price", "categories", fold_for_match(F.col("title")).alias("title"), fold_for_match(F.col("description")).alias("text"), fold_for_match(F.col("currency")).alias("currency"))
    title, text = F.col("title"), F.col("text")
    read = one.select(
        "id",
        F.when((F.col("price") > 0) & ~F.isnan("price"), F.col("price")).alias("stored"),
        F.when(F.col("price").isNull() | F.isnan("price"), F.lit(True)).otherwise(False).alias("blank_price"),
        "currency",
        F.get(F.reverse("categories"), F.lit(0)).alias("category"),
        asking_price(title, text).alias("asking"),
        F.coalesce(stated_unit(text), stated_unit(title)).alias("named"),
    )
    # Copies go once the texts are read: what is shuffled is a few words a listing.
    read = Workspace(listings.sparkSession, "asked").cut(read.dropDuplicates(["id"]), "read")
    spelled = F.struct(unit_of(F.col("currency")).alias("told"), F.when(F.col("asking").isNotNull(), money_in(F.col("asking"))).alias("asked"), F.when(F.col("named").isNotNull(), unit_of(F.col("named"))).alias("named"))
    units = once(spelled, lambda s: F.struct(s["told"].alias("told"), s["asked"]["amount"].alias("amount"), F.when(s["asked"].isNotNull(), unit_of(s["asked"]["token"])).alias("asked"), s["named"].alias("named")))
    rows = read.select("id", "category", once(units, lambda u: _stated(u, F.col("stored"), F.col("blank_price"))).alias("s")).select("id", "category", "s.*")
    rows = rows.withColumn("hinted", F.col("code").isNotNull())
    return assign_units(rows, "number", "category", "code", "scale", candidates(rates.select("code", F.col("eur_per_unit").alias("factor")), SCALES), ["id", "from_text", "hinted"])


@query()
def p4_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Every listing's asking price in euros, with the unit it was in and how sure that is."""
    p = priced_listings(table(spark, folder, "listings"), table(spark, folder, "currency_rates"))
    return p.select("id", F.col("unit_code").alias("currency_code"), F.col("unit_scale").alias("price_scale"), F.round("probability", 4).alias("probability"), "uncertain", F.round("common", 2).alias("price_eur"))


@query()
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Listings whose asking price is not stored as a number of euros, with the unit it is in."""
    p = priced_listings(table(spark, folder, "listings"), table(spark, folder, "currency_rates"))
    off = F.col("from_text") | (F.col("unit_code") != "EUR") | (F.col("unit_scale") != "unit")
    return p.filter(F.col("hinted") & F.col("common").isNotNull() & off).select("id", F.col("unit_code").alias("currency_code"), F.col("unit_scale").alias("price_scale"))

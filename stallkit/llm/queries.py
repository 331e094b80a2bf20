"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkit.llm.bpe import VOCABULARY, decode_ids, encode_texts
from stallkit.llm.canon import meant_entries
from stallkit.llm.leakage import leaked, reparameterised
from stallkit.llm.percentiles import p5_found, p5_percentiles
from stallkit.llm.pii import name_words, redact_columns
from stallkit.llm.reading import reading_levels
from stallkit.llm.same_product import classes, same_product
from stallkit.llm.unicode_fold import fold_text
from stallkit.llm.sql import SQL
from stallkit.sources.tables import table

__all__ = ["QUERIES", "SQL"]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Listings and fields that hold characters of other kinds than they look."""
    listings = table(spark, folder, "listings").select("id", "title", "description")
    odd = fold_text(listings, ["title", "description"])
    fields = F.array(*[F.when(F.col(f"{c}_odd") != 0, c) for c in ("title", "description")])
    return odd.select("id", F.explode(F.array_compact(fields)).alias("field")).distinct()


def p2_folded(spark: SparkSession, folder: str) -> DataFrame:
    """Both texts of every listing in the consistent form."""
    folded = fold_text(table(spark, folder, "listings").select("id", "title", "description"), ["title", "description"])
    return folded.select("id", F.col("title_folded").alias("title"), F.col("description_folded").alias("description"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of ungrouped listings that offer the same product."""
    return same_product(p3_classes(spark, folder))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Model, measure and colour of every ungrouped listing that offers a product."""
    return classes(table(spark, folder, "listings"), table(spark, folder, "products"))


def _redacted(spark: SparkSession, folder: str) -> DataFrame:
    listings = table(spark, folder, "listings").select("id", "description", "contact").distinct()
    return redact_columns(listings, ["description", "contact"], ["contact"], ["id"], name_words(listings, "contact"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Listings, fields and the kinds of personal information in them."""
    def cases(field: str) -> Column:
        return F.transform(f"{field}_kinds", lambda kind: F.struct(F.lit(field).alias("field"), kind.alias("pii_kind")))

    kinds = F.concat(cases("description"), cases("contact"))
    # Account and card numbers are hidden in the texts, but are no kind that is asked for.
    found = _redacted(spark, folder).select("id", F.explode(kinds).alias("case")).where("case.pii_kind != 'account'")
    return found.select("id", "case.field", "case.pii_kind").distinct()


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Both texts of every listing with a placeholder for each piece of personal information."""
    return _redacted(spark, folder).select("id", F.col("description_redacted").alias("description"), F.col("contact_redacted").alias("contact"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Categories, brands and conditions that are not an entry's very name, and the entry they mean."""
    listings, products = table(spark, folder, "listings"), table(spark, folder, "products")
    values = listings.select(F.col("id").alias("record_key"), F.lit("category").alias("field"), F.col("category").alias("value"))
    for field in ("brand", "condition"):
        values = values.unionByName(products.select(F.col("seo_id").alias("record_key"), F.lit(field).alias("field"), F.col(field).alias("value")))
    return meant_entries(values, table(spark, folder, "canon_values"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document. ``stallkit.vocabulary`` of the session names another file of the vocabulary."""
    return encode_texts(table(spark, folder, "documents"), "doc_id", "text", spark.conf.get("stallkit.vocabulary", VOCABULARY))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Texts decoded from their token ids, with the number of ids: the round trip of every document."""
    ids = p8_ids(spark, folder)
    texts = decode_ids(ids, "doc_id", "ids", spark.conf.get("stallkit.vocabulary", VOCABULARY))
    return texts.select("doc_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items of which they hold twelve consecutive words or more."""
    return leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_reparameterised(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold an evaluation item's template with other names and numbers."""
    return reparameterised(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Reading level of every document of 40 words or more."""
    return reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_folded": p2_folded,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p5_found": p5_found,
    "p5_percentiles": p5_percentiles,
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_found": p9_found,
    "p9_reparameterised": p9_reparameterised,
    "p10_found": p10_found,
}

"""Messages: listeners, missing listings, and listings as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkit.operators.matching import listener_matches, still_missing
from stallkit.plans.registry import query
from stallkit.session import Workspace
from stallkit.sources.schemas import TABLES
from stallkit.sources.tables import table
from stallkit.streaming.listings import first_seen, read_files

_LISTENERS = """SELECT 'u' || c_custkey AS user_id, c_custkey AS id, c_custkey % 9 AS platform, c_custkey % 4 AS kind, ['schwarz', 'black', 'red', 'blau', 'silver'][c_custkey % 5 + 1] AS value FROM customer"""


@query(f"""
    WITH s AS ({_LISTENERS}), l AS (SELECT DISTINCT id AS listing, platform, list_transform(map_entries(attributes), lambda e: lower(e.key) || '=' || lower(e.value)) AS a FROM listings)
    SELECT s.user_id, s.id AS listener_id, l.listing AS id FROM s JOIN l ON l.platform = s.platform
    WHERE list_contains(a, 'color=' || s.value) AND (kind <> 0 OR list_contains(a, 'model=' || s.value)) AND (kind <> 1 OR len(list_filter(a, lambda x: x LIKE 'weight=700 g')) > 0)""")
def m1_listener_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Listings that the listeners of customers wait for: a colour, with some a weight or a model."""
    words = F.array(*[F.lit(w) for w in ("schwarz", "black", "red", "blau", "silver")])
    value = F.element_at(words, (F.col("c_custkey") % 5 + 1).cast("int"))
    pair = lambda name, v: F.struct(F.lit(name).alias("name"), v.alias("value"))
    kind = F.col("c_custkey") % 4
    filters = F.when(kind == 0, F.array(pair("Color", value), pair("model", value))).when(kind == 1, F.array(pair("color", value), pair("weight", F.lit("700 g")))).otherwise(F.array(pair("color", value), pair("COLOR", value)))
    listeners = table(spark, folder, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("user_id"), F.col("c_custkey").alias("id"), filters.alias("filters"), (F.col("c_custkey") % 9).cast("int").alias("platform"))
    return listener_matches(table(spark, folder, "listings"), listeners)


@query("""
    SELECT m.listing_id, m.product_seo_id, m.found_at, m.price FROM product_listings m LEFT JOIN (SELECT listing_id, max(found_at) AS last FROM product_listings GROUP BY 1) f ON f.listing_id = m.listing_id
    WHERE NOT m.is_active AND f.last <= m.found_at""")
def m2_still_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Inactive product listings that were not found again later."""
    rows = table(spark, folder, "product_listings").select("listing_id", "product_seo_id", "found_at", "price", "is_active")
    return still_missing(rows.filter(~F.col("is_active")).drop("is_active"), rows)


@query("SELECT id, platform, count(DISTINCT title) AS titles FROM listings GROUP BY id, platform")
def m3_streamed_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Listings read as a stream, repeated crawls dropped; one batch holds all of the table, so each key comes once."""
    ws = Workspace(spark, "stream")
    stream = first_seen(read_files(spark, folder, TABLES["listings"].columns, "listings.parquet"), late="1000 days").select("id", "platform", "title")
    out = stream.writeStream.format("parquet").option("path", f"{ws.root}/rows").option("checkpointLocation", f"{ws.root}/checkpoint").trigger(availableNow=True).start()
    out.awaitTermination()
    rows = spark.read.schema("id string, platform int, title string").parquet(f"{ws.root}/rows")
    return rows.select("id", "platform", F.when(F.col("title").isNotNull(), 1).otherwise(0).cast("bigint").alias("titles"))

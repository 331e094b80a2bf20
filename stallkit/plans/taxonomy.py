"""The category tree and walks along it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkit.functions.vocabulary import CATEGORY_HOSTS, sql_list, sql_text
from stallkit.plans.registry import query
from stallkit.sources import taxonomy as C
from stallkit.sources.tables import table

TREE = C.load()
_FLAT = "(VALUES " + ", ".join(f"({c.preorder}, {c.depth}, {sql_text(c.slug)}, {sql_text(c.label)}, {sql_text('/'.join(c.path))}, {sql_text(c.prompt) if c.prompt else 'NULL'}, {c.parent})" for c in TREE) + ") n(preorder, depth, slug, label, path, prompt, parent)"
_COLUMNS = ("preorder", "slug", "label", "prompt")


def _nodes(spark: SparkSession) -> DataFrame:
    return C.nodes(spark, TREE)


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*_COLUMNS)


@query(f"SELECT max(preorder) AS preorder, slug, arg_max(label, preorder) AS label, max_by(coalesce(prompt, ''), preorder) AS prompt FROM {_FLAT} GROUP BY slug")
def c1_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The category of every slug."""
    return _shown(C.lookup(_nodes(spark))).withColumn("prompt", F.coalesce("prompt", F.lit("")))


@query(f"SELECT preorder, slug, label, prompt FROM {_FLAT} WHERE slug = 'bicycles' ORDER BY preorder DESC LIMIT 1")
def c2_category(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(C.category(_nodes(spark), "BICYCLES"))


@query(f"SELECT preorder, slug, label, prompt FROM {_FLAT} WHERE depth = 1")
def c3_top_level(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(C.top_level(_nodes(spark)))


@query(f"SELECT preorder, slug, label, prompt FROM {_FLAT} WHERE parent = 0")
def c4_sub_categories(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(C.sub_categories(_nodes(spark), "Goods"))


@query(f"SELECT p.seo_id, p.category[2] AS slug, (SELECT path FROM {_FLAT} WHERE slug = p.category[2] ORDER BY preorder LIMIT 1) AS path FROM products p")
def c5_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The path in the tree of every product's category."""
    first = _nodes(spark).groupBy(F.lower("slug").alias("_slug")).agg(F.min_by("path", "preorder").alias("p"))
    products = table(spark, folder, "products").select("seo_id", F.get("category", F.lit(1)).alias("slug"))
    joined = products.join(F.broadcast(first), F.lower("slug") == F.col("_slug"), "left")  # at most MAX_CATEGORIES rows
    return joined.select("seo_id", "slug", F.array_join("p", "/").alias("path"))


@query(f"SELECT preorder, path, label, prompt FROM {_FLAT}")
def c6_all_categories(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(spark).select("preorder", F.array_join("path", "/").alias("path"), "label", "prompt")


@query(f"SELECT p.seo_id, (SELECT prompt FROM {_FLAT} WHERE parent = 0 AND (slug = p.category[2] OR lower(label) = lower(p.category[2]))) AS prompt FROM products p")
def c7_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The prompt for the attributes of every product."""
    return table(spark, folder, "products").select("seo_id", C.prompt_for(F.col("category"), TREE).alias("prompt"))


_INHERITED = "(VALUES " + ", ".join(f"({sql_text(c.slug)}, {sql_text('; '.join(f'{k}={v}' for k, v in sorted(c.inherited.items())))})" for c in TREE if c.depth == 2 and c.parent == 0) + ") t(slug, attributes)"


@query(f"SELECT p.seo_id, t.attributes FROM products p LEFT JOIN {_INHERITED} ON t.slug = p.category[2]")
def c8_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """The attributes to look for in every product, with those of categories above."""
    attributes = C.attributes_for(F.col("category"), TREE)
    pairs = F.array_sort(F.transform(F.map_entries(attributes), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return table(spark, folder, "products").select("seo_id", F.when(attributes.isNotNull(), F.array_join(pairs, "; ")).alias("attributes"))


@query("SELECT id, found_at, coalesce(lower(categories[1]) = 'goods' AND lower(categories[2]) = 'bicycles', false) AS matches FROM listings")
def c9_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a listing lies in a branch of the tree."""
    wanted = F.array(F.lit("Goods"), F.lit("BICYCLES"))
    return table(spark, folder, "listings").select("id", "found_at", C.category_matches(wanted, F.col("categories")).alias("matches"))


@query(f"SELECT unnest({sql_list(CATEGORY_HOSTS)}) AS host")
def c10_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(h,) for h in CATEGORY_HOSTS], "host string")

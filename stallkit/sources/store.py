"""Stored tables: creation, handles, writes by key, retention, compaction and the view that names a series of tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkit.sources.schemas import TABLES

#: A day's table of listings takes no more rows after it and goes so long after that. Fixed values.
LISTINGS_ROLLOVER, LISTINGS_KEPT = timedelta(days=1), timedelta(days=14)
#: A table of products is closed at this size and compacted so long after. Fixed values.
PRODUCTS_ROLLOVER_BYTES, PRODUCTS_WARM = 20 << 30, timedelta(days=7)


def create_tables(spark: SparkSession, database: str, location: str) -> list[str]:
    """Creates the stored tables that do not exist, as Parquet under ``location``; others are left as they are."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    made = []
    for name, spec in TABLES.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            by = f"PARTITIONED BY ({spec.partition})" if spec.partition else ""
            spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({spec.columns}) USING parquet {by} LOCATION '{location}/{name}'")
            made.append(name)
    return made


def handle(spark: SparkSession, database: str, name: str) -> DataFrame:
    """A stored table, to be filtered and projected; an unknown name is an error."""
    if name not in TABLES:
        raise KeyError(name)
    return spark.table(f"{database}.{name}")


def latest_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of every key by ``order``; nulls in a key equal each other, nulls in the order come first.

    Rows are compared before the shuffle too, so a key of many rows is no hot one. Of rows that tie in the order one is
    taken; give an order that tells them apart. Columns keep their names and places.
    """
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in keys]
    at = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    if not rest:
        return rows.dropDuplicates(list(keys))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_row"))
    return best.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_row.`{c}`").alias(c) for c in rows.columns])


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; the later write wins.

    Within one side ``order`` says which row came later. Columns that one side lacks are null in its rows.
    """
    both = old.withColumn("_write", F.lit(0)).unionByName(new.withColumn("_write", F.lit(1)), allowMissingColumns=True)
    return latest_by_key(both, keys, ["_write", *order]).drop("_write")


def write_upserted(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> None:
    """Writes ``new`` into the Parquet table at ``path``: a new version is written beside it and then takes its place."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path(path)):
        latest_by_key(new.withColumn("_write", F.lit(1)), keys, ["_write", *order]).drop("_write").write.parquet(path)
        return
    upserted(spark.read.parquet(path), new, keys, order).write.mode("overwrite").parquet(f"{path}.next")
    fs.rename(fs_path(path), fs_path(f"{path}.last"))
    fs.rename(fs_path(f"{path}.next"), fs_path(path))
    fs.delete(fs_path(f"{path}.last"), True)


def retained(rows: DataFrame, time: str, as_of: datetime, rollover: timedelta = LISTINGS_ROLLOVER, kept: timedelta = LISTINGS_KEPT) -> DataFrame:
    """Rows whose table is not yet deleted at ``as_of``: tables roll over each day and go ``kept`` after that.

    A plain bound on the time column, so it reaches the scan and prunes files. A null time goes.
    """
    first_day = (as_of - rollover - kept).replace(hour=0, minute=0, second=0, microsecond=0)
    if first_day + rollover + kept <= as_of:
        first_day += timedelta(days=1)
    return rows.filter(F.col(time) >= F.lit(first_day).cast("timestamp_ntz"))


def is_warm(closed_at: Column, as_of: datetime) -> Column:
    """Whether a table closed at that time is due to be read-only and compacted."""
    return closed_at <= F.lit(as_of - PRODUCTS_WARM).cast("timestamp_ntz")


def compact(spark: SparkSession, path: str, to: str, file_bytes: int = 512 << 20) -> int:
    """Rewrites a closed table into files of about ``file_bytes``; returns their number. One file if it is small."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(fs_path).getLength()
    files = max(1, -(-size // file_bytes))
    spark.read.parquet(path).coalesce(files).write.parquet(to)
    return files


def index_pattern(name: Column) -> Column:
    """The pattern of a series of tables: the name up to its last ``-``, and ``-*``."""
    return F.concat(F.regexp_replace(name, "-[^-]*$", ""), F.lit("-*"))


def bootstrap(spark: SparkSession, alias: str, paths: Sequence[str]) -> DataFrame:
    """The view ``alias`` over a series of Parquet tables of one schema. An existing table of that name is an error, not dropped."""
    if spark.catalog.tableExists(alias) and not spark.catalog.getTable(alias).isTemporary:
        raise ValueError(f"{alias} is a table")
    spark.read.parquet(*paths).createOrReplaceTempView(alias)
    return spark.table(alias)


def copied_listings(listings: DataFrame) -> DataFrame:
    """Listings as their copies are: all columns but ``seo_id`` and ``categories``, which are null."""
    return listings.withColumns({c: F.lit(None).cast(listings.schema[c].dataType) for c in ("seo_id", "categories")})


def new_listings(rows: DataFrame) -> DataFrame:
    """Rows with what a new listing starts with where they lack it: an id, price kind 0 and empty maps."""
    empty = F.create_map().cast("map<string,string>")
    start = {"id": F.uuid(), "price_kind": F.lit(0), "attributes": empty, "metadata": empty}
    return rows.withColumns({c: F.coalesce(F.col(c), v) if c in rows.columns else v for c, v in start.items()})

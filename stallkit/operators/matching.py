"""Listeners and the listings they wait for; missing listings and those that were found again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkit.session import shuffle_width


def listener_matches(listings: DataFrame, listeners: DataFrame) -> DataFrame:
    """``user_id, listener_id, id`` of every listener and listing of its marketplace that has all its filters' attributes.

    ``listeners`` have user_id, id, filters and platform. Names and values are compared without regard to case; a repeated
    filter counts once; a listener without filters takes all listings of its marketplace. Joins are on equal keys
    throughout, never on every pair. Listeners that ask the same are one set of filters until the last join, whose rows are
    the result, so no pair of a listener and a listing is shuffled. A set meets only listings that have its rarest filter.
    """
    name = lambda k, v: F.concat_ws("\x1f", F.lower(k), F.lower(v))
    f = F.transform("filters", lambda f: name(f["name"], f["value"]))
    asked = listeners.select("user_id", F.col("id").alias("listener_id"), "platform", F.array_sort(F.array_distinct(F.coalesce(f, F.array().cast("array<string>")))).alias("f"))
    sets = asked.select("platform", "f").distinct()
    wanted = sets.select("platform", "f", F.explode("f").alias("filter"))
    pairs = listings.select("id", "platform", F.explode("attributes").alias("k", "v")).select("id", "platform", name(F.col("k"), F.col("v")).alias("filter"))
    own = pairs.join(wanted.select("platform", "filter").distinct(), ["platform", "filter"], "left_semi").groupBy("id", "platform").agg(F.collect_set("filter").alias("own"))
    has = own.select("id", "platform", "own", F.explode("own").alias("filter"))
    often = has.groupBy("platform", "filter").agg(F.count("*").alias("n"))
    rarest = wanted.join(often, ["platform", "filter"], "left").groupBy("platform", "f").agg(F.min_by("filter", F.struct(F.coalesce("n", F.lit(0)), "filter")).alias("filter"))
    met = rarest.join(has, ["platform", "filter"]).filter(F.size(F.array_except("f", "own")) == 0).select("platform", "f", "id")
    every = sets.filter(F.size("f") == 0).join(listings.select("id", "platform").distinct(), "platform").select("platform", "f", "id")
    # Few bytes go in and many rows come out: the width stays that of the session, and no side goes through the driver.
    spread = asked.repartition(shuffle_width(asked), "platform", "f").hint("merge")
    return spread.join(met.unionByName(every), ["platform", "f"]).select("user_id", "listener_id", "id")


def still_missing(missing: DataFrame, found: DataFrame) -> DataFrame:
    """Missing listings that no later crawl found: of the listing ids in ``found`` with a later time none is theirs."""
    later = found.groupBy("listing_id").agg(F.max("found_at").alias("last"))
    both = missing.join(later, "listing_id", "left")
    return both.filter(F.col("last").isNull() | (F.col("last") <= F.col("found_at"))).drop("last")

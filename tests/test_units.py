"""Units by evidence and mixture."""

import math

from pyspark.sql import functions as F

from stallkit.functions.folding import fold_for_match
from stallkit.operators.units import assign_units, candidates
from stallkit.plans.prices import priced_listings

SCALES = {"unit": 1.0, "cent": 0.01, "thousand": 1000.0}


def options(spark):
    return candidates(spark.createDataFrame([("EUR", 1.0), ("USD", 0.9), ("NIL", 0.0)], "code string, factor double"), SCALES)


def test_the_mixture_decides_what_evidence_leaves_open(spark):
    known = [(f"k{i}", 100.0 * (1 + i % 7 / 10), "g", "EUR", "unit") for i in range(200)]
    cents = [(f"c{i}", 11_000.0 + 13 * i, "g", "EUR", None) for i in range(60)]
    units = [(f"u{i}", 90.0 + i, "g", "EUR", None) for i in range(60)]
    silent = [("s", 0.12, "g", None, None), ("none", None, "g", "USD", "unit"), ("bad", 5.0, "g", "XXX", None), ("zero", 0.0, None, None, None)]
    df = spark.createDataFrame(known + cents + units + silent, "id string, v double, g string, code string, scale string")
    got = {r.id: r for r in assign_units(df, "v", "g", "code", "scale", options(spark), ["id"]).collect()}
    assert len(got) == df.count()
    assert {got[f"c{i}"].unit_scale for i in range(60)} == {"cent"} and {got[f"u{i}"].unit_scale for i in range(60)} == {"unit"}
    assert math.isclose(got["c0"].common, 110.0) and got["s"].unit_scale == "thousand"
    assert got["none"].unit_code == "USD" and got["none"].common is None
    assert got["bad"].unit_code is None and got["bad"].common is None and got["bad"].uncertain
    assert got["zero"].common is None
    # The same rows among prices a hundred times higher are units: the group's curve decides, not a rule.
    high = df.filter("id like 'c%'").unionByName(df.filter("id like 'k%'").withColumn("v", F.col("v") * 100))
    again = {r.id: r.unit_scale for r in assign_units(high, "v", "g", "code", "scale", options(spark), ["id"]).collect()}
    assert {again[f"c{i}"] for i in range(60)} == {"unit"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, v double, g string, code string, scale string")
    assert assign_units(df, "v", "g", "code", "scale", options(spark), ["id"]).collect() == []


def test_listings(spark):
    rows = [
        ("a", "Fahrrad", "Ich hätte gern USD68.45", None, None), ("b", "Fahrrad", "Preis: 64,14 EUR", 64.14, "EUR"), ("c", "Rad", "Versand 5 GBP", 20.0, "Euro"), ("d", "Rad", "Preis: 64,14 EUR", 6414.0, None),
        ("e", "Rad", None, 12.0, "zł"), ("f", None, None, None, None), ("g", "Rad", "", 3.0, "GBp"), ("b", "Fahrrad", "Preis: 64,14 EUR", 64.14, "EUR"), ("h", "Rad 20 €", "x" * 100_000, None, " "),
    ]
    listings = spark.createDataFrame([(*r, ["goods"]) for r in rows], "id string, title string, description string, price double, currency string, categories array<string>")
    rates = spark.createDataFrame([("EUR", 1.0), ("USD", 0.91), ("GBP", 1.17), ("PLN", 0.23)], "code string, eur_per_unit double")
    got = {r.id: (r.unit_code, r.unit_scale, r.from_text) for r in priced_listings(listings, rates).collect()}
    assert {k: v for k, v in got.items() if k != "f"} == {"a": ("USD", "unit", True), "b": ("EUR", "unit", False), "c": ("EUR", "unit", False), "d": ("EUR", "cent", False), "e": ("PLN", "unit", False), "g": ("GBP", "cent", False), "h": ("EUR", "unit", True)}
    text = spark.createDataFrame([("Ａéé​а",), (None,)], "t string").coalesce(1)
    assert [r.f for r in text.select(fold_for_match(F.col("t")).alias("f")).collect()] == ["Aeea", None]

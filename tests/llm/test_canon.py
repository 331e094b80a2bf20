"""Free values and the entries they mean."""

from stallkit.llm.canon import Matcher, meant_entries
from stallkit.llm.queries import QUERIES
from stallkit.session import local_session

ENTRIES = [(101, "Notebook Computers", ["Laptops"]), (106, "Coffee Makers", ["Kaffeemaschinen", "Cafetières"]), (105, "Bicycles", ["Fahrräder", "Vélos"])]


def test_values():
    m = Matcher(ENTRIES)
    for value, entry in {"COFFEE MAKERS": 106, "Makers, Coffee": 106, "Rubrik Kaffeemalcninen": 106, "cafetieres": 106, "> Bicyces": 105, "Fahrraeder / used": 105, "NOTEBOOKC OMPUTERS": 101, "LAPTOPPS, sonstiges": 101, "Keller muss leer werden": -1, "4711": -1, "???": -1}.items():
        assert m.resolve(value) == entry, value


def test_cases():
    spark = local_session(cores="2", shuffle_partitions=2)
    canon = spark.createDataFrame([(106, "category", "Coffee Makers", ["Cafetières"]), (201, "condition", "as new", []), (300, "brand", "Zystaklex", ["ZYST Werke"])], "entry_id int, entry_kind string, entry_name string, aliases array<string>")
    rows = [("a", "category", "Coffee Makers"), ("b", "category", "Cafetières"), ("b", "category", "Cafetières"), ("c", "category", "  "), ("d", "category", None), ("p", "condition", "unknown"), ("q", "condition", "new, as"), ("p", "brand", "ZSYTAKLEX ®"), ("q", "brand", "no name"), ("r", "brand", "as new")]
    found = meant_entries(spark.createDataFrame(rows, "record_key string, field string, value string"), canon)
    assert sorted(map(tuple, found.collect())) == [("b", "category", 106), ("p", "brand", 300), ("q", "brand", -1), ("q", "condition", 201), ("r", "brand", -1)]
    assert "p7_found" in QUERIES


def test_odd_tables():
    spark = local_session(cores="2", shuffle_partitions=2)
    canon = spark.createDataFrame([(106, "category", "Coffee Makers", None), (107, "category", "Tea Makers", ["Coffee Pots"])], "entry_id int, entry_kind string, entry_name string, aliases array<string>")
    values = spark.createDataFrame([(None, "category", "coffee  makers"), ("l", "category", "Coffee Pots " + "x " * 50_000), ("t", "category", "Coffee Makers, Tea Makers")], "record_key string, field string, value string")
    got = {r.record_key: r.entry_id for r in meant_entries(values, canon).collect()}
    assert got[None] == 106 and got["l"] == 107 and set(got) == {None, "l", "t"}
    assert meant_entries(values.limit(0), canon).collect() == []
    assert {r.entry_id for r in meant_entries(values, canon.limit(0)).collect()} == {-1}

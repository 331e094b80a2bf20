"""Stored tables, reads, search, the category tree and streams on small fixtures."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stallkit.operators import matching, metrics, reads, search
from stallkit.sources import store, taxonomy
from stallkit.streaming.listings import daily_prices, first_seen, read_files, upsert_to

T0 = datetime(2025, 5, 1)


def test_tables_are_made_once(spark, tmp_path):
    assert set(store.create_tables(spark, "made_once", f"file://{tmp_path}")) == set(store.TABLES)
    assert store.create_tables(spark, "made_once", f"file://{tmp_path}") == []
    assert store.handle(spark, "made_once", "products").count() == 0
    with pytest.raises(KeyError):
        store.handle(spark, "made_once", "nope")
    with pytest.raises(ValueError):
        store.bootstrap(spark, "made_once.products", [])
    spark.sql("DROP DATABASE made_once CASCADE")


def test_upserts(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x", T0), (None, 1, "n", T0), ("b", 1, "y", T0)], "id string, platform int, v string, found_at timestamp_ntz")
    new = spark.createDataFrame([("a", 1, "z", T0), ("a", 1, "late", T0 + timedelta(1)), (None, 1, "m", None), ("c", 2, None, T0)], old.schema)
    assert sorted(store.upserted(old, new, ["id", "platform"], ["found_at"]).select("id", "v").collect(), key=repr) == [("a", "late"), ("b", "y"), ("c", None), (None, "m")]
    assert store.upserted(old.limit(0), new.limit(0), ["id"]).collect() == []
    path = str(tmp_path / "t")
    store.write_upserted(spark, path, old, ["id", "platform"], ["found_at"])
    store.write_upserted(spark, path, new, ["id", "platform"], ["found_at"])
    assert spark.read.parquet(path).count() == 4
    assert store.compact(spark, path, str(tmp_path / "c")) == 1


def test_retention(spark):
    rows = spark.createDataFrame([(T0 + timedelta(hours=h),) for h in (0, 23, 24, 48)] + [(None,)], "t timestamp_ntz")
    assert store.retained(rows, "t", T0 + timedelta(days=15) - timedelta(seconds=1)).count() == 4
    assert store.retained(rows, "t", T0 + timedelta(days=15)).count() == 2
    names = spark.createDataFrame([("a-b-000001",), ("x",), (None,)], "n string").coalesce(1)
    assert [r.p for r in names.select(store.index_pattern(F.col("n")).alias("p")).collect()] == ["a-b-*", "x-*", None]


def test_reads(spark):
    rows = spark.createDataFrame([("p", str(i % 3), T0 + timedelta(i // 3), float(i)) for i in range(12)] + [(None, "x", T0, 1.0), ("q", "x", None, 1.0)], "product_seo_id string, listing_id string, found_at timestamp_ntz, price double")
    page = reads.listings_page(rows, "p", T0 + timedelta(2), 4)
    assert [(r.listing_id, r.price) for r in page.collect()] == [("0", 3.0), ("1", 4.0), ("2", 5.0), ("0", 0.0)]
    assert reads.listings_page(rows, "nope").collect() == []
    assert {(r.product_seo_id, r.rn) for r in reads.latest_per_product(rows, 2).collect()} == {("p", 1), ("p", 2), (None, 1), ("q", 1)}
    history = spark.createDataFrame([("p", T0), ("p", T0 - timedelta(90)), ("p", T0 - timedelta(91))], "product_seo_id string, date timestamp_ntz")
    assert reads.price_history_of(history, "p", T0).count() == 2
    plan = page._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("p", "a", T0, 1.0)], "product_seo_id string, listing_id string, found_at timestamp_ntz, price double").write.parquet(f"{tmp_path}/t")
    plan = reads.listings_page(spark.read.parquet(f"{tmp_path}/t"), "p", T0).select("price")._jdf.queryExecution().toString()
    assert "EqualTo(product_seo_id,p)" in plan and "LessThan(found_at" in plan and "TakeOrderedAndProject" in plan


def test_search(spark):
    rows = spark.createDataFrame(
        [("a", "Rotes Fahrrad, 28 Zoll", 50.0, 1, 50.0, 9.0, T0), ("b", "Fahrrad rot", None, 2, None, None, T0), ("c", None, 500.0, 1, 10.0, 9.0, T0 + timedelta(1))],
        "id string, title string, price double, platform int, latitude float, longitude float, found_at timestamp_ntz",
    )
    ids = lambda **how: [r.id for r in search.search_listings(rows, **how).collect()]
    assert ids() == ["c", "a", "b"] and ids(query="FAHRRAD") == ["a", "b"] and ids(query="28 fahrrad") == ["a"] and ids(query="rot rad") == []
    assert ids(min_price=400.0) == ["c", "a", "b"] and ids(max_price=100.0) == ["a"] and ids(min_price=60.0, max_price=600.0) == ["c"]
    assert ids(platforms=["Kleinanzeigen"]) == ["b"] and ids(platforms=["nope"]) == [] and ids(limit=1) == ["c"]
    assert ids(latitude=50.1, longitude=9.1, distance="20km") == ["a"] and ids(latitude=50.1) == ["c", "a", "b"]
    with pytest.raises(ValueError):
        ids(latitude=1.0, longitude=1.0)
    assert search.metres("10 km") == 10_000 and search.metres("5") == 5 and search.metres("1mi") == 1609.344
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 1.0]), (6, [2.0, 0.0])], "vec_id int, embedding array<float>")
    assert [r.vec_id for r in search.nearest_vectors(v, [1.0, 0.0], 3).collect()] == [1, 6, 5]


TREE = """{"Categories": [
  {"slug": "a", "label": "Top", "attributes": {"x": "1"}, "subCategories": [{"slug": "b", "label": "Bee", "attributes": {"X": "2", "y": "3"}}, {"slug": "c", "label": "See", "attributeExtractionPrompt": "P"}]},
  {"slug": "d", "label": "Dee", "subCategories": [{"slug": "B", "label": "Other", "subCategories": [{"slug": "e", "label": "E"}]}]}]}"""


def test_categories(spark, tmp_path):
    file = tmp_path / "c.json"
    file.write_text(TREE)
    tree = taxonomy.load(taxonomy.find_file([tmp_path / "no.json", file]))
    with pytest.raises(FileNotFoundError):
        taxonomy.find_file([tmp_path / "no.json"])
    nodes = taxonomy.nodes(spark, tree)
    assert [r.slug for r in taxonomy.top_level(nodes).orderBy("preorder").collect()] == ["a", "d"]
    assert [r.label for r in taxonomy.category(nodes, "b").collect()] == ["Other"] and taxonomy.lookup(nodes).count() == 5
    assert [r.path for r in taxonomy.resolved_path(nodes, "B").collect()] == [["a", "b"]] and taxonomy.resolved_path(nodes, "zzz").collect() == []
    assert taxonomy.sub_categories(nodes, "B").collect() == [] and taxonomy.sub_categories(nodes, "A").count() == 2
    paths = [["a", "b"], ["a", "zzz"], [], ["zzz"], ["TOP", "b", "see"], ["d", "b", "e"], None, [None]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p array<string>")
    got = df.select("i", taxonomy.attributes_for(F.col("p"), tree).alias("a"), taxonomy.prompt_for(F.col("p"), tree).alias("q")).orderBy("i").collect()
    assert [r.a for r in got] == [{"x": "2", "y": "3"}, {"x": "1"}, None, None, {"x": "2", "y": "3"}, None, None, None]
    assert [r.q for r in got] == [None, None, None, None, "P", None, None, None]
    cases = [([], ["a"], True), (["A"], ["a", "b"], True), (["a", "b"], ["a"], False), (None, ["a"], False), (["a"], None, False)]
    m = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, f array<string>, l array<string>, want boolean")
    assert [r for r in m.select(taxonomy.category_matches(F.col("f"), F.col("l")).alias("ok"), "want").collect() if r.ok != r.want] == []


def test_messages(spark):
    listings = spark.createDataFrame([("l1", 1, {"Color": "red", "size": "M"}), ("l1", 1, {"Color": "red", "size": "M"}), ("l2", 1, {"color": "blue"}), ("l3", 2, None)], "id string, platform int, attributes map<string,string>")
    listeners = spark.createDataFrame([("u", 1, [("color", "RED"), ("Color", "red")], 1), ("u", 2, [("color", "red"), ("size", "L")], 1), ("v", 3, [], 2), ("w", 4, None, 1)], "user_id string, id int, filters array<struct<name:string,value:string>>, platform int")
    assert sorted(map(tuple, matching.listener_matches(listings, listeners).collect())) == [("u", 1, "l1"), ("v", 3, "l3"), ("w", 4, "l1"), ("w", 4, "l2")]
    found = spark.createDataFrame([("a", T0), ("b", T0 + timedelta(1))], "listing_id string, found_at timestamp_ntz")
    missing = spark.createDataFrame([("a", T0), ("b", T0), ("c", T0)], found.schema)
    assert {r.listing_id for r in matching.still_missing(missing, found).collect()} == {"a", "c"}


def test_listeners_that_ask_the_same_meet_listings_once(spark):
    listings = spark.createDataFrame([("l1", 1, {"color": "red", "size": "M"}), ("l1", 1, {"weight": "1"}), ("l2", 1, {"color": "red", "size": "L"}), ("l3", 2, {"color": "red"}), ("l4", None, {"color": "red"})], "id string, platform int, attributes map<string,string>")
    both, odd = [("Size", "m"), ("color", "red")], [("color", None)]
    listeners = spark.createDataFrame([("u", i, both[::-1] if i % 2 else both, 1) for i in range(4)] + [("u", 0, both, 1), ("v", 9, both, 2), ("x", 5, odd, 1), ("y", 6, [*both, ("weight", "1")], 1), ("z", 7, [("color", "red")], None)], "user_id string, id int, filters array<struct<name:string,value:string>>, platform int")
    got = matching.listener_matches(listings, listeners)
    assert sorted(map(tuple, got.collect())) == [("u", 0, "l1"), ("u", 0, "l1"), ("u", 1, "l1"), ("u", 2, "l1"), ("u", 3, "l1"), ("y", 6, "l1")]
    # No shuffle holds pairs: the last join is not grouped again, and listeners don't go through the driver.
    plan = got._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert "SortMergeJoin" in next(line for line in plan if "Join" in line or "Aggregate" in line)


def test_statistics(spark):
    rows = spark.createDataFrame([("p", 1.0), ("p", 2.0), ("p", 3.0), ("p", 10.0), ("p", None), ("p", -1.0), (None, 5.0)], "k string, price double")
    got = {r.k: (r.average_price, r.median_price, r.min_price, r.max_price, r.sample_count) for r in metrics.price_stats(rows, ["k"], "price").collect()}
    assert got == {"p": (4.0, 2.5, 1.0, 10.0, 4), None: (5.0, 5.0, 5.0, 5.0, 1)}
    products = spark.createDataFrame([(f"p{i:03}",) for i in range(25)] + [(None,), ("p000",)], "seo_id string")
    placed = {(r.partition_id, r.entry_index): r.seo_id for r in metrics.sitemap(products, 10).collect()}
    assert placed == {(i // 10, i % 10): f"p{i:03}" for i in range(25)}
    assert metrics.sitemap(products.limit(0)).collect() == []


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, T0, 5.0), ("a", 1, T0 + timedelta(hours=1), 6.0), ("b", 1, T0, None), ("c", 1, T0 + timedelta(9), 1.0)], "id string, platform int, found_at timestamp_ntz, price double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = read_files(spark, f"{tmp_path}/in", "id string, platform int, found_at timestamp_ntz, price double")
    q = first_seen(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]
    upsert_to(stream, f"{tmp_path}/t", ["id", "platform"], ["found_at"], f"{tmp_path}/c2").awaitTermination()
    assert {(r.id, r.price) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {("a", 6.0), ("b", None), ("c", 1.0)}
    days = daily_prices(stream.withColumnRenamed("id", "product_seo_id"))
    q = days.writeStream.format("parquet").option("path", f"{tmp_path}/days").option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.product_seo_id, r.sample_count, r.max_price) for r in spark.read.parquet(f"{tmp_path}/days").collect()] == [("a", 2, 6.0)]

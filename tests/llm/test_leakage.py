"""Leaked passages and questions with new values."""

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallkit.llm import leakage
from stallkit.session import local_session

ITEM = "The convoy from Brunsel dropped 204 boxes near the river, so the office in Velden paid 90 crowns for each of them. Only 17 boxes with a stamp were repaired before the ride to Quellhain."


@pytest.fixture(scope="module")
def spark():
    return local_session(cores="2", shuffle_partitions=2)


def frames(spark, docs, items=(ITEM, None, "", "too short")):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("template", F.lit("clash"))
    return d, spark.createDataFrame([(i + 100, t) for i, t in enumerate(items)], "item_id long, text string")


def found(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def test_template_and_slots_both_decide(spark):
    docs = [
        ITEM, "x " + ITEM.upper().replace(" ", "\n") + " y", "nothing here", None, "", ITEM.replace("204", "311").replace("Brunsel", "Hohenfeld").replace("Velden", "Talheim").replace("90", "75").replace("17", "23").replace("Quellhain", "Ellern"),
        "dropped 204 boxes near the river, so the office in Velden paid", "dropped 204 boxes near the river, so the office in Velden", "Ｔｈｅ convoy from Brunsel dropped ２０４ boxes near the river, so the",
        "dropped 204 boxes near the lake, so the office in Velden paid 90", ITEM + " " + "word " * 50_000,
    ]
    d, i = frames(spark, docs)
    assert found(leakage.leaked(d, i)) == {(k, 100) for k in (0, 1, 6, 8, 10)}
    a, b = leakage.template_joined(d, i, False)
    by_template = b.join(a, a["template"] == b["template"]).select("doc_id", "item_id").distinct()
    by_slots = b.join(a, a["slots"] == b["doc_slots"]).select("doc_id", "item_id").distinct()
    assert (5, 100) in found(by_template) and (5, 100) not in found(leakage.leaked(d, i))
    assert found(leakage.leaked(d, i)) <= found(by_slots)
    assert found(leakage.reparameterised(d, i)) == {(5, 100)}


def test_new_values_may_have_other_word_counts(spark):
    other = ITEM.replace("90", "75").replace("17", "23").replace("Quellhain", "Ellern").replace("Velden", "Talheim")
    longer = other.replace("204", "1,204").replace("Brunsel", "Bad Hohenfeld")
    swapped = other.replace("204", "311").replace("Brunsel", "Talheim")
    d, i = frames(spark, [longer, swapped])
    rows = {r.doc_id: r.n_windows for r in leakage.reparameterised(d, i).collect()}
    assert rows[0] >= 10
    # In windows that hold both names, one name stands for two of the item's.
    assert rows.get(1, 0) < rows[0]


def test_empty_tables(spark):
    d, i = frames(spark, [ITEM])
    for a, b in ((d.limit(0), i), (d, i.limit(0))):
        assert leakage.leaked(a, b).collect() == [] and leakage.reparameterised(a, b).collect() == []


def test_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = ["the", "a", "box", "of", "Velden", "204", "paid", "crowns", "Anna", "river", "7"]
    items = [" ".join(r.choice(vocabulary) for _ in range(30)) for _ in range(6)]
    docs = []
    for _ in range(60):
        own = [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        source = r.choice(items).split()
        n = r.randint(8, 16)
        at, to = r.randint(0, 30 - n), r.randint(0, len(own))
        docs.append(" ".join(own[:to] + source[at : at + n] + own[to:]))

    def runs(t):
        w = re.findall(r"\w+", unicodedata.normalize("NFKC", t).lower())
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = {(d, i + 100) for d, x in enumerate(docs) for i, y in enumerate(items) if runs(x) & runs(y)}
    d, i = frames(spark, docs, items)
    assert want and found(leakage.leaked(d, i)) == want


def test_filter_bits(spark):
    df = spark.createDataFrame([(5,), (-1,), (1 << 40,)], "template long")
    bits = leakage.template_bits(df)
    on = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
    assert on.tolist() == [0, 5, leakage.FILTER_BITS - 1]

"""The consistent form against the standard library."""

import random
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stallkit.llm import unicode_fold as U
from stallkit.session import local_session

LETTERS = [c for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c.isalpha()]
MARKS = [chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)) and c not in (0x34F,)]


def fold(*texts):
    out, odd = U.fold_array(pa.array(texts, pa.string()))
    return out.to_pylist(), odd.tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(LETTERS[:120] + LETTERS[-60:] + MARKS + [" ", "\n", "1"]), max_size=12), max_size=5))
def test_composition_is_that_of_the_standard_library(texts):
    assert fold(*texts)[0] == [unicodedata.normalize("NFC", t) for t in texts]


def test_many_random_strings():
    r = random.Random(5)
    texts = ["".join(r.choice(MARKS if r.random() < 0.5 else LETTERS) for _ in range(r.randint(1, 9))) for _ in range(20_000)]
    assert fold(*texts)[0] == [unicodedata.normalize("NFC", t) for t in texts]
    hangul = ["".join(chr(r.choice([0x1100 + r.randint(0, 18), 0x1161 + r.randint(0, 20), 0x11A8 + r.randint(0, 26), 0xAC00 + 28 * r.randint(0, 300)])) for _ in range(6)) for _ in range(3000)]
    assert fold(*hangul)[0] == [unicodedata.normalize("NFC", t) for t in hangul]


def test_forms():
    cases = {
        "Ｆｕｌｌ　Ｗ": ("Full W", U.WIDE | U.SPACE), "été": ("été", U.MARK), "a​b­c﻿": ("abc", U.INVISIBLE), "a b": ("a b", U.SPACE), "Роrto": ("Porto", U.MIXED),
        "слово": ("слово", 0), "ﬁn": ("fin", 0), "™ ² ½ №": ("™ ² ½ №", 0), "a\r\n\tb": ("a\r\n\tb", 0), "ṛ̌": ("ṛ̌", U.MARK), "xㅤy️": ("xy", 0), "❤️": ("❤️", 0), "": ("", 0),
    }
    got, odd = fold(*cases)
    assert list(zip(got, odd, strict=True)) == list(cases.values())
    family = "\U0001f468‍\U0001f469‍\U0001f467"
    assert fold(family, None)[0] == [family, None]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_a_second_application_changes_nothing(text):
    once = fold(text)[0]
    assert fold(*once)[0] == once


def test_frames():
    spark = local_session(cores="2", shuffle_partitions=2)
    df = spark.createDataFrame([(1, "Ａ", None, "x"), (2, "", "é" * 300_000, "y"), (3, None, "é", "z")], "id int, title string, body string, title_folded string").coalesce(1)
    out = U.fold_text(df, ["title", "body"])
    assert out.columns == ["id", "title", "body", "title_folded", "title_odd", "body_folded", "body_odd"]
    rows = out.select("title_folded", "title_odd", F.length("body_folded").alias("n"), "body_odd").collect()
    assert [tuple(r) for r in rows] == [("A", U.WIDE, None, 0), ("", 0, 300_000, 0), (None, 0, 1, U.MARK)]
    assert U.fold_text(df.limit(0), ["title"]).collect() == []


@pytest.mark.parametrize("n", [0, 1, 3])
def test_sliced_arrays(n):
    a = pa.array(["aé", None, "Ｂ", "ć"], pa.string()).slice(n)
    assert U.fold_array(a)[0].to_pylist() == ["aé", None, "B", "ć"][n:]

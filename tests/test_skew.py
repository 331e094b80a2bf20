"""Counts per key over cut keys."""

import pytest

from stallkit.operators.skew import balanced_counts


def brute(rows):
    out = {}
    for k, v in rows:
        n, seen = out.setdefault(k, [0, set()])
        out[k][0] = n + 1
        seen |= {v} - {None}
    return {k: (n, len(s)) for k, (n, s) in out.items()}


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_keys_cut_into_ranges(spark, ranges):
    rows = [("hot", f"v{i % 11}") for i in range(900)] + [("hot", "same")] * 400 + [(f"k{i % 50}", f"v{i % 3}") for i in range(300)] + [(None, "a"), (None, "a"), (None, None), ("", None), ("n", None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "key string, value string, k string, r int")
    got = {r.key: (r.n_rows, r.n_distinct) for r in balanced_counts(df, "key", "value", ranges).collect()}
    assert got == brute(rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], "key string, value string")
    assert balanced_counts(df, "key", "value").collect() == []

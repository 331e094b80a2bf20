"""Percentiles by multi-select against numpy."""

import numpy as np
import pytest

from stallkit.llm.quantiles import build_runs, select_quantiles, weighted_medians
from stallkit.session import local_session

QS = (0.0, 0.25, 0.5, 0.9, 1.0)


@pytest.fixture(scope="module")
def spark():
    return local_session(cores="2", shuffle_partitions=3)


def check(spark, groups, **how):
    rows = [(k, float(v), i) for k, vals in groups.items() for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "key string, value double, i int")
    runs = build_runs(df, "key", "value", ["i"], run_rows=16)
    got = {r.k: (r.n, r.q) for r in select_quantiles(runs, QS, **how).collect()}
    assert set(got) == set(groups)
    for k, vals in groups.items():
        assert got[k][0] == len(vals)
        s = np.sort(np.asarray(vals, float))
        for q, x in zip(QS, got[k][1], strict=True):
            at = (len(s) - 1) * q
            lo, hi = s[int(np.floor(at))], s[int(np.ceil(at))]
            assert x == lo if lo == hi else x == pytest.approx(lo + (hi - lo) * (at - np.floor(at))), (k, q)


def test_rounds_of_groups_of_all_sizes(spark):
    r = np.random.default_rng(1)
    groups = {"big": r.lognormal(4, 1, 3000), "ties": r.integers(0, 3, 900), "one": [7.0], "two": [1.0, 4.0], "same": [5.0] * 200, "": [-1.0, -2.0, 0.0]}
    check(spark, groups, finish_rows=2)
    check(spark, groups)


def test_infinite_values_are_values(spark):
    r = np.random.default_rng(2)
    check(spark, {"a": [-np.inf] * 90 + [np.inf] * 150 + list(r.normal(size=360)), "b": [np.inf, np.inf], "c": [-np.inf]}, finish_rows=1)


def test_nulls_and_nan_are_left_out_and_no_rows_give_none(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), (None, 3.0)], "key string, value double")
    assert [(r.k, r.n, r.q) for r in select_quantiles(build_runs(df, "key", "value"), (0.5,)).collect()] == [("a", 1, [1.0])]
    assert select_quantiles(build_runs(df.limit(0), "key", "value"), (0.5,)).collect() == []


def test_runs_of_days_combine(spark):
    days = [spark.createDataFrame([("a", float(v)) for v in range(i, 300, 3)], "key string, value double") for i in range(3)]
    runs = build_runs(days[0], "key", "value").unionByName(build_runs(days[1], "key", "value")).unionByName(build_runs(days[2], "key", "value"))
    assert [(r.n, r.q) for r in select_quantiles(runs, (0.5,), finish_rows=4).collect()] == [(300, [149.5])]


def test_weighted_medians():
    at, whole = weighted_medians((np.array([0, 1, 0, 0]),), np.array([3.0, 9.0, 1.0, 2.0]), np.array([1, 5, 1, 3]))
    assert at.tolist() == [3, 1] and whole.tolist() == [5, 5]


def test_a_quantile_lies_between_0_and_1(spark):
    with pytest.raises(ValueError):
        select_quantiles(spark.createDataFrame([], "k string, slot int, vals array<double>"), (1.5,))

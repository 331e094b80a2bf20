"""Units of recorded quantities, by evidence where there is some and by a log-scale mixture where there is none.

Every value is a number in one of several units; a unit multiplies the number by a known factor to give the common one.
In log scale a group's values in common units follow one normal curve, so in recorded units they follow a mixture of
that curve shifted by the known factors. Shares, centres and widths are fitted by EM on a histogram (group, evidence,
bin of 0.02 in log10), which is one pass over the rows whatever their number; each row then gets its most probable unit,
the probability, and a flag where that is under ``SURE``.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallkit.session import Workspace

BIN = 0.02
#: Far more rounds than any fit seen needs; whoever reaches it is told.
MOST_ROUNDS = 100
SETTLED = 1e-3
SURE = 0.95
#: Odds against a unit that the evidence doesn't name, where it leaves the unit open, and where it names another one.
UNNAMED, DENIED = 1e-3, 1e-9
#: Least share of an option.
LEAST = 1e-6
#: Density of numbers that fit no curve, so that an outlier speaks for no unit over all evidence.
OUTLIER = 1e-4
_MIN_SD, _START_SD = 0.15, 0.6


def candidates(units: DataFrame, scales: dict[str, float]) -> list[tuple[str, str, float]]:
    """``(code, scale, shift)`` of each unit at each scale, shift in log10. ``units`` has code, factor.

    The list of units is a fixed reference table; more than 1000 rows of it are refused.
    """
    rows = units.filter(F.col("factor") > 0).orderBy("code").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("the table of units has more than 1000 rows")
    return [(r["code"], s, math.log10(r["factor"] * f)) for r in rows for s, f in scales.items()]


def _posterior(pdf: pd.DataFrame, options: list, shares: dict[str, float]) -> np.ndarray:
    """Probability of every option (columns) for every row; 0 throughout for a code that no option has.

    Shares of the options, how well the number in the option's common unit fits the group's curve, and the odds that the
    evidence speaks of another option are multiplied.
    """
    codes, scales, shifts = (np.array(x) for x in zip(*options, strict=True))
    code, scale = pdf["code"].to_numpy(object), pdf["scale"].to_numpy(object)
    no_code, no_scale = pd.isna(code)[:, None], pd.isna(scale)[:, None]
    ok = (no_code | np.isin(code.astype(str), codes)[:, None]) & np.ones(len(options), bool)
    denied = math.log(DENIED) * (~(no_code | (code[:, None] == codes)) + ~(no_scale | (scale[:, None] == scales)))
    if shares:
        kinds = pdf["kind"].to_numpy(object)
        prior = np.zeros(ok.shape)
        for kind in set(kinds):
            prior[kinds == kind] = [math.log(shares.get(f"{kind}|{c}|{s}", LEAST)) for c, s, _ in options]
    else:
        prior = np.where((scales == "unit") & (~no_code | (shifts == 0)), 0.0, math.log(UNNAMED))
    x, sd = pdf["x"].to_numpy(float)[:, None], pdf["sd"].to_numpy(float)[:, None]
    z = (x + shifts - pdf["m"].to_numpy(float)[:, None]) / sd
    like = np.where(ok, denied + prior + np.logaddexp(np.nan_to_num(-z * z / 2 - np.log(sd)), math.log(OUTLIER)), -np.inf)
    top = like.max(axis=1, keepdims=True)
    e = np.where(ok, np.exp(like - np.where(np.isfinite(top), top, 0)), 0)
    return e / np.maximum(e.sum(axis=1, keepdims=True), 1e-300)


def _kind() -> Column:
    return F.when(F.col("code").isNull() & F.col("scale").isNull(), "none").when(F.col("scale").isNull(), "code").otherwise("both")


def assign_units(df: DataFrame, value: str, group: str, code: str, scale: str, options: list[tuple[str, str, float]], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns with ``unit_code, unit_scale, probability, uncertain, common``.

    ``code`` and ``scale`` are what evidence says of a row, null where it says nothing. Options it does not name keep small
    odds; where it says nothing of a part, the options compete by shares fitted to such rows and by the group's curve.
    A null, NaN or non-positive value has no magnitude: its unit is what evidence and shares say, its ``common`` is null.
    A code that no option has gives null units. ``keep`` must not use the names of the result.
    """
    ws = Workspace(df.sparkSession, "units")
    inner = {c: f"keep{i}" for i, c in enumerate(keep)}
    x = F.when((F.col(value) > 0) & ~F.isnan(value), F.log10(value))
    rows = ws.cut(df.select(*[F.col(c).alias(i) for c, i in inner.items()], x.alias("x"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), F.col(code).alias("code"), F.col(scale).alias("scale")), "rows")
    hist = rows.filter(F.col("x").isNotNull()).groupBy("g", "code", "scale", F.round(F.col("x") / BIN).cast("int").alias("b")).agg(F.count("*").alias("w"))
    hist = ws.cut(hist.select("g", "code", "scale", (F.col("b") * BIN).alias("x"), "w", _kind().alias("kind")), "histogram")
    shift = {f"{c}|{s}": v for c, s, v in options}

    def step(shares: dict[str, float]):
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                p = _posterior(pdf, options, shares) * pdf["w"].to_numpy(float)[:, None]
                i, j = np.nonzero(p > 1e-9)
                y = pdf["x"].to_numpy(float)[i] + np.array([o[2] for o in options])[j]
                out = pd.DataFrame({"g": pdf["g"].to_numpy(object)[i], "kind": pdf["kind"].to_numpy(object)[i], "u": np.array([f"{o[0]}|{o[1]}" for o in options])[j], "r": p[i, j]})
                yield out.assign(ry=out["r"] * y, ryy=out["r"] * y * y).groupby(["g", "kind", "u"], as_index=False).sum()

        return score

    # Centres begin at what wholly known rows say of their group, or of all groups.
    known = hist.filter(F.col("code").isNotNull() & F.col("scale").isNotNull()).select("g", "w", (F.col("w") * (F.col("x") + F.try_element_at(F.create_map(*[F.lit(v) for kv in shift.items() for v in kv]), F.concat_ws("|", "code", "scale")))).alias("wy"))
    overall = known.agg(F.sum("wy") / F.sum("w")).first()[0]
    start = hist.select("g").distinct().join(known.groupBy("g").agg((F.sum("wy") / F.sum("w")).alias("m")), "g", "left")
    centres = ws.cut(start.select("g", F.coalesce("m", F.lit(2.0 if overall is None else overall)).alias("m"), F.lit(_START_SD).alias("sd")), "centres0")
    shares: dict[str, float] = {}
    for turn in range(MOST_ROUNDS):
        parts = hist.join(centres, "g").mapInPandas(step(shares), "g string, kind string, u string, r double, ry double, ryy double")
        parts = ws.cut(parts.groupBy("g", "kind", "u").agg(F.sum("r").alias("r"), F.sum("ry").alias("ry"), F.sum("ryy").alias("ryy")), f"parts{turn}")
        mean = F.sum("ry") / F.sum("r")
        spread = F.sqrt(F.greatest(F.lit(0.0), F.sum("ryy") / F.sum("r") - mean * mean))
        centres, old = ws.cut(parts.groupBy("g").agg(mean.alias("m"), F.greatest(F.lit(_MIN_SD), spread).alias("sd")), f"centres{turn + 1}"), f"centres{turn}"
        # One row for each kind of evidence and option: a fixed number.
        totals = parts.groupBy("kind", "u").agg(F.sum("r").alias("r")).collect()
        whole: dict[str, float] = {}
        for t in totals:
            whole[t["kind"]] = whole.get(t["kind"], 0.0) + t["r"]
        before, shares = shares, {f"{t['kind']}|{t['u']}": max(LEAST, t["r"] / whole[t["kind"]]) for t in totals}
        ws.drop(old)
        ws.drop(f"parts{turn}")
        if not totals or before and all(abs(v - before.get(k, 0)) < SETTLED for k, v in shares.items()):
            break
    else:
        warnings.warn(f"shares of units still move after {MOST_ROUNDS} rounds", RuntimeWarning, stacklevel=2)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = _posterior(pdf, options, shares)
            at, top = p.argmax(axis=1), p.max(axis=1)
            none = top <= 0
            pick = lambda i: np.where(none, None, np.array([o[i] for o in options], object)[at])  # noqa: E731,B023
            yield pdf[list(inner.values())].assign(unit_code=pick(0), unit_scale=pick(1), probability=top, uncertain=top < SURE, common=np.where(none, np.nan, 10 ** (pdf["x"].to_numpy(float) + np.array([o[2] for o in options])[at])))

    told = rows.withColumn("kind", _kind()).join(centres, "g", "left").fillna({"m": 2.0, "sd": _START_SD})
    fields = [f for f in rows.schema if f.name in inner.values()]
    schema = T.StructType([*fields, *T.StructType.fromDDL("unit_code string, unit_scale string, probability double, uncertain boolean, common double")])
    out = told.select(*inner.values(), "x", "code", "scale", "kind", "m", "sd").mapInPandas(best, schema)
    return out.select(*[F.col(i).alias(c) for c, i in inner.items()], "unit_code", "unit_scale", "probability", "uncertain", F.when(~F.isnan("common"), F.col("common")).alias("common"))

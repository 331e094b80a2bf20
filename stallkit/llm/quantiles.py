"""Exact percentiles per group by distributed multi-select over mergeable sorted runs.

A *run* is a sorted array of some of a group's values, as one partition, day or file holds them. Runs are the partial
state: the runs of two inputs are combined by ``union`` and give the percentiles of both together, without error.

``select_quantiles`` finds ranks in the union of a group's runs, for every group by the same rounds. Each round every run
proposes local quantiles at the wanted rank's relative place (the local median, for a median), and one a little to either
side unless it holds the whole group; the weighted median of the proposals becomes a pivot; the runs count values below
and equal to each pivot; the values outside the range that can hold the rank are discarded, which rewrites the runs. What
a round leaves of a rank's range, once it is down to ``FINISH_ROWS`` values, is sorted. The error is zero, the bound is on
the rounds: a weighted median of medians rules out a fixed share of the values that remain.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkit.session import Workspace, shuffle_width

#: ``slot`` is the partition that made the run. A join on group and slot has no hot key, whatever a group holds.
RUN = "k string, slot int, vals array<double>"
#: Values that one task sorts of what a round has left of a rank's range.
FINISH_ROWS = 4096
#: Values of one run at most, so that a batch of runs is small whatever the skew.
RUN_ROWS = 1024
MAX_ROUNDS = 200


def _make_runs(run_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(0).dictionary_encode()
            codes = k.indices.to_numpy(zero_copy_only=False)
            v = batch.column(1).to_numpy(zero_copy_only=False)
            order = np.lexsort((v, codes))
            codes, v = codes[order], v[order]
            size = np.bincount(codes)
            within = np.arange(len(v)) - np.repeat(np.cumsum(size) - size, size)
            # A group of many values is dealt to its runs like cards, so each is a fair sample.
            deal = within % np.repeat(-(-size // run_rows), size)
            order = np.lexsort((within, deal, codes))
            codes, v, deal = codes[order], v[order], deal[order]
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(codes) != 0) | (np.diff(deal) != 0)]))
            offsets = np.append(starts, len(v)).astype(np.int32)
            vals = pa.ListArray.from_arrays(pa.array(offsets), pa.array(v))
            yield pa.record_batch([k.dictionary.take(pa.array(codes[starts])), pa.array(np.full(len(starts), slot, np.int32)), vals], names=["k", "slot", "vals"])

    return run


def build_runs(df: DataFrame, key: str, value: str, spread: Sequence[str] = (), run_rows: int = RUN_ROWS) -> DataFrame:
    """The runs of ``df``: ``k, slot, vals``.

    Rows are range-partitioned by group and a hash of the ``spread`` columns, which should tell rows apart; a group of
    many rows lies in as many partitions as its share needs. Without ``spread`` the row number tells them apart; let
    ``df`` be a scan or a written table then.

    Rows with a null key, or a value that is null or NaN, are left out. An empty table gives no runs.
    """
    v = F.col(value).cast("double")
    apart = [F.col(c) for c in spread] or [F.monotonically_increasing_id()]
    rows = df.select(F.col(key).cast("string").alias("k"), v.alias("v"), F.xxhash64(*apart).alias("h"))
    rows = rows.filter(F.col("k").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    rows = rows.repartitionByRange(shuffle_width(rows), "k", "h").sortWithinPartitions("k")
    return rows.select("k", "v").mapInArrow(_make_runs(run_rows), RUN)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.Array]:
    """Offsets into the flat elements of a list column, and the elements."""
    col = batch.column(batch.schema.get_field_index(name))
    flat = col.flatten()
    lengths = col.value_lengths().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]), flat


def _numbers(flat: pa.Array, field: str) -> np.ndarray:
    return flat.field(flat.type.get_field_index(field)).to_numpy(zero_copy_only=False)


def _paired(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """For every (run, state) of a batch: the row, and start and end of its values; then all values and states."""
    at, vals = _lists(batch, "vals")
    to, states = _lists(batch, "state")
    row = np.repeat(np.arange(batch.num_rows), np.diff(to))
    return row, at[:-1][row], at[1:][row], vals.to_numpy(zero_copy_only=False), states


def _search(flat: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, side: str) -> np.ndarray:
    """``searchsorted`` of each x in its own sorted stretch lo:hi of ``flat``."""
    lo, hi = lo.copy(), hi.copy()
    while (live := lo < hi).any():
        mid = (lo + hi) // 2
        probe = flat[np.minimum(mid, len(flat) - 1)]
        up = live & ((probe < x) if side == "left" else (probe <= x))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(live & ~up, mid, hi)
    return lo


def weighted_medians(groups: Sequence[np.ndarray], v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with equal ``groups``: the place of the row that holds the weighted median of ``v``, and the weight of all."""
    order = np.lexsort((v, *reversed(groups)))
    w = w[order]
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for g in groups:
        fresh[1:] |= np.diff(g[order]) != 0
    starts = np.flatnonzero(fresh)
    whole = np.add.reduceat(w, starts) if len(starts) else w
    group = np.cumsum(fresh) - 1
    run = np.cumsum(w)
    seen = run - np.repeat((run - w)[starts], np.diff(np.append(starts, len(w))))
    enough = seen * 2 >= whole[group]
    ends = np.append(starts[1:], len(w))
    return order[ends - np.add.reduceat(enough.astype(np.int64), starts)] if len(starts) else order, whole


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, a, b, flat, states = _paired(batch)
        if not len(row):
            continue
        rank, left, target = (_numbers(states, f) for f in ("rank", "left", "target"))
        n = b - a
        q = rank / np.maximum(1, left - 1)
        slack = np.where(n == left, 0, 1.5 / np.sqrt(np.maximum(4, left)) + 1e-3)
        k = batch.column(0).dictionary_encode()
        code = k.indices.to_numpy(zero_copy_only=False)[row]
        parts = []
        for i in (-1, 0, 1):
            use = np.flatnonzero((n < left) | (i == 0))
            place = a + np.rint(np.clip(q + i * slack, 0, 1) * (n - 1)).astype(np.int64)
            parts.append((code[use], target[use], np.full(len(use), i), flat[place[use]], n[use]))
        code, target, i, v, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        at, w = weighted_medians((code, target, i), v, w)
        yield pa.record_batch([k.dictionary.take(pa.array(code[at])), pa.array(target[at]), pa.array(i[at].astype(np.int32)), pa.array(v[at]), pa.array(w)], names=["k", "target", "i", "v", "w"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, a, b, flat, states = _paired(batch)
        target, p = _numbers(states, "target"), _numbers(states, "p")
        below, upto = (_search(flat, a, b, p, side) - a for side in ("left", "right"))
        yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(target), pa.array(p), pa.array(below), pa.array(upto)], names=["k", "target", "p", "below", "upto"])


def _discard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, a, b, flat, states = _paired(batch)
        if not len(row):
            continue
        target, lo, hi, low_set, high_set = (_numbers(states, f) for f in ("target", "lo", "hi", "low_set", "high_set"))
        start = np.where(low_set, _search(flat, a, b, lo, "right"), a)
        end = np.where(high_set, _search(flat, a, b, hi, "left"), b)
        keep = np.flatnonzero(end > start)
        size = (end - start)[keep]
        offsets = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(start[keep] - offsets[:-1], size) + np.arange(offsets[-1])
        vals = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat[at]))
        rows = pa.array(row[keep])
        yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), vals, pa.array(target[keep])], names=["k", "slot", "vals", "target"])


def _rank_targets(n: Column, qs: Sequence[float]) -> Column:
    """Zero-based ranks below and above each quantile's place (n-1)*q."""
    return F.array_distinct(F.flatten(F.array(*[F.array(F.floor((n - 1) * F.lit(q)), F.ceil((n - 1) * F.lit(q))) for q in qs])))


def _between(at: Column, lo: Column, hi: Column) -> Column:
    share = at - F.floor(at)
    return F.when((share == 0) | (lo == hi), lo).otherwise(lo + (hi - lo) * share)


def _weighted_median() -> Column:
    """Over rows ``v, w`` of one pivot: as many as partitions or batches made proposals."""
    ordered = F.array_sort(F.collect_list(F.struct("v", "w")))
    half = F.aggregate(ordered, F.lit(0).cast("bigint"), lambda acc, x: acc + x["w"]) / 2
    first = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("v"))
    return F.aggregate(ordered, first, lambda acc, x: F.struct((acc["seen"] + x["w"]).alias("seen"), F.coalesce(acc["v"], F.when(acc["seen"] + x["w"] >= half, x["v"])).alias("v")))["v"]


def select_quantiles(runs: DataFrame, qs: Sequence[float], finish_rows: int = FINISH_ROWS) -> DataFrame:
    """Quantiles of every group of ``runs``: ``k, n, q`` with ``q`` an array in the order of ``qs``.

    Between two ranks the value is interpolated, so the median of an even number is the mean of the two in the middle.
    Infinite values are values like others. No runs give no rows.
    """
    for q in qs:
        if not 0 <= q <= 1:
            raise ValueError(f"a quantile lies between 0 and 1, not at {q}")
    ws = Workspace(runs.sparkSession, "quantiles")
    values = ws.cut(runs, "runs")
    sizes = ws.cut(values.groupBy("k").agg(F.sum(F.size("vals")).cast("bigint").alias("n")), "sizes")
    where = ws.cut(values.select("k", "slot").distinct(), "where")
    keys = ["k"]

    def attach(state: DataFrame, fields: Sequence[str], name: str) -> DataFrame:
        """Each run with the array of its group's states."""
        packed = state.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("state"))
        placed = ws.cut(packed.join(where, "k"), name)
        return values.join(placed, [*keys, "slot"]).select("k", "slot", "vals", "state")

    rank = F.explode(_rank_targets(F.col("n"), qs)).alias("target")
    state = sizes.select("k", rank, F.col("n").alias("left")).select("k", F.col("target").cast("bigint").alias("target"), F.col("target").cast("bigint").alias("rank"), "left")
    settled: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        proposals = attach(state, ["target", "rank", "left"], f"asked{turn}").mapInArrow(_propose, "k string, target bigint, i int, v double, w bigint")
        pivots = proposals.groupBy("k", "target", "i").agg(_weighted_median().alias("p")).select("k", "target", "p").distinct()
        counts = attach(pivots, ["target", "p"], f"pivots{turn}").mapInArrow(_count, "k string, target bigint, p double, below bigint, upto bigint")
        counts = counts.groupBy("k", "target", "p").agg(F.sum("below").alias("below"), F.sum("upto").alias("upto"))
        counts = counts.groupBy("k", "target").agg(F.collect_list(F.struct("p", "below", "upto")).alias("c"))
        r = F.col("rank")
        hit = F.get(F.filter("c", lambda x: (x["below"] <= r) & (r < x["upto"])), F.lit(0))["p"]
        under = F.array_max(F.transform(F.filter("c", lambda x: x["upto"] <= r), lambda x: F.struct(x["p"], x["upto"])))
        over = F.array_min(F.transform(F.filter("c", lambda x: x["below"] > r), lambda x: F.struct(x["p"], x["below"])))
        told = state.join(counts, ["k", "target"]).select("k", "target", "rank", "left", hit.alias("found"), under.alias("u"), over.alias("o"))
        gone = F.coalesce(F.col("u.upto"), F.lit(0))
        new = told.select(
            "k", "target", (r - gone).alias("rank"), (F.coalesce("o.below", "left") - gone).alias("left"), "found",
            F.coalesce("u.p", F.lit(0.0)).alias("lo"), F.coalesce("o.p", F.lit(0.0)).alias("hi"), F.col("u").isNotNull().alias("low_set"), F.col("o").isNotNull().alias("high_set"))
        state = ws.cut(new, f"state{turn}")
        settled.append(state.filter(F.col("found").isNotNull()).select("k", "target", "found"))
        open_ranks = state.filter(F.col("found").isNull())
        if open_ranks.isEmpty():
            break
        values = ws.cut(attach(open_ranks, ["target", "lo", "hi", "low_set", "high_set"], f"ranges{turn}").mapInArrow(_discard, f"{RUN}, target bigint"), f"left{turn}")
        keys = ["k", "target"]
        few = open_ranks.filter(F.col("left") <= finish_rows).select("k", "target", "rank")
        rest = values.join(few, ["k", "target"]).groupBy("k", "target", "rank").agg(F.array_sort(F.flatten(F.collect_list("vals"))).alias("vals"))
        settled.append(ws.cut(rest.select("k", "target", F.get("vals", F.col("rank").cast("int")).alias("found")), f"sorted{turn}"))
        state = open_ranks.filter(F.col("left") > finish_rows).select("k", "target", "rank", "left")
        if state.isEmpty():
            break
    else:
        raise RuntimeError("multi-select did not end")
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    by_rank = sizes.join(found.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("target", "found"))).alias("m")), "k")
    spot = [(F.col("n") - 1) * F.lit(float(q)) for q in qs]
    return ws.finish(by_rank.select("k", "n", F.array(*[_between(s, F.element_at("m", F.floor(s)), F.element_at("m", F.ceil(s))) for s in spot]).alias("q")))

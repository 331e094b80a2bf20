"""Per-key results when a few keys hold most rows.

Rows are range-partitioned on (key, secondary order, row number) by sampled quantiles, so a heavy key is cut
into as many ranges as its share of the rows needs. Each range is sorted and read once into partial states,
one per key; a key that lies in several ranges has its states stitched at the range boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallkit.session import shuffle_width

STATE = "part int, k string, n_rows bigint, n_distinct bigint, first_v string, last_v string"
_NO_STATE = {"part": pa.int32(), "k": pa.string(), "n_rows": pa.int64(), "n_distinct": pa.int64(), "first_v": pa.string(), "last_v": pa.string()}


def _changes(col: pa.Array) -> pa.Array:
    """Whether each element but the first differs from the one before it; nulls equal each other."""
    a, b = col.slice(1), col.slice(0, len(col) - 1)
    null_a, null_b = pc.is_null(a), pc.is_null(b)
    return pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(null_a, null_b))


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial states of one sorted range; a key that goes on in the next batch is carried over."""
    import numpy as np
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    carry = None  # [k, n_rows, n_distinct, first_v, last_v]
    for batch in batches:
        if not batch.num_rows:
            continue
        k, v = batch.column(0), batch.column(1)
        new_key = np.concatenate([[True], _changes(k).to_numpy(zero_copy_only=False)])
        new_val = np.concatenate([[True], _changes(v).to_numpy(zero_copy_only=False)]) | new_key
        present = pc.is_valid(v).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new_key)
        ends = np.append(starts[1:], batch.num_rows)
        fresh = np.add.reduceat((new_val & present).astype(np.int64), starts)
        ks, first, last = k.take(starts).to_pylist(), v.take(starts).to_pylist(), v.take(ends - 1).to_pylist()
        out = []
        for i, key in enumerate(ks):
            row = [key, int(ends[i] - starts[i]), int(fresh[i]), first[i], last[i]]
            if carry is not None:
                if carry[0] == key:
                    row[1] += carry[1]
                    row[2] += carry[2] - (row[3] is not None and row[3] == carry[4])
                    row[3] = carry[3]
                else:
                    out.append(carry)
            carry = row
        if out:
            yield _batch(part, out)
    if carry is not None:
        yield _batch(part, [carry])


def _batch(part: int, rows: list) -> pa.RecordBatch:
    cols = [[part] * len(rows), *map(list, zip(*rows, strict=True))]
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, _NO_STATE.values(), strict=True)], names=list(_NO_STATE))


def balanced_counts(df: DataFrame, key: str, value: str, ranges: int | None = None) -> DataFrame:
    """Rows and distinct values of every key: ``key, n_rows, n_distinct``, evenly spread over the work.

    The row number makes even copies of one (key, value) divisible, so no range outgrows the others whatever a key,
    a value or a row holds. Numbers are those of a file scan, which a lost executor's rerun gives again; let ``df`` be
    a scan, or a written table, with projections and filters on top.

    Nulls: a null key is a key of its own; a null value counts in ``n_rows`` only. An empty table gives no rows.
    Columns other than ``key`` and ``value`` are not read; their names may clash with anything.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(value).cast("string").alias("v"), F.monotonically_increasing_id().alias("r"))
    spread = rows.repartitionByRange(ranges or shuffle_width(rows), "k", "v", "r").sortWithinPartitions("k", "v")
    states = spread.select("k", "v").mapInArrow(_states, STATE)
    return stitched(states).withColumnRenamed("k", key)


def stitched(states: DataFrame) -> DataFrame:
    """Whole-key results of partial states: a value that ends one range and begins the next is counted once.

    A key has at most one state per range, so the windows stay small.
    """
    before = F.lag("last_v").over(Window.partitionBy("k").orderBy("part"))
    seam = F.coalesce((before == F.col("first_v")).cast("bigint"), F.lit(0))
    return states.withColumn("seam", seam).groupBy("k").agg(F.sum("n_rows").alias("n_rows"), F.sum(F.col("n_distinct") - F.col("seam")).alias("n_distinct"))

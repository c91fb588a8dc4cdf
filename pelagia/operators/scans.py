"""Segmented scans: row numbers, neighbours and running values by key, where a key may hold a third of all rows.

``numbered`` sorts by ranges of (keys, order), not by key, and counts inside each range. Only a range's first key can have rows in
an earlier range, so the offsets are a row for each range, added up on the driver; nothing else is joined. With row numbers, a key falls
into blocks of ``BLOCK`` rows. A window over (key, block) is bounded whatever the key; ``halo`` repeats the rows at a block's
edges in the blocks beside it, for what looks at neighbours, and ``carried`` gives each block what the blocks before it come to, for
what runs on from the first row. Results do not depend on the number of ranges or on the block's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pelagia.session import written

BLOCK = 1 << 16


def changes(columns: list[pa.Array], last: list | None) -> np.ndarray:
    """Where a row's ``columns`` differ from the row before (nulls are equal); ``last`` is the row before the first."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    for i, column in enumerate(columns):
        a, b = column.slice(1), column.slice(0, n - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] |= differ.to_numpy(zero_copy_only=False)
        out[0] |= last is None or column[0].as_py() != last[i]
    return out


def _counted(keys: list[str]):
    """Adds _p (range), _i (rows of the key before it in the range), _r (rows before it in the range), _f (of the range's first key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        last, seen, rows, leading = None, 0, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            named = [batch.column(k) for k in keys]
            fresh = changes(named, last)
            here = np.arange(n)
            start = np.maximum.accumulate(np.where(fresh, here, -1))
            index = np.where(start >= 0, here - start, here + seen)
            new = np.cumsum(fresh) - (last is None)
            first = (new == 0) & leading
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, at, np.int32)), pa.array(index), pa.array(here + rows), pa.array(first)], [*batch.schema.names, "_p", "_i", "_r", "_f"])
            last, seen, rows, leading = [c[n - 1].as_py() for c in named], int(index[-1]) + 1, rows + n, bool(first[-1])

    return run


def numbered(df: DataFrame, keys: list[str], order: list, ranges: int | None = None) -> DataFrame:
    """``df`` with _g: how many rows of the same ``keys`` come before in ``order`` (ties in ``order`` are broken anyhow)."""
    by = [*keys, *order]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    schema = T.StructType([*df.schema, T.StructField("_p", T.IntegerType()), T.StructField("_i", T.LongType()), T.StructField("_r", T.LongType()), T.StructField("_f", T.BooleanType())])
    placed = written(dealt.sortWithinPartitions(*by).mapInArrow(_counted(keys), schema))
    key = F.struct(*keys)
    ends = placed.groupBy("_p").agg(F.min_by(key, "_r").alias("first"), F.max_by(key, "_r").alias("last"), (F.max_by("_i", "_r") + 1).alias("n"), F.max_by("_f", "_r").alias("one")).orderBy("_p").collect()  # a row a range
    offsets, last, total = [], None, 0
    for r in ends:
        own = total if last is not None and r.first == last else 0
        if own:
            offsets.append((r._p, own))
        last, total = r.last, r.n + (own if r.one else 0)
    found = placed.drop("_r")
    if offsets:
        known = F.broadcast(df.sparkSession.createDataFrame(offsets, "_p int, _o long"))  # a row a range at most
        found = found.join(known, "_p", "left").withColumn("_g", F.col("_i") + F.when(F.col("_f"), F.coalesce("_o", F.lit(0))).otherwise(0)).drop("_o")
    else:
        found = found.withColumn("_g", F.col("_i"))
    return found.drop("_p", "_i", "_f")


def halo(rows: DataFrame, before: int, after: int = 0, block: int = BLOCK) -> DataFrame:
    """``numbered`` rows with _b, the block they are read in, and _own: rows near a block's edge are also read, not owned, in the
    blocks within ``before`` rows behind them and ``after`` rows ahead of them."""
    g = F.col("_g")
    low, high = F.greatest(F.lit(0), F.floor((g - after) / block)), F.floor((g + before) / block)
    home = F.floor(g / block)
    return rows.withColumn("_b", F.explode(F.sequence(low, high))).withColumn("_own", F.col("_b") == home)


def by_block(keys: list[str]):
    return Window.partitionBy(*keys, "_b").orderBy("_g")


def carried(rows: DataFrame, keys: list[str], sums: dict[str, Column], merge: dict[str, str], block: int = BLOCK) -> DataFrame:
    """``numbered`` rows with _b (their block) and, for each of ``sums`` (an aggregate), the merged (sum, max or min) value of the key's
    blocks before; null in its first block. A key's blocks are a row each."""
    own = rows.withColumn("_b", F.floor(F.col("_g") / block))
    blocks = written(own.groupBy(*keys, "_b").agg(*(a.alias(n) for n, a in sums.items())))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = written(blocks.select(*keys, "_b", *(getattr(F, merge[n])(n).over(w).alias(n) for n in sums)))
    match = [own[k].eqNullSafe(before[k]) for k in keys]
    return own.join(before, [*match, own["_b"] == before["_b"]]).select(*(own[c] for c in own.columns), *(before[n] for n in sums))

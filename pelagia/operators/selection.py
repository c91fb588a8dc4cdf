"""Exact quantiles of doubles by counting, for any number of keys: no sort, and no task that gathers a key's values.

A double's bits, with the sign folded in, are a 64-bit number of the same order. Four passes find a wanted row by 16 bits each: the
rows that share the bits found so far are counted by their next 16 bits, map-side first, so a task holds 65,536 counters at most
for each (key, bits); the counter in which the wanted row lies gives the bits. What is found so far is a row for each (key,
wanted row), so nothing but counters is exchanged, and a key with a third of all rows is counted where its rows are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from pelagia.session import written

DIGIT = 16
#: Rows of found bits that are broadcast at most; beyond that they are joined.
STATE = 100_000


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Numbers, to be read as unsigned, in the order of the doubles."""
    bits = (values + 0.0).view(np.int64)  # one zero
    return np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63)))


def doubles(bits: np.ndarray) -> np.ndarray:
    return np.where(bits < 0, bits ^ np.int64(-(1 << 63)), ~bits).astype(np.int64).view(np.float64)


def _mapped(df: DataFrame, source: str, out: str, kind: T.DataType, kernel) -> DataFrame:
    keep = [c for c in df.columns if c != source]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = kernel(batch.column(source).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found)], [*keep, out])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField(out, kind)]))


def quantiles(df: DataFrame, keys: list[str], column: str, shares: list[float]) -> DataFrame:
    """keys, n, q: for each of ``keys`` the values of ``column`` (nulls left out) at ``shares`` of the way from the least to the largest,
    between two values in proportion. Rows with a null key take no part; without keys, one row."""
    by = keys or ["_all"]
    rows = df.select(*(keys or [F.lit(0).alias("_all")]), F.col(column).cast("double").alias("_v")).dropna()
    bits = written(_mapped(rows, "_v", "_k", T.LongType(), ordered_bits))
    sizes = written(bits.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
    at = F.array(*(F.lit(float(s)) for s in shares))
    spot = sizes.select(*by, F.posexplode(at).alias("_s", "_share"), "_n").withColumn("_h", F.col("_share") * (F.col("_n") - 1))
    both = F.array(F.struct(F.lit(0).alias("up"), F.floor("_h").alias("rank")), F.struct(F.lit(1).alias("up"), F.ceil("_h").alias("rank")))
    state = spot.select(*by, "_s", F.explode(both).alias("_w"))
    state = written(state.select(*by, "_s", F.col("_w.up").alias("_up"), F.col("_w.rank").alias("_rank"), F.lit(0).cast("long").alias("_x")))
    small = state.count() <= STATE
    for shift in range(64 - DIGIT, -1, -DIGIT):
        digit = F.shiftrightunsigned("_k", shift).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("long")).alias("_d")
        prefix = (F.shiftrightunsigned("_k", shift + DIGIT) if shift + DIGIT < 64 else F.lit(0).cast("long")).alias("_x")
        open_ = state.select(*by, "_x").distinct()
        live = bits.select(*by, prefix, digit).join(F.broadcast(open_) if small else open_, [*by, "_x"])
        counted = written(live.groupBy(*by, "_x", "_d").agg(F.count(F.lit(1)).alias("_c")))
        placed = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by, "_x").orderBy("_d")))
        hit = state.join(placed, [*by, "_x"]).where((F.col("_rank") >= F.col("_upto") - F.col("_c")) & (F.col("_rank") < F.col("_upto")))
        state = written(hit.select(*by, "_s", "_up", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"), F.shiftleft("_x", DIGIT).bitwiseOR(F.col("_d")).alias("_x")))
    found = _mapped(state.drop("_rank"), "_x", "_v", T.DoubleType(), doubles)
    pair = found.groupBy(*by, "_s").agg(F.max(F.when(F.col("_up") == 0, F.col("_v"))).alias("_low"), F.max(F.when(F.col("_up") == 1, F.col("_v"))).alias("_high"))
    value = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_h") - F.floor("_h")))
    each = pair.join(spot, [*by, "_s"]).groupBy(*by, "_n").agg(F.array_sort(F.collect_list(F.struct("_s", value.alias("v")))).alias("_q"))
    return each.select(*keys, F.col("_n").alias("n"), F.transform("_q", lambda x: x["v"]).alias("q"))


def of_columns(df: DataFrame, columns: dict, shares: list[float]) -> dict[str, list[float]]:
    """The quantiles of several columns (name -> Column) over all rows: a row a column comes to the driver. Nulls where there is no value."""
    every = F.array(*(F.struct(F.lit(n).alias("c"), c.cast("double").alias("v")) for n, c in columns.items()))
    found = quantiles(df.select(F.inline(every)), ["c"], "v", shares).collect()
    return {n: [None] * len(shares) for n in columns} | {r.c: list(r.q) for r in found}

"""Keyed state in Structured Streaming: each micro-batch reads and writes the state of its own keys only.

State lives in the state store under the query's checkpoint, so a query that is started again on its checkpoint goes on where it
ended, and what it knows is read from the store. Sums and peaks are an aggregate of the engine. Of best and latest rows only a batch's
first n of a key are exchanged, so a key with a third of all rows is many tasks' work. A key can also be dealt to shards by a hash of
the row, each with a state of its own, since these states merge; that costs a state for each, so the default is one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SHARDS = 1
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """The session with the state store that keyed state needs."""
    kept = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, kept) if kept else spark.conf.unset(PROVIDER)


class Best(StatefulProcessor):
    """The first n rows of each (key, shard) in an order; the others leave the state at once. ``order`` names the columns, those in
    ``down`` falling."""

    def __init__(self, schema: str, columns: list[str], order: list[str], down: list[bool], n: int):
        self.schema, self.columns, self.order, self.down, self.n = schema, columns, order, down, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("best", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame([tuple(r) for r in self.state.get()], columns=self.columns) if self.state.exists() else None
        for batch in rows:
            # only n rows are held at any time
            every = batch[self.columns] if held is None or held.empty else pd.concat([held, batch[self.columns]], ignore_index=True)
            held = every.sort_values(self.order, ascending=[not d for d in self.down], kind="stable").head(self.n)
        kept = [] if held is None else [tuple(None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v for v in r) for r in held.itertuples(index=False)]
        self.state.put(kept)
        yield pd.DataFrame({"k": [str(key[0])], "shard": [int(key[1])], "n": [len(kept)]})

    def close(self) -> None:
        pass


def _started(stream: DataFrame, keys: list[str], salt: list[str], processor: StatefulProcessor, checkpoint: str, shards: int) -> None:
    """Run the stream's new rows through the processor. The rows it gives back are not kept: the store has all that is known. No timers:
    with those of processing time, a run over what is available does not end."""
    with state_store(stream.sparkSession):
        dealt = stream.withColumn("_shard", F.pmod(F.xxhash64(*salt), F.lit(shards)).cast("int"))
        states = dealt.groupBy(*keys, "_shard").transformWithStateInPandas(processor, "k string, shard int, n long", "Update", "None")
        states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("noop").start().awaitTermination()


def _first_rows(rows: DataFrame, by: list[str], order: list[str], down: list[bool], n: int) -> DataFrame:
    """The rows that are among the first n of their key in their Arrow batch; no other can be among the first n of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.select(list(dict.fromkeys([*by, *order]))).to_pandas().reset_index(drop=True)
            ranked = some.sort_values(order, ascending=[not d for d in down], kind="stable")
            kept = (ranked.groupby(by, dropna=False, sort=False).cumcount() < n).sort_index()
            yield batch.filter(pa.array(kept.to_numpy()))

    return rows.mapInArrow(run, rows.schema)


def _known(spark: SparkSession, checkpoint: str, name: str, **more: str) -> DataFrame:
    """What the state store holds under a checkpoint: key (a struct) and the state's columns."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
    for k, v in more.items():
        reader = reader.option(k, v)
    return reader.load()


def peaks(stream: DataFrame, key: str, value: str, checkpoint: str) -> DataFrame:
    """key, peak, total, n over all rows that the checkpoint has seen, ``stream``'s new ones included. A null key is a key; null values count
    as rows only. An aggregate of the engine: each task sums its rows by key before they are exchanged."""
    v = F.col(value).cast("double")
    sums = stream.groupBy(key).agg(F.max(v).alias("peak"), F.sum(F.coalesce(v, F.lit(0.0))).alias("total"), F.count(F.lit(1)).alias("n"))
    with state_store(stream.sparkSession):
        sums.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("noop").start().awaitTermination()
    found = stream.sparkSession.read.format("statestore").option("path", checkpoint).load()
    # the state's columns stand in the order of the aggregates
    return found.select(F.col(f"key.{key}").alias(key), "value.*").toDF(key, "peak", "total", "n")


def best(stream: DataFrame, keys: list[str], order: list[str], down: list[bool], n: int, checkpoint: str, shards: int = SHARDS) -> DataFrame:
    """The first n rows of each of ``keys`` (of all rows without keys) in the order given, over all rows that the checkpoint has seen."""
    spark, by = stream.sparkSession, keys or ["_all"]
    rows = stream if keys else stream.withColumn("_all", F.lit(0))
    columns = [c for c in rows.columns if c not in by]
    schema = T.StructType([rows.schema[c] for c in columns])
    _started(_first_rows(rows, by, order, down, n), by, columns, Best(schema, columns, order, down, n), checkpoint, shards)
    held = _known(spark, checkpoint, "best")
    held = held.select(*(F.col(f"key.{k}").alias(k) for k in by), "list_element.*").select(*stream.columns)
    falling = [F.desc(c) if d else F.asc(c) for c, d in zip(order, down, strict=True)]
    if not keys:
        return held.orderBy(*falling).limit(n)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*falling))  # n rows a shard of a key
    return held.withColumn("_r", place).where(F.col("_r") <= n).drop("_r")

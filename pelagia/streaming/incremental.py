"""Running numbers, controllers and event-time windows with Structured Streaming; states of keys are in ``keyed``.

State is a small table in the shared folder, written anew for each micro-batch under its number, so a batch that is run
again after a failure starts from the same state and gives the same result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pelagia.session import _delete, scratch, shared_dir


def _run(stream: DataFrame, fold, first: DataFrame, mode: str = "append") -> DataFrame:
    """Fold every micro-batch into a state table: fold(state, batch) -> state. Returns the last state."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/pelagia-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    first.write.parquet(f"{root}/state/-1")
    done = {"at": -1}

    def step(batch: DataFrame, epoch: int) -> None:
        state = batch.sparkSession.read.schema(first.schema).parquet(f"{root}/state/{epoch - 1}")
        fold(state, batch).write.mode("overwrite").parquet(f"{root}/state/{epoch}")
        done["at"] = epoch
        _delete(batch.sparkSession, f"{root}/state/{epoch - 2}")  # a batch that runs again needs the state before it only

    query = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(first.schema).parquet(f"{root}/state/{done['at']}")


def indexed(stream: DataFrame, order: str) -> DataFrame:
    """Rows of all batches with a running index: each batch continues where the last one ended."""
    from pelagia.operators import pixels

    spark, schema = stream.sparkSession, stream.select("*", F.lit(0).cast("long").alias("i")).schema
    rows = scratch(spark)
    spark.createDataFrame([], schema).write.parquet(f"{rows}/first")

    def fold(state: DataFrame, batch: DataFrame) -> DataFrame:
        # the state is the next index alone; a batch's rows are written once, under the index they begin at
        start = state.first().next
        batch = pixels.indexed(batch, order).withColumn("i", F.col("i") + start).select(*schema.names)
        batch.write.mode("overwrite").parquet(f"{rows}/from-{start}")
        return spark.range(1).select(F.lit(start + batch.count()).cast("long").alias("next"))

    _run(stream, fold, spark.createDataFrame([(0,)], "next long"))
    return spark.read.schema(schema).parquet(f"{rows}/*")


def control(buffer: DataFrame, key: str, order: list[str], value: str, target: float, alpha: float, gain: float, bound: float) -> DataFrame:
    """key, n, recent (mean), balance (exponential mean from the oldest row of the buffer on), step: the proportional step
    gain (target - balance), within +-bound."""
    place = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    df = buffer.select(key, value, (F.row_number().over(place) - 1).alias("age"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    weight = F.when(F.col("age") == F.col("n") - 1, 1.0).otherwise(alpha) * F.pow(F.lit(1 - alpha), F.col("age"))
    found = df.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("recent"), F.sum(weight * F.col(value)).alias("balance"))
    return found.withColumn("step", F.greatest(F.lit(-bound), F.least(F.lit(bound), gain * (target - F.col("balance")))))


def windows(stream: DataFrame, time: str, key: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling event-time windows with a watermark: start, key, n."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
    empty = stream.sparkSession.createDataFrame([], counts.schema)
    last = Window.partitionBy("start", key).orderBy(F.desc("n"))
    return _run(counts, lambda state, batch: state.unionByName(batch).withColumn("r", F.row_number().over(last)).where("r = 1").drop("r"), empty, "update")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver as a file stream."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    # a pattern matches a single file as well as a folder of files
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")

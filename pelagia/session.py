"""Session helpers shared by all subpackages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one, and any
    other an error: its executors could not read the driver's folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pelagia-checkpoints-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/pelagia-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a Parquet table in the shared folder (survives lost executors)."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written.append(path)
    out._pelagia_path = path
    return out


_written: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at the end, the tables ``written`` inside, but for those given to the function that it yields."""
    first, kept = len(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._pelagia_path)
        return df

    try:
        yield keep
    finally:
        mine, _written[first:] = _written[first:], [p for p in _written[first:] if p in kept]
        for path in mine:
            if path not in kept:
                _delete(spark, path)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes with the written tables."""
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    _written.append(path)
    return path


def drop(df: DataFrame) -> None:
    """Delete the table that ``written`` returned."""
    _delete(df.sparkSession, df._pelagia_path)


def drop_written(spark: SparkSession) -> None:
    """Delete all tables that this application wrote; DataFrames that read them end with it."""
    _delete(spark, _own_dir(spark))
    _written.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

"""All registered queries of the library, without the subpackage llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pelagia.plans import extended, files, imaging, kernels, paths, random, register, scene, streams, tabular  # noqa: F401


def queries() -> dict:
    return dict(register.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(register.ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.QUERIES["ag_alpha_composite"](spark, sf_dir)

"""Registration of queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(view) -> DataFrame`` as a query; ``view(name)`` gives a view or table as a DataFrame."""
    from pelagia.plans.views import spark_view

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda of: spark_view(spark, sf_dir, of))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def R(sql: str) -> str:
    """round to six digits, without a negative zero."""
    return f"(round({sql}, 6) + 0.0)"

"""Row keys: documents are told apart by id and by text, so that repeated ids with different texts never mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Stands for a null doc_id: no id is larger.
LAST = (1 << 63) - 1


def rows(docs: DataFrame) -> DataFrame:
    """_d (doc_id, null as LAST), _h (hash of the text, null as empty), text. Equal rows have equal keys."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_d"), F.xxhash64(text).alias("_h"), text.alias("text"))


def doc_id(d: Column) -> Column:
    return F.nullif(d, F.lit(LAST))


def hidden(docs: DataFrame, *shown: str) -> DataFrame:
    """``docs`` with every column but ``shown`` named after its place, so that none clashes with an operator's own columns;
    ``toDF(*docs.columns)`` gives the names back."""
    return docs.toDF(*(c if c in shown else f"_c{i}" for i, c in enumerate(docs.columns)))

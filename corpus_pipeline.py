"""The corpus pipeline: five stages of the subpackage llm, each written as Parquet and read again by the next.

toxicity drops the documents that the field scores as toxic; the n-gram Jaccard join keeps the least doc_id of each group;
substring dedup removes passages of 50 words or more that a smaller document has; mixing takes each document as often as its
targets ask for, so some occur twice;
BPE encodes what is left and returns a row for each document, with its token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pelagia.llm import bpe, jaccard_join, mixing, substring, toxicity
from pelagia.session import drop, passing, table, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("jaccard_join", jaccard_join.stage),
    ("substring_dedup", substring.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: The first and the last stage are not expressible in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's own tables go when its result is written, its input when the next result is."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with passing(spark) as keep:
            found = keep(written(stage(spark, docs, sf_dir)))
        if i:
            drop(docs)
        docs = found
    return docs

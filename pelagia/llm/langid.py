"""Language ID: multinomial naive Bayes over hashed character n-grams.

Grams of 1 to 3 characters (code points, lower-cased one by one) are hashed to ``BUCKETS`` cells. Each task sums them by
language, Spark adds the sums, and the log-probability matrix [BUCKETS, languages] is broadcast (its size is fixed by the number
of languages). A text's score is the log prior of the language, its share of the learned texts, and the sum of its grams' rows: a
sparse product, batch by batch in numpy.

The model learns from all rows given: counts are summed in each task, and what reaches the driver is bounded by the
cells and the languages, however many rows there are.

Defined results: a text that is null or has no letter is ``und`` with score 0; with no learned language so is every
text; ties go to the first language in alphabetical order; a null lang is not learned from, nor is a null text; an empty text
counts for the prior; repeated rows repeat; input columns named lang_pred, score or _letter are replaced, and text is not passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pelagia.llm._text import buffers, slices
from pelagia.session import table

BUCKETS, ORDERS, SMOOTHING = 1 << 15, 3, 0.5


def _lower_table() -> np.ndarray:
    """Code point -> that of its lower case, where that is one character; beyond the table there are no cases but rare scripts'."""
    lower = (chr(i).lower() for i in range(1 << 16))
    return np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(lower)], np.uint32)


LOWER = _lower_table()


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, and the texts' offsets into them."""
    raw, offsets = buffers(column)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    few = points < len(LOWER)
    points[few] = LOWER[points[few]]
    return points, np.append(0, np.cumsum((raw & 0xC0) != 0x80))[offsets]


def grams(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the cells of the grams that begin at each character (BUCKETS: the gram runs over its text's end); offsets."""
    low, offsets = characters(column)
    n = len(low)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    out, h = [], np.zeros(n, np.uint32)
    for k in range(ORDERS):
        h = h * np.uint32(0x01000193) + np.append(low[k:], np.zeros(min(k, n), np.uint32)) + np.uint32(1)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(k * 0x9E3779B9 & 0xFFFFFFFF)
        cell = ((mixed ^ (mixed >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int32)
        cell[left <= k] = BUCKETS
        out.append(cell)
    return out, offsets


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """(languages, log-probabilities [BUCKETS + 1, languages], log priors) of rows (text, lang); null without rows."""
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}  # the last cell holds the number of texts
        for batch in batches:
            for part in slices(batch):
                cells, offsets = grams(part.column("text"))
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs):
                    own = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    mine = np.repeat(langs == lang, np.diff(offsets))
                    for cell in cells:
                        own[:BUCKETS] += np.bincount(cell[mine], minlength=BUCKETS + 1)[:BUCKETS]
                    own[BUCKETS] += np.count_nonzero(langs == lang)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "cell", "n"])

    found = rows.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found.lang.unique())
    if not langs:
        return None
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[found.cell, found.lang.map({x: i for i, x in enumerate(langs)})] = found.n
    logs = np.log(counts[:BUCKETS] + SMOOTHING) - np.log(counts[:BUCKETS].sum(0) + SMOOTHING * BUCKETS)
    prior = np.log(counts[BUCKETS]) - np.log(counts[BUCKETS].sum())
    return langs, np.vstack((logs, np.zeros(len(langs)))).astype(np.float32), prior  # the last row: no gram


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray] | None) -> DataFrame:
    """``docs`` with lang_pred and score, the posterior of the predicted language for a gram of average evidence."""
    keep = [c for c in docs.columns if c.lower() not in {"lang_pred", "score", "_letter"}]
    if model is None:
        return docs.select(*(c for c in keep if c != "text"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs, prior = shared.value
        names = np.array(langs, object)
        for batch in batches:
            for part in slices(batch):
                cells, offsets = grams(part.column("text"))
                sums = np.zeros((part.num_rows, len(langs)))
                some = np.flatnonzero(np.diff(offsets))
                if len(some):
                    for cell in cells:
                        for j in range(len(langs)):
                            sums[some, j] += np.add.reduceat(logs[cell, j], offsets[some], dtype=np.float64)
                # evidence of a text counts as that of 50 characters at most, so that the posterior stays calibrated
                scale = 50 / np.maximum(np.diff(offsets), 50)
                soft = prior + sums * scale[:, None]
                shifted = np.exp(soft - soft.max(1, keepdims=True))
                sums += prior
                letters = part.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
                best = names[sums.argmax(1)]
                best[~letters] = "und"
                score = np.where(letters, shifted[np.arange(len(sums)), sums.argmax(1)] / shifted.sum(1), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep if k != "text"), pa.array(best, pa.string()), pa.array(score)], [*(k for k in keep if k != "text"), "lang_pred", "score"])

    others = [c for c in keep if c != "text"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + ["lang_pred string", "score double"])
    return docs.select(*keep, letter.alias("_letter")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held_out).select("text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

"""Substring dedup: Rabin-Karp hashes of token windows, counted in Spark; repeated windows merge into removal intervals.

A window is ``WINDOW`` consecutive words of one document. Every window has a hash, and an anchor: the least hash of its
``GRAM``-word grams. Both depend on the window's words alone, so equal windows have equal anchors, and a window whose
anchor occurs in one document only is unique. Consecutive windows with one anchor form a run, and Spark counts runs
(about one for 20 windows) instead of windows:

1. runs are counted by anchor; those whose anchor occurs in one document only are done;
2. where all runs of an anchor are equal, all windows of a run outside the least document are repeats;
3. where they differ, equal runs are counted by (anchor, run hash) and, but for the least document's, are repeats;
   the windows of the least documents' runs are hashed and counted one by one. This is about the edges of passages.

All counts are hash aggregations with map-side combining. They are written before they are joined back: a join of two tables,
unlike one that stands on an aggregate's exchange, can be split by Spark, so a passage in a third of all documents makes no hot
task. Repeated windows are merged per document, where its text is.

The prefilter loses nothing: a window's anchor is a value, the least of its grams' hashes, not a place. However many grams tie
for it, equal windows have equal anchors, so a window that a second document has stands in a run whose anchor that document has.

Defined results: a null text has no words; texts under ``WINDOW`` words lose nothing; repeated rows (one doc_id) never
repeat each other; a null doc_id counts as larger than any; equal windows inside one document are not repeats; input columns
named n_words, n_removed, removed or kept are replaced by ``dedup``, and passed on unchanged by ``stage``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pelagia.llm import keys
from pelagia.llm._text import U, Words, mix, powers, inverse_powers, signed, slices, sliding_min, spans, windows
from pelagia.session import table, written

WINDOW, GRAM = 50, 10


def _runs(part: pa.RecordBatch, window: int, gram: int):
    """Runs of the slice: text, first window and last window in the text, anchor, run hash; and all window hashes."""
    words = Words(part.column("text"))
    counts = words.counts
    n = len(words.starts)
    hashes = windows(words.hashes, window)
    if not len(hashes):
        e = np.zeros(0, np.int64)
        return words, e, e, e, e.view(U), e.view(U), hashes
    anchors = sliding_min(windows(words.hashes, gram), window - gram + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    whole = text[: n - window + 1] == text[window - 1 :]  # the window lies in one text
    fresh = np.append(True, (anchors[1:] != anchors[:-1]) | (text[1 : len(anchors)] != text[: len(anchors) - 1]))
    edge = fresh | ~whole | np.append(True, ~whole[:-1])
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(anchors))
    good = whole[begin]
    begin, end = begin[good], end[good]
    # a run's hash: of its windows' hashes, in order
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(mix(hashes) * powers(len(hashes)), out=sums[1:])
    run = mix((sums[end] - sums[begin]) * inverse_powers(len(hashes) + 1)[begin] + (end - begin).astype(U))
    own = text[begin]
    return words, own, begin - words.first[own], end - 1 - words.first[own], anchors[begin], run, hashes


def runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """_d, _h, a (anchor), r (run hash), s, e (first and last window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, text, first, last, anchor, r, _ = _runs(part, window, gram)
                take = pa.array(text)
                arrays = [part.column("_d").take(take), part.column("_h").take(take), *(pa.array(signed(x)) for x in (anchor, r)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, ["_d", "_h", "a", "r", "s", "e"])

    return docs.mapInArrow(run, "_d long, _h long, a long, r long, s int, e int")


def _single(docs: DataFrame, parts: DataFrame, window: int, gram: int) -> DataFrame:
    """_d, _h, a, w (window hash), s of every window in the runs ``parts`` (_d, _h, a, s, e)."""
    wanted = written(parts.groupBy("_d", "_h").agg(F.collect_set(F.struct("s", "e")).alias("runs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, text, first, last, anchor, _, hashes = _runs(part, window, gram)
                listed = part.column("runs")
                sizes = listed.value_lengths().to_numpy(zero_copy_only=False)
                flat = listed.flatten()
                s = flat.field("s").to_numpy(zero_copy_only=False).astype(np.int64)
                e = flat.field("e").to_numpy(zero_copy_only=False).astype(np.int64)
                own = np.repeat(np.arange(part.num_rows), sizes)
                place = spans(words.first[own] + s, e - s + 1)
                of = np.repeat(own, e - s + 1)
                run_at = np.searchsorted(words.first[text] + first, place, "right") - 1
                take = pa.array(of)
                arrays = [part.column("_d").take(take), part.column("_h").take(take), pa.array(signed(anchor[run_at])), pa.array(signed(hashes[place])), pa.array((place - words.first[of]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, ["_d", "_h", "a", "w", "s"])

    return docs.join(wanted, ["_d", "_h"]).mapInArrow(run, "_d long, _h long, a long, w long, s int")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """_d, _h, removed: the intervals (first and last window) of each document's windows that a smaller document has.
    ``docs`` has _d, _h, text."""
    found = written(runs(docs, window, gram))
    by_anchor = found.groupBy("a").agg(F.min("_d").alias("d0"), F.max("_d").alias("d1"), F.min("r").alias("r0"), F.max("r").alias("r1")).where("d0 < d1").drop("d1")
    shared = written(found.join(written(by_anchor), "a"))
    plain = shared.where("r0 = r1 and _d > d0").select("_d", "_h", "s", "e")
    mixed = shared.where("r0 < r1").select("_d", "_h", "a", "r", "s", "e")
    by_run = written(mixed.groupBy("a", "r").agg(F.min("_d").alias("d0")))
    mixed = written(mixed.join(by_run, ["a", "r"]))
    equal = mixed.where("_d > d0").select("_d", "_h", "s", "e")
    single = written(_single(docs, mixed.where("_d = d0").select("_d", "_h", "a", "s", "e"), window, gram))
    by_window = single.groupBy("a", "w").agg(F.min("_d").alias("d0"), F.max("_d").alias("d1")).where("d0 < d1").drop("d1")
    later = single.join(written(by_window), ["a", "w"]).where("_d > d0").select("_d", "_h", "s", F.col("s").alias("e"))
    every = plain.unionByName(equal).unionByName(later)
    return every.groupBy("_d", "_h").agg(F.collect_set(F.struct("s", "e")).alias("removed"))


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with n_words, n_removed, removed (maximal intervals [first, last) of removed words) and kept (the kept words
    joined by one space)."""
    added = ["n_words", "n_removed", "removed", "kept"]
    keep = [c for c in docs.columns if c.lower() not in {*added, "_d", "_h", "_r"}]
    found = written(repeats(keys.rows(docs), window, gram)).withColumnRenamed("removed", "_r")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(*keep, F.coalesce(F.col("doc_id").cast("long"), F.lit(keys.LAST)).alias("_d"), F.xxhash64(text).alias("_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                n = len(words.starts)
                listed = part.column("_r")
                sizes = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                own = np.repeat(np.arange(part.num_rows), sizes)
                flat = listed.flatten()
                s = words.first[own] + flat.field("s").to_numpy(zero_copy_only=False)
                e = words.first[own] + flat.field("e").to_numpy(zero_copy_only=False) + window
                marks = np.zeros(n + 1, np.int64)
                np.add.at(marks, s, 1)
                np.add.at(marks, e, -1)
                gone = np.cumsum(marks[:n]) > 0
                text = np.repeat(np.arange(part.num_rows), words.counts)
                # maximal intervals
                begin = gone & np.append(True, ~gone[:-1] | (text[1:] != text[:-1])) if n else gone
                end = gone & np.append(~gone[1:] | (text[1:] != text[:-1]), True) if n else gone
                b, f = np.flatnonzero(begin), np.flatnonzero(end) + 1
                fields = [pa.array((x - words.first[text[b]]).astype(np.int32)) for x in (b, f)]
                ends = np.append(0, np.cumsum(np.bincount(text[b], minlength=part.num_rows))).astype(np.int32)
                intervals = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, ["first", "last"]))
                # kept words with one space after each, and none after a text's last
                stay = np.flatnonzero(~gone)
                lengths = words.ends[stay] - words.starts[stay] + 1
                source = spans(words.starts[stay], lengths)
                out_ends = np.cumsum(lengths)
                data = np.append(words.raw, np.uint8(32))[np.minimum(source, len(words.raw))]
                data[out_ends - 1] = 32
                upto = np.append(0, out_ends)[np.searchsorted(stay, words.first)]
                kept = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data))
                removed = np.bincount(text[gone], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(words.counts), pa.array(removed), intervals, _trimmed(kept)], [*keep, *added])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["n_words long, n_removed long, removed array<struct<first:int,last:int>>, kept string"])
    return keyed.join(found, ["_d", "_h"], "left").select(*keep, "_r").mapInArrow(run, schema)


def _trimmed(texts: pa.Array) -> pa.Array:
    """Without the one space at the end of each text that is not empty."""
    return pc.utf8_rtrim(texts, " ").cast(pa.string())


def query(spark, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, its text without the repeated passages; a text that repeats nothing is unchanged,
    and n_chars follows the text."""
    own = keys.hidden(docs, "doc_id", "text", "n_chars")
    found = dedup(own).withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    columns = [F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(c) for c in own.columns]
    return found.select(*columns).toDF(*docs.columns)

"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash of the last ``ROLL`` bytes ends a chunk wherever it is -1 modulo the block size; each chunk gives one of 64
letters, and the letters are the signature. The block size is the least ``MIN_BLOCK`` x 2**i whose ``LETTERS`` blocks hold
the text; a second signature is made with twice that, so texts of up to twice the length have compatible ones. A
signature has at most ``LETTERS`` letters: the last stands for the whole rest. ``blocksize:signature:signature``.

Two fingerprints are compared by the edit distance of the signatures at an equal block size, as 1 - distance / length of
the longer; the best pair counts; without an equal block size the likeness is 0.

``neighbours`` pairs each document with the next by descending doc_id without a global sort: documents are dealt to
ranges of ids (bounds from quantiles, a number in proportion to the shuffle partitions; an id that fills two quantiles, and the
null id, are dealt further by their texts' hashes), sorted there, and the first
document of each range is sent to the range before it as well. Texts are shuffled once.

Defined results: a null text is empty; equal texts have equal fingerprints; equal doc_ids are ordered by their texts'
hashes; a null doc_id comes first, as the largest; a single document is its own next; only doc_id and text are read, so other
columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pelagia.llm import keys
from pelagia.llm._text import SLICE, U, buffers, mix
from pelagia.session import table

ROLL, MIN_BLOCK, LETTERS = 7, 3, 64
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The fingerprint of each text raw[offsets[i]:offsets[i+1]]."""
    n, size = len(raw), np.diff(offsets)
    texts = len(size)
    block = MIN_BLOCK * 2 ** np.ceil(np.log2(np.maximum(size / (MIN_BLOCK * LETTERS), 1))).astype(np.int64)
    text = np.repeat(np.arange(texts), size)
    at = np.arange(n) - offsets[:-1][text]
    roll = np.zeros(n, np.uint32)
    low = raw.astype(np.uint32) + np.uint32(1)
    factor = 1
    for k in range(ROLL):
        shifted = low if k == 0 else np.append(np.zeros(min(k, n), np.uint32), low[: n - k])
        roll += np.where(at >= k, shifted, np.uint32(0)) * np.uint32(factor)
        factor = factor * 0x01000193 & 0xFFFFFFFF
    roll = (roll ^ (roll >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    roll ^= roll >> np.uint32(13)
    hashed = (roll * np.uint32(0xC2B2AE35) ^ (roll >> np.uint32(11))).astype(np.uint64)
    out = []
    for times in (1, 2):
        limit = block * times
        # block sizes of 3 * 2**i: the larger one's triggers are among the smaller one's
        stop = (roll % limit[text].astype(np.uint32) == limit[text].astype(np.uint32) - 1) if n else np.zeros(0, bool)
        ends = np.flatnonzero(stop)
        rank = np.arange(len(ends)) - np.searchsorted(text[ends], text[ends])
        ends = ends[rank < LETTERS - 1]
        begin = np.union1d(offsets[:-1][size > 0], ends + 1)
        begin = begin[begin < n]
        chunk = mix(np.add.reduceat(hashed, begin)) if len(begin) else np.zeros(0, U)
        letters = ALPHABET[(chunk >> U(58)).astype(np.int64)].tobytes().decode()
        first = np.searchsorted(begin, offsets)
        out.append([letters[a:b] for a, b in zip(first[:-1], first[1:], strict=True)])
    return [f"{b}:{x}:{y}" for b, x, y in zip(block.tolist(), *out, strict=True)]


def fingerprint_column(column: pa.Array) -> list[str]:
    """Fingerprints of a text column, by slices of bounded size."""
    raw, offsets = buffers(column)
    out, at, n = [], 0, len(offsets) - 1
    while at < n:
        stop = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1))
        out += fingerprints(raw[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
        at = stop
    return out


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text; no shuffle."""
    keep = [c for c in docs.columns if c.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(fingerprint_column(batch.column(text)), pa.string())], [*keep, out])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"`{out}` string"])
    return docs.select(*keep).mapInArrow(run, schema)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1."""
    x, y = F.split(a, ":"), F.split(b, ":")
    bx, by = x[0].cast("long"), y[0].cast("long")

    def near(p: Column, q: Column) -> Column:
        longer = F.greatest(F.length(p), F.length(q))
        return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(p, q) / longer)

    same = F.greatest(near(x[1], y[1]), near(x[2], y[2]))
    return F.when(a == b, 1.0).when(bx == by, same).when(bx == 2 * by, near(x[1], y[2])).when(by == 2 * bx, near(x[2], y[1])).otherwise(0.0)


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint of every document of (doc_id, text):
    the edited text is the text with its last third replaced by as much of the next document's beginning."""
    spark = docs.sparkSession
    rows = keys.rows(docs)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    coarse = min(parts, 512)
    known = rows.where(F.col("_d") < keys.LAST).approxQuantile("_d", [float(i) / coarse for i in range(coarse + 1)], 1 / (10 * coarse)) or [0.0]
    known = [min(int(x), keys.LAST - 1) for x in known]
    hot = {x + 1 for x, y in zip(known, known[1:]) if x == y}
    full = [*sorted({*known, *hot, known[-1] + 1} - {keys.LAST}), keys.LAST, keys.LAST]
    fine = -(-parts // (len(full) - 1))
    # _p: ranges from the largest ids to the least; quantiles first, then equal widths of ids within them
    edges = F.array(*(F.lit(x) for x in full))
    j = F.least(F.greatest(F.size(F.filter(edges, lambda e: e <= F.col("_d"))), F.lit(1)), F.lit(len(full) - 1))
    low, high = F.element_at(edges, j).cast("double"), F.element_at(edges, j + 1).cast("double")
    by_hash = 0.5 - F.col("_h") / F.lit(2.0**64)
    within = F.floor(F.when(high - low <= 1, by_hash).otherwise((high - F.col("_d")) / (high - low)) * fine)
    placed = rows.withColumn("_p", ((len(full) - 1 - j) * fine + F.least(F.greatest(within, F.lit(0)), F.lit(fine - 1))).cast("int"))
    firsts = placed.groupBy("_p").agg(F.max(F.struct("_d", "_h")).alias("k")).orderBy("_p").collect()  # one row a range
    before = [(r.k._d, r.k._h, p._p) for r, p in zip(firsts, [firsts[-1], *firsts[:-1]], strict=True)] if firsts else []
    guests = spark.createDataFrame(before, "_d long, _h long, _g int")
    sent = placed.join(F.broadcast(guests), ["_d", "_h"], "left")  # as many rows as ranges
    # a guest row stands after all own rows of its range
    own = F.struct(F.col("_p").alias("p"), F.lit(0).alias("guest"))
    dealt = sent.withColumn("_to", F.explode(F.when(F.col("_g").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_g").alias("p"), F.lit(1).alias("guest"))))))
    dealt = dealt.select(F.col("_to.p").alias("_p"), F.col("_to.guest").alias("_guest"), "_d", "_h", "text").repartition(F.col("_p")).sortWithinPartitions("_p", "_guest", F.desc("_d"), F.desc("_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []  # the last document of a batch waits for the next
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("text")
                prints = fingerprint_column(texts)
                rest += zip(part.column("_p").to_pylist(), part.column("_guest").to_pylist(), part.column("_d").to_pylist(), texts.to_pylist(), prints, strict=True)
                if len(rest) > 1:
                    yield _edited(rest)
                    rest = rest[-1:]

    schema = "_d long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
    return dealt.mapInArrow(run, schema).select(keys.doc_id(F.col("_d")).alias("doc_id"), *[c.split()[0] for c in schema.split(", ")[1:]])


def _edited(rows: list[tuple]) -> pa.RecordBatch:
    """Results of all rows but the last, each with the row after it; guests have none."""
    ids, sizes, texts, prints, nexts = [], [], [], [], []
    for (p, guest, d, text, fp), (q, _, _, then, then_fp) in zip(rows[:-1], rows[1:], strict=True):
        if guest:
            continue
        assert p == q, "each range ends with a guest"
        ids.append(d)
        sizes.append(len(text))
        cut = len(text) // 3
        texts.append(text[: len(text) - cut] + then[:cut])
        prints.append(fp)
        nexts.append(then_fp)
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    edited = fingerprint_column(pa.array(texts, pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(x, pa.string()) for x in (digests, prints, edited, nexts))], ["_d", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"])


def query(spark, sf_dir: str) -> DataFrame:
    found = neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))

"""Toxicity: a linear-chain conditional random field tags toxic words.

Learning, on a bounded sample of labelled documents (at most ``MAX_DOCS`` of each label, those with the smallest
hashes; a sampled document counts in the fits for as many as its label has for each sampled one, so scores and marginals
keep the prior of all labels): Spark counts in how many toxic and clean documents every word and word prefix occurs; the at most
``MAX_FEATURES`` that mark toxic documents are the features of the field, and a word of a toxic document that has one
is labelled 1, any other 0. The field (weights, bias, transitions) is fitted by gradient ascent on its conditional
likelihood, with forward-backward expectations, over all chunks of ``CHUNK`` words of the sample that have marked words.
A chunk is cut by place in its text, so neither chunks nor fit depend on how the rows are dealt.

Scoring, for every word of every whole text: most words have no feature, and runs of such words have one constant
transition matrix; its powers are taken in closed form, so forward-backward visits only the words with features and is
exact. Marginals aggregate to a document's score (a logistic of the expected number of toxic words and the highest
marginal), and words with a marginal of 0.5 or more give the offending spans. No shuffle.

Defined results: a null or empty text scores like a text without marked words; without labelled documents of both
labels all scores are 0; repeated rows repeat; of several texts under one labelled doc_id that with the least hash is learned
from, so the sample is bounded; duplicates among the labels count each; input columns named score or spans are replaced by
``tag``, and passed on unchanged by ``stage``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pelagia.llm import keys
from pelagia.llm._text import LETTER, U, Words, signed, slices
from pelagia.session import table, written

MAX_DOCS, MAX_FEATURES, CHUNK, PREFIXES = 4000, 4096, 32, (4, 5, 6)
#: Chunks of which the gradient is taken at a time; bounds the driver's memory, not what is learned from.
CHUNK_BLOCK = 2048


def _words(part: pa.RecordBatch) -> tuple[Words, list[np.ndarray]]:
    words = Words(part.column("text"), lower=True, inside=LETTER, prefixes=PREFIXES)
    return words, [words.hashes, *words.prefix.values()]


def _known(labels: DataFrame) -> DataFrame:
    return labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of at most MAX_DOCS labelled documents of each label; the ids, a bounded table, are broadcast."""
    known = _known(labels)
    order = F.xxhash64("doc_id")
    some = [known.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(MAX_DOCS) for t in (0, 1)]
    some = some[0].unionByName(some[1])
    met = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id").distinct()), "doc_id")
    one = met.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")).alias("k"))
    return one.select("doc_id", F.col("k.text").alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic")


def stands_for(labels: DataFrame) -> np.ndarray:
    """How many labelled documents each sampled one stands for, by label: 1 up to MAX_DOCS."""
    counts = dict(_known(labels).groupBy("toxic").count().where("toxic in (0, 1)").toPandas().itertuples(index=False))
    return np.array([max(counts.get(t, 0) / MAX_DOCS, 1.0) for t in (0, 1)])


def features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of at most MAX_FEATURES words and prefixes that mark toxic documents; documents by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, hashes = _words(part)
                doc = np.repeat(np.arange(part.num_rows), words.counts)
                toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                pairs = np.concatenate([np.stack((doc.astype(U)[h != 0], h[h != 0])) for h in hashes], 1)
                order = np.lexsort(pairs)
                pairs = pairs[:, order]
                once = np.append(True, (pairs[:, 1:] != pairs[:, :-1]).any(0)) if pairs.shape[1] else np.zeros(0, bool)
                pairs = pairs[:, once]
                distinct, inverse = np.unique(pairs[1], return_inverse=True)
                counts = np.bincount(inverse * 2 + toxic[pairs[0].astype(np.int64)], minlength=2 * len(distinct)).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(signed(distinct)), pa.array(counts[:, 0]), pa.array(counts[:, 1])], ["h", "clean", "toxic"])

    sizes = dict(sample.groupBy("toxic").count().toPandas().itertuples(index=False))
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return np.zeros(0, U), np.array([clean, toxic])
    lift = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    found = sample.mapInArrow(run, "h long, clean long, toxic long").groupBy("h").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    marked = found.where((F.col("toxic") >= 4) & (lift >= 3)).orderBy((lift * F.sqrt("toxic")).desc(), "h").limit(MAX_FEATURES)
    return np.sort(np.array([r.h for r in marked.select("h").collect()], np.int64).view(U)), np.array([clean, toxic])


class Marked:
    """The words of a slice that have features: index (in the slice), text, rank in the text, feature ids [n, kinds] (-1: none)."""

    def __init__(self, part: pa.RecordBatch, known: np.ndarray):
        self.words, hashes = _words(part)
        ids = np.full((len(hashes), len(self.words.starts)), -1, np.int32)
        sieve = np.zeros(1 << 16, bool)
        sieve[(known >> U(48)).astype(np.int64)] = True
        for row, h in zip(ids, hashes, strict=True):
            maybe = np.flatnonzero(sieve[(h >> U(48)).astype(np.int64)])
            at = np.searchsorted(known, h[maybe])
            at[at == len(known)] = 0
            good = known[at] == h[maybe] if len(known) else np.zeros(len(maybe), bool)
            row[maybe[good]] = at[good]
        self.index = np.flatnonzero((ids >= 0).any(0))
        self.ids = ids[:, self.index].T
        self.text = np.searchsorted(self.words.first, self.index, "right") - 1
        begin = np.searchsorted(self.index, self.words.first)
        self.begin, self.count = begin[:-1], np.diff(begin)


def _chunks(sample: DataFrame, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The marked words of all chunks of the sample (a bounded number of documents): chunk, place, feature ids, label
    (that of the document, so of all words of a chunk). Chunks are numbered by a hash of (doc_id, text) and their place in the text."""
    shared = sample.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                m = Marked(part, shared.value)
                toxic, key, row = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[m.text] for c in ("toxic", "key", "row"))
                rank = m.index - m.words.first[m.text]
                rows = [key, row, rank // CHUNK, *(np.asarray(r, np.int32) for r in (rank % CHUNK, toxic, *m.ids.T))]
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["key", "row", "part", "place", "y", *(f"f{i}" for i in range(len(PREFIXES) + 1))])

    fields = ", ".join(f"f{i} int" for i in range(len(PREFIXES) + 1))
    # row tells equal rows apart
    keyed = sample.select("text", "toxic", F.xxhash64("doc_id", "text").alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = keyed.mapInArrow(run, f"key long, row long, part long, place int, y int, {fields}").toPandas().sort_values(["key", "row", "part", "place"])
    edges = (rows[["key", "row", "part"]].diff() != 0).any(axis=1).to_numpy()
    return np.cumsum(edges) - 1, rows.place.to_numpy(), rows[[f"f{i}" for i in range(len(PREFIXES) + 1)]].to_numpy(), rows.y.to_numpy()


def _expected(theta: np.ndarray, n: int, chunk: np.ndarray, place: np.ndarray, flat_rows: np.ndarray, flat_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 [n, CHUNK] and expected transitions of each chunk [n, 2, 2], by forward-backward."""
    n_features = len(theta) - 5
    weights, bias, moves = theta[:n_features], theta[n_features], theta[n_features + 1 :].reshape(2, 2)
    lift = bias + np.bincount(chunk[flat_rows] * CHUNK + place[flat_rows], weights[flat_ids], n * CHUNK).reshape(n, CHUNK)
    # each word's factors are scaled by the larger, each step's sums to 1: the scales cancel
    unary = np.stack((np.exp(np.minimum(-lift, 0)), np.exp(np.minimum(lift, 0))), 2)
    step = np.exp(moves - moves.max())
    ahead, back = np.zeros((n, CHUNK, 2)), np.ones((n, CHUNK, 2))
    own = unary[:, 0]
    for t in range(CHUNK):
        if t:
            own = (ahead[:, t - 1] @ step) * unary[:, t]
        ahead[:, t] = own / own.sum(1, keepdims=True)
    for t in range(CHUNK - 2, -1, -1):
        own = (unary[:, t + 1] * back[:, t + 1]) @ step.T
        back[:, t] = own / own.sum(1, keepdims=True)
    joint = ahead * back
    marginal = joint[:, :, 1] / joint.sum(2)
    both = ahead[:, :-1, :, None] * step * (unary[:, 1:] * back[:, 1:])[:, :, None, :]
    return marginal, (both / both.sum((2, 3), keepdims=True)).sum(1)


def fit_field(chunk: np.ndarray, place: np.ndarray, ids: np.ndarray, labels: np.ndarray, n_features: int, steps: int = 120, shares: np.ndarray = np.ones(2)) -> dict:
    """Weights of the features, bias of label 1 and transitions [2, 2], by Adam on the penalised conditional likelihood.
    ``chunk`` ascends; ``shares``: how much a chunk of a clean and of a toxic document counts."""
    n = int(chunk.max()) + 1
    y = np.zeros((n, CHUNK), np.int64)
    y[chunk, place] = labels
    weight = shares[y.max(1)]
    seen = np.bincount((2 * y[:, :-1] + y[:, 1:]).ravel(), np.repeat(weight, CHUNK - 1), 4)
    blocks = []
    for first in range(0, n, CHUNK_BLOCK):
        last = min(n, first + CHUNK_BLOCK)
        a, b = np.searchsorted(chunk, (first, last))
        own = ids[a:b]
        blocks.append((first, last, chunk[a:b] - first, place[a:b], np.repeat(np.arange(b - a), (own >= 0).sum(1)), own[own >= 0]))
    theta = np.zeros(n_features + 5)
    theta[n_features] = -3.0
    first_moment, second_moment = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        slope = np.zeros_like(theta)
        slope[n_features + 1 :] = seen
        for first, last, own, at, flat_rows, flat_ids in blocks:
            marginal, both = _expected(theta, last - first, own, at, flat_rows, flat_ids)
            error = (y[first:last] - marginal) * weight[first:last, None]
            slope[:n_features] += np.bincount(flat_ids, error[own[flat_rows], at[flat_rows]], n_features)
            slope[n_features] += error.sum()
            slope[n_features + 1 :] -= np.tensordot(weight[first:last], both, 1).ravel()
        slope = slope / weight.sum() - 1e-4 * theta
        first_moment, second_moment = 0.9 * first_moment + 0.1 * slope, 0.99 * second_moment + 0.01 * slope**2
        theta = theta + 0.15 * (first_moment / (1 - 0.9**step)) / (np.sqrt(second_moment / (1 - 0.99**step)) + 1e-8)
    return {"weights": theta[:n_features], "bias": float(theta[n_features]), "moves": theta[n_features + 1 :].reshape(2, 2)}


def _power(field: dict):
    """g -> the g-th power of the constant matrix of words without features, each scaled by its largest eigenvalue."""
    neutral = np.exp(field["moves"]) * np.array([1.0, np.exp(field["bias"])])
    values, right = np.linalg.eig(neutral)
    values, right = values.real, right.real
    left = np.linalg.inv(right)
    share = values / np.abs(values).max()

    def power(g: np.ndarray) -> np.ndarray:
        return np.einsum("ik,nk,kj->nij", right, share[None, :] ** g[:, None], left)

    return power


def marginals(m: Marked, field: dict) -> np.ndarray:
    """Probability of label 1 of each marked word, by forward-backward over each whole text."""
    n = len(m.index)
    if not n:
        return np.zeros(0)
    power, moves, bias = _power(field), np.exp(field["moves"]), field["bias"]
    padded = np.append(field["weights"], 0.0)
    lift = np.clip(bias + padded[m.ids].sum(1), -60, 60)
    first, last = m.words.first[m.text], m.words.first[m.text + 1]
    rank = np.arange(n) - m.begin[m.text]
    before = np.where(rank > 0, m.index - np.append(-1, m.index[:-1]) - 1, m.index - first)  # words without features before it
    after = np.where(rank < m.count[m.text] - 1, np.append(m.index[1:], 0) - m.index - 1, last - m.index - 1)
    unary = np.stack((np.zeros(n), lift), 1)
    unary = np.exp(unary - unary.max(1, keepdims=True))
    start = np.array([1.0, np.exp(bias)])
    ahead, back = np.zeros((n, 2)), np.ones((n, 2))
    order = np.argsort(rank, kind="stable")
    steps = np.split(order, np.flatnonzero(np.diff(rank[order])) + 1)
    across = power(before) @ moves  # over the words before it, then into the word
    for at in steps:
        if rank[at[0]] == 0:
            # the first word of a text has no transition into it
            lead = np.where(before[at, None] > 0, np.einsum("i,nij->nj", start, power(np.maximum(before[at] - 1, 0)) @ moves), 1.0)
        else:
            lead = np.einsum("ni,nij->nj", ahead[at - 1], across[at])
        own = lead * unary[at]
        ahead[at] = own / own.sum(1, keepdims=True)
    tail = power(after)
    for at in reversed(steps):
        ends = rank[at] == m.count[m.text[at]] - 1
        own = np.ones((len(at), 2))
        own[ends] = tail[at[ends]].sum(2)
        go = at[~ends]
        own[~ends] = np.einsum("nij,nj->ni", across[go + 1], unary[go + 1] * back[go + 1])
        back[at] = own / own.sum(1, keepdims=True)
    joint = ahead * back
    return joint[:, 1] / joint.sum(1)


def _evidence(m: Marked, p: np.ndarray, rows: int) -> np.ndarray:
    """Of each text: 1, log(1 + expected toxic words), the highest marginal."""
    total = np.bincount(m.text, p, rows)
    top = np.zeros(rows)
    np.maximum.at(top, m.text, p)
    return np.stack((np.ones(rows), np.log1p(total), top), 1)


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model from (doc_id, text) and (doc_id, toxic); null unless both labels occur."""
    sample = written(_sample(docs, labels))  # 2 MAX_DOCS rows at most, read four times
    known, sizes = features(sample)
    if not sizes.all():
        return None
    shares = stands_for(labels)
    prior = np.log(shares[1] / shares[0])  # the odds of all labels by those of the sample
    model = {"known": known, "field": {"weights": np.zeros(0), "bias": -3.0, "moves": np.zeros((2, 2))}, "doc": np.array([np.log(sizes[1] / sizes[0]) + prior, 0.0, 0.0])}
    if not len(known):
        return model
    chunk, place, ids, labels_ = _chunks(sample, known)
    model["field"] = fit_field(chunk, place, ids, labels_, len(known), shares=shares)
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                m = Marked(part, shared.value["known"])
                x = _evidence(m, marginals(m, shared.value["field"]), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 1]), pa.array(x[:, 2]), part.column("toxic").cast(pa.int32())], ["total", "top", "y"])

    rows = sample.mapInArrow(run, "total double, top double, y int").toPandas()  # three numbers for each sampled document
    x, y = np.stack((np.ones(len(rows)), rows.total, rows.top), 1), rows.y.to_numpy()
    w = np.zeros(3)
    for _ in range(30):  # Newton steps, penalised
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * w)
    # the sample holds as many documents of each label as it can; the odds are put back to those of all labels
    model["doc"] = w + np.array([prior, 0.0, 0.0])
    return model


def tag(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with score (0 to 1) and spans, an array of (first, last, p): code point ranges [first, last) of toxic words."""
    keep = [c for c in docs.columns if c.lower() not in {"score", "spans"}]
    span = "array<struct<first:int,last:int,p:double>>"
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"), F.array().cast(span).alias("spans"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, field, doc = (shared.value[k] for k in ("known", "field", "doc"))
        for batch in batches:
            for part in slices(batch):
                m = Marked(part, known)
                p = marginals(m, field)
                score = 1 / (1 + np.exp(-np.clip(_evidence(m, p, part.num_rows) @ doc, -30, 30)))
                bad = np.flatnonzero(p >= 0.5)
                points = np.append(0, np.cumsum((m.words.raw & 0xC0) != 0x80))  # code points before each byte
                begin = points[m.words.offsets[m.text[bad]]]
                where = m.index[bad]
                fields = [pa.array((points[m.words.starts[where]] - begin).astype(np.int32)), pa.array((points[m.words.ends[where]] - begin).astype(np.int32)), pa.array(p[bad])]
                ends = np.append(0, np.cumsum(np.bincount(m.text[bad], minlength=part.num_rows))).astype(np.int32)
                spans = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, ["first", "last", "p"]))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(score), spans], [*keep, "score", "spans"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["score double", f"spans {span}"])
    return docs.select(*keep).mapInArrow(run, schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    found = tag(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are not toxic (score under 0.5), with their own columns."""
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    own = keys.hidden(docs, "doc_id", "text")
    return tag(own, model).where("score < 0.5").select(*own.columns).toDF(*docs.columns)

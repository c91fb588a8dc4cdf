"""Cross-tokenizer alignment by byte-owner arrays.

Two tokenizers cut the bytes of " " + text. ``np.repeat`` of the token indices over the tokens' bytes gives, for either, the owner of
each byte. Where either owner changes, an overlap of two tokens begins; where both change at once, both have a token's end, and
the text is cut into groups. All pairs of an A and a B token in one group are links.

A document's links are kept as distinct pairs of ids with a weight. Pairs are counted by the documents that hold them: every block
of documents asks with its distinct pairs, in parts of the pairs' hashes, and gets back their counts (``_blocks``). The
highest count of each A id is a maximum over parts, as long as A's vocabulary, which bounds the one broadcast.

A is byte-level BPE, by the pair index of ``bpe`` without special tokens (their strings are plain text); B is a sentencepiece model.

Defined results: a text that is null, empty, or that a tokenizer does not give back byte by byte (a literal U+2581) has no tokens and
zeros; repeated rows are documents of their own and count each; a null doc_id stays null; ties for an A id's highest count all count as
best; only doc_id and text are read, so other columns cannot clash; an empty table gives no rows. Memory follows a slice of texts
or the distinct pairs of the longest document, whichever is larger.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pelagia.llm import _blocks as blocks
from pelagia.llm import bpe
from pelagia.llm._text import buffers, slices, spans
from pelagia.session import table, written

SMALL = 64


class Tokens:
    """The tokens of a slice of texts by one tokenizer: ids and byte sizes, flat, and how many each text has."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray):
        self.ids, self.counts, self.sizes = ids, counts, sizes

    def of(self, texts: np.ndarray) -> Tokens:
        """Without the tokens of texts that are not marked."""
        keep = np.repeat(texts, self.counts)
        return Tokens(self.ids[keep], np.where(texts, self.counts, 0), self.sizes[keep])


class Vocabulary:
    """Bytes of every id, and whether a slice's tokens give the texts back."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def tokens(self, ids: np.ndarray, counts: np.ndarray) -> Tokens:
        return Tokens(ids, counts, self.sizes[ids])

    def equal(self, t: Tokens, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ends = np.append(0, np.cumsum(t.sizes))
        edges = ends[np.append(0, np.cumsum(t.counts))]
        good = np.diff(edges) == np.diff(offsets)
        keep = np.repeat(good, t.counts)
        data = self.bytes[spans(self.first[t.ids[keep]], t.sizes[keep])]
        same = data == raw[np.repeat(good, np.diff(offsets))]
        at = np.append(0, np.cumsum(np.where(good, np.diff(offsets), 0)))
        wrong = np.append(0, np.cumsum(~same))
        return good & (wrong[at[1:]] == wrong[at[:-1]])


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, a: str, b: bytes):
        import sentencepiece

        self.a = bpe.PairIndexBPE(json.dumps(json.loads(a) | {"added_tokens": []}))
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.vocab_a = Vocabulary(self.a.token)
        self.vocab_b = Vocabulary([bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)])
        self.n_b = len(pieces)
        digits = [b"%d," % i for i in range(max(self.a.size, self.n_b))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digit_sizes = np.array([len(x) for x in digits], np.int64)
        self.digit_first = np.cumsum(self.digit_sizes) - self.digit_sizes

    def align(self, texts: pa.Array) -> Aligned:
        return Aligned(self, texts)


class Aligned:
    """Groups of a slice of texts: of each text its tokens a, b and counts n_groups and n_overlaps; of each token its group (of the
    slice, ascending)."""

    def __init__(self, by: Aligner, texts: pa.Array):
        self.by = by
        texts = texts.cast(pa.large_string()).fill_null("")
        some = np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False)) > 0
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        raw, offsets = buffers(spaced)
        listed = by.a.encode(spaced)
        a = by.vocab_a.tokens(listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64), listed.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        found = by.b.encode(texts.to_pylist(), num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        b = by.vocab_b.tokens(np.fromiter((i for x in found for i in x), np.int64, int(counts.sum())), counts)
        good = some & by.vocab_a.equal(a, raw, offsets) & by.vocab_b.equal(b, raw, offsets)
        self.a, self.b, self.texts = a.of(good), b.of(good), len(offsets) - 1
        sizes = np.where(good, np.diff(offsets), 0)
        n = int(sizes.sum())
        owner_a = np.repeat(np.arange(len(self.a.ids), dtype=np.int32), self.a.sizes)
        owner_b = np.repeat(np.arange(len(self.b.ids), dtype=np.int32), self.b.sizes)
        new_a, new_b = np.ones(n, bool), np.ones(n, bool)
        np.not_equal(owner_a[1:], owner_a[:-1], out=new_a[1:])
        np.not_equal(owner_b[1:], owner_b[:-1], out=new_b[1:])
        cut, overlap = new_a & new_b, new_a | new_b
        group = np.cumsum(cut) - 1
        edges = np.append(0, np.cumsum(sizes))
        self.n_groups, self.n_overlaps = (np.diff(np.append(0, np.cumsum(x))[edges]) for x in (cut, overlap))
        self.group_a, self.group_b = group[new_a], group[new_b]
        self.groups = int(cut.sum())
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=self.groups), np.bincount(self.group_b, minlength=self.groups)
        self.text_of = np.repeat(np.arange(self.texts), self.n_groups)
        self.n_links = np.bincount(self.text_of, self.in_a.astype(np.float64) * self.in_b, self.texts).astype(np.int64)

    def digests(self) -> list[str]:
        """The groups of each text as ``a,a|b;a|b,b``, hashed; '' without tokens."""
        n_a, n_b = len(self.group_a), len(self.group_b)
        before_a, before_b = np.append(0, np.cumsum(self.in_a)), np.append(0, np.cumsum(self.in_b))
        at_a = np.arange(n_a) + before_b[self.group_a]
        at_b = np.arange(n_b) + before_a[self.group_b + 1]
        ids, ends = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a.ids, self.b.ids
        last = np.ones(n_a, bool)
        last[:-1] = self.group_a[1:] != self.group_a[:-1]
        ends[at_a[last]] = ord("|")
        last = np.ones(n_b, bool)
        last[:-1] = self.group_b[1:] != self.group_b[:-1]
        ends[at_b[last]] = ord(";")
        sizes = self.by.digit_sizes[ids]
        data = self.by.digits[spans(self.by.digit_first[ids], sizes)]
        upto = np.append(0, np.cumsum(sizes))
        data[upto[1:] - 1] = ends
        edges = upto[np.append(0, np.cumsum(self.a.counts + self.b.counts))].tolist()
        view = memoryview(data.tobytes())
        return [hashlib.sha256(view[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(edges[:-1], edges[1:], strict=True)]

    def _product(self, a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, key, weight) of all pairs of entries (group, id, weight; ordered by group) in one group."""
        in_b = np.bincount(b[0], minlength=self.groups)
        first_b = np.cumsum(in_b) - in_b
        times = in_b[a[0]]
        left = np.repeat(np.arange(len(a[0])), times)
        right = spans(first_b[a[0]], times)
        return a[0][left], a[1][left] * self.by.n_b + b[1][right], a[2][left] * b[2][right]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, key, weight), distinct and ordered: how many links of each text have the pair of ids key = a * n_b + b. Ids that a
        large group repeats are counted before they are paired."""
        large = self.in_a * self.in_b > SMALL
        found = []
        for big in (False, True):
            sides = []
            for group, ids in ((self.group_a, self.a.ids), (self.group_b, self.b.ids)):
                own = large[group] == big
                g, i, w = group[own], ids[own], np.ones(int(own.sum()), np.int64)
                if big:
                    both, w = np.unique(g << 32 | i, return_counts=True)
                    g, i = both >> 32, both & 0xFFFFFFFF
                sides.append((g, i, w))
            found.append(self._product(*sides))
        group, key, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        text = self.text_of[group]
        order = np.lexsort((key, text)) if int(key.max(initial=0)) >> 40 or self.texts >> 22 else np.argsort(text << 40 | key)
        text, key, weight = text[order], key[order], weight[order]
        if not len(key):
            return text, key, weight
        begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])))
        return text[begin], key[begin], np.add.reduceat(weight, begin)


_aligners: dict[int, Aligner] = {}


def _shared(spark, a: str | None, b: str | None):
    """Both vocabularies (of fixed size), broadcast."""
    if a is None or b is None:
        import public_tokenizers

        a, b = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        return spark.sparkContext.broadcast((f.read(), g.read()))


def _aligner(spec) -> Aligner:
    key = hash(spec.value)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(*spec.value)
    return _aligners[key]


def align(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, a, b (token ids of every whole text), group_a, group_b (each token's group, from 0)."""
    spec = _shared(docs.sparkSession, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _aligner(spec)
        for batch in batches:
            for part in slices(batch):
                found = by.align(part.column("text"))
                start = np.cumsum(found.n_groups) - found.n_groups
                lists = []
                for tokens, group in ((found.a, found.group_a), (found.b, found.group_b)):
                    ends = np.append(0, np.cumsum(tokens.counts)).astype(np.int32)
                    own = group - np.repeat(start, tokens.counts)
                    lists += [pa.ListArray.from_arrays(ends, v.astype(np.int32)) for v in (tokens.ids, own)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], ["doc_id", "a", "group_a", "b", "group_b"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, a array<int>, group_a array<int>, b array<int>, group_b array<int>")


COUNTS = ["n_a", "n_b", "n_groups", "n_overlaps", "n_links"]


def _blocks(docs: DataFrame, spec) -> DataFrame:
    """A row for each slice of documents: its documents' counts and digests, its distinct pairs (keys) with the documents that hold
    them (held), and each document's pairs as places in keys (steps from one to the next) with weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, names = _aligner(spec), blocks.block_ids()
        for batch in batches:
            for part in slices(batch):
                found = by.align(part.column("text"))
                text, key, weight = found.pairs()
                keys, place, held = np.unique(key, return_inverse=True, return_counts=True)
                sizes = np.bincount(text, minlength=part.num_rows)
                steps = np.diff(place, prepend=0)
                first = (np.cumsum(sizes) - sizes)[sizes > 0]
                steps[first] = place[first]
                one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                numbers = [found.a.counts, found.b.counts, found.n_groups, found.n_overlaps, found.n_links]
                blobs = [keys.astype(np.uint64), held.astype(np.uint32), sizes.astype(np.uint32), steps.astype(np.uint32), weight.astype(np.uint64)]
                arrays = [pa.array([next(names)], pa.int64()), one(part.column("doc_id")), *(one(pa.array(v, pa.int64())) for v in numbers), one(pa.array(found.digests(), pa.string())), *(pa.array([blocks.pack(v)], pa.binary()) for v in blobs)]
                yield pa.RecordBatch.from_arrays(arrays, ["b", "doc_id", *COUNTS, "sha", "keys", "held", "sizes", "steps", "weights"])

    of = docs.schema["doc_id"].dataType.simpleString()
    schema = f"b long, doc_id array<{of}>, {', '.join(f'{c} array<long>' for c in COUNTS)}, sha array<string>, keys binary, held binary, sizes binary, steps binary, weights binary"
    return written(docs.select("doc_id", "text").mapInArrow(run, schema))


def _asked(made: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, keys, held in zip(batch.column("b").to_pylist(), batch.column("keys").to_pylist(), batch.column("held").to_pylist(), strict=True):
                keys, held = blocks.unpack(keys, np.uint64), blocks.unpack(held, np.uint32)
                out = [(p, blocks.pack(keys[at]), blocks.pack(held[at])) for p, at in blocks.in_parts(blocks.part(keys, n), n)]
                if out:
                    p, k, h = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([b] * len(p), pa.int64()), pa.array(p, pa.int32()), pa.array(k, pa.binary()), pa.array(h, pa.binary())], ["b", "p", "keys", "held"])

    return made.select("b", "keys", "held").mapInArrow(run, "b long, p int, keys binary, held binary")


def _counter(n_b: int):
    def count(asked: pa.Table) -> pa.Table:
        """How many documents hold each asked pair, for each block; and, in a row without a block, the highest count of each A id."""
        keys = [blocks.unpack(x, np.uint64) for x in asked.column("keys").to_pylist()]
        held = np.concatenate([blocks.unpack(x, np.uint32) for x in asked.column("held").to_pylist()]).astype(np.float64)
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, held).astype(np.uint64)
        answers = np.split(total[place], np.cumsum([len(x) for x in keys])[:-1])
        ids, first = np.unique(distinct // np.uint64(n_b), return_index=True)
        most = np.maximum.reduceat(total, first)
        b, p = asked.column("b").to_pylist(), asked.column("p")[0].as_py()
        blobs = [blocks.pack(x) for x in answers] + [blocks.pack(np.concatenate((ids, most)))]
        return pa.table({"b": pa.array([*b, None], pa.int64()), "p": pa.array([p] * (len(b) + 1), pa.int32()), "counts": pa.array(blobs, pa.binary())})

    return count


def _most(replies: DataFrame) -> DataFrame:
    """a, most: the highest count of every A id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                ids, most = blocks.unpack(blob, np.uint64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(most.astype(np.int64))], ["a", "most"])

    return replies.where("b is null").select("counts").mapInArrow(run, "a long, most long").groupBy("a").agg(F.max("most").alias("most"))


def scores(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, the document's COUNTS, n_best (links whose pair has the highest count of its A id), count_sum (the counts of all its
    links, summed) and groups_sha256."""
    spark = docs.sparkSession
    spec, n = _shared(spark, a, b), blocks.parts(spark)
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_proto=spec.value[1]).vocab_size()
    made = _blocks(docs, spec)
    replies = blocks.answered(_asked(made, n), _counter(n_b), "b long, p int, counts binary")
    rows = _most(replies).collect()  # one row an id of A's vocabulary
    most = np.zeros(1 + max((r.a for r in rows), default=0), np.uint64)
    for r in rows:
        most[r.a] = r.most
    best = spark.sparkContext.broadcast(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = blocks.unpack(batch.column("keys")[i].as_py(), np.uint64)
                counts = np.zeros(len(keys), np.uint64)
                given = {r["p"]: r["counts"] for r in batch.column("replies")[i].as_py() or ()}
                for p, at in blocks.in_parts(blocks.part(keys, n), n):
                    counts[at] = blocks.unpack(given[p], np.uint64)
                top = counts == best.value[(keys // np.uint64(n_b)).astype(np.int64)] if len(keys) else np.zeros(0, bool)
                sizes, steps, weights = (blocks.unpack(batch.column(c)[i].as_py(), t).astype(np.int64) for c, t in (("sizes", np.uint32), ("steps", np.uint32), ("weights", np.uint64)))
                edges = np.append(0, np.cumsum(sizes))
                run_up = np.append(0, np.cumsum(steps))
                place = run_up[1:] - np.repeat(run_up[edges[:-1]], sizes)
                sums = [np.diff(np.append(0, np.cumsum(v))[edges]) for v in (weights * top[place], weights * counts.astype(np.int64)[place])]
                columns = [batch.column(c)[i].values for c in ("doc_id", *COUNTS)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, pa.int64()) for v in sums), batch.column("sha")[i].values], ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])

    of = docs.schema["doc_id"].dataType.simpleString()
    found = blocks.joined(made.drop("held"), replies.where("b is not null"), "counts")
    return found.mapInArrow(run, f"doc_id {of}, {', '.join(f'{c} long' for c in COUNTS)}, n_best long, count_sum long, groups_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))

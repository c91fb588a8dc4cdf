"""BPE encoding and decoding by a pair occurrence index.

The words of a batch that are not yet known are laid out as one symbol sequence. An index maps every adjacent pair to
all its positions; a heap holds the ranks of the pairs that occur. The lowest active rank is taken, all its positions
are merged from left to right, and only the lists of the pairs beside a merge are updated, until no rank is active.
Encoding a run of n symbols takes O(n log n) whatever its length. Texts are split as byte-level BPE asks for
('s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+) by numpy masks over character kinds.

Rows are independent: no shuffle; a worker keeps encoded words up to ``CACHED`` entries. The vocabulary file is read
on the driver and broadcast (its size is fixed).

Defined results: a null text is the empty text (no tokens); special tokens' strings become their ids; rows keep their
order and repeated rows repeat; columns of the input other than the text are passed on unchanged, and a clash of an
output name with one of them is resolved in favour of the output.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from pelagia.llm._text import SLICE, U, buffers, inverse_powers, mix, powers, spans

CACHED = 700_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def kinds() -> np.ndarray:
    """The kind of every code point: white space 0, letters 1, numbers 2, the rest 3."""
    out = np.full(0x110000, 3, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((0, r"\s+"), (1, r"\p{L}+"), (2, r"\p{N}+")):
        for m in regex.finditer(pattern, points):
            a, b = (x + 0x800 * (x >= 0xD800) for x in (m.start(), m.end() - 1))
            out[a : b + 1] = kind
    return out


class PairIndexBPE:
    """Byte-level BPE with the vocabulary of a ``tokenizers`` JSON file (its text)."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        letters = byte_letters()
        self.special = {x["content"]: x["id"] for x in model.get("added_tokens", ())}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.size = size
        self.token: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.token[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.token[i] = word.encode()
        self.of_byte = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32)
        rank: dict[int, int] = {}
        self.made, self.pairs = [], []
        for at, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = vocab[left], vocab[right]
            rank.setdefault(a * size + b, at)
            self.made.append(vocab[left + right])
            self.pairs.append((a, b))
        keys = np.fromiter(rank, np.int64, len(rank))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(rank.values(), np.int64, len(rank))[order]
        self.token_sizes = np.array([len(t) for t in self.token], np.int64)
        self.token_first = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.known, self.sizes, self.first, self.flat = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.always = np.zeros(0, U)  # the special tokens' hashes: merge() cannot make their ids, so their entries stay
        for word, i in self.special.items():
            _, _, h = self.words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))
            self._keep(h[:1], np.array([i], np.int32), np.array([1]))
            self.always = np.append(self.always, h[:1])

    def merge(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words raw[starts:ends], flat, and how many each word has; one index over all the words."""
        size, n_words = self.size, len(starts)
        counts = ends - starts
        n = int(counts.sum()) + n_words + 1
        symbols = np.full(n, -1, np.int32)  # -1: a word's end, which no pair reaches over
        places = np.ones(n, bool)
        places[0] = False
        places[np.cumsum(counts + 1)] = False
        symbols[places] = self.of_byte[raw[spans(starts, counts)]]
        before, after = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            """File the positions ``at`` of the pairs (left, right) under their ranks."""
            keys = left.astype(np.int64) * size + right
            found = np.searchsorted(self.keys, keys)
            found[found == len(self.keys)] = 0
            good = (self.keys[found] == keys) & (left >= 0) & (right >= 0)
            at, ranks = at[good], self.ranks[found[good]]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            edges = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, own in zip(ranks[np.append(0, edges)].tolist(), np.split(at, edges), strict=True):
                if rank in index:
                    index[rank].append(own)
                else:
                    index[rank] = [own]
                    heapq.heappush(active, rank)

        every = np.arange(n - 1, dtype=np.int32)
        if len(self.keys):
            add(every, symbols[:-1], symbols[1:])
        while active:
            rank = heapq.heappop(active)
            a, b = self.pairs[rank]
            new = self.made[rank]
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            then = after[at]
            good = (symbols[at] == a) & (symbols[then] == b)
            at, then = at[good], then[good]
            if a == b and len(at) > 1 and (then[:-1] == at[1:]).any():  # of overlapping places every other one, from the left
                run = np.cumsum(np.append(True, then[:-1] != at[1:])) - 1
                first = np.flatnonzero(np.append(True, np.diff(run) > 0))
                odd = (np.arange(len(at)) - first[run]) % 2 == 0
                at, then = at[odd], then[odd]
            if not len(at):
                continue
            symbols[at], symbols[then] = new, -2
            beyond = after[then]
            after[at] = beyond
            before[beyond] = at
            left = before[at]
            add(np.concatenate((left, at)), np.concatenate((symbols[left], np.full(len(at), new, np.int32))), np.concatenate((np.full(len(at), new, np.int32), symbols[beyond])))
        kept = symbols >= 0
        words = np.cumsum(~places)[kept] - 1
        return symbols[kept], np.bincount(words, minlength=n_words).astype(np.int64)

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts of the splitting pattern's matches, each text's first match, and the matches' hashes."""
        n = len(raw)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, U)
        cuts = [offsets[:-1][np.diff(offsets) > 0]]
        inner: list[np.ndarray] = []
        blob = raw.tobytes()
        for word in self.special:  # a special token's string is a text of its own
            word_bytes = word.encode()
            at = blob.find(word_bytes)
            while at >= 0:
                text_end = offsets[np.searchsorted(offsets, at, "right")]
                if at + len(word_bytes) <= text_end:
                    cuts.append(np.array([at, at + len(word_bytes)]))
                    inner.append(np.arange(at + 1, at + len(word_bytes)))
                    at = blob.find(word_bytes, at + len(word_bytes))
                else:
                    at = blob.find(word_bytes, at + 1)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each character
        head = raw[lead].astype(np.int32)
        point = head.copy()
        wide = np.flatnonzero(head >= 0xC0)
        if len(wide):
            padded = np.append(raw, np.zeros(3, np.uint8)).astype(np.int32)
            w, h = lead[wide], head[wide]
            one, two, three = (padded[w + k] & 0x3F for k in (1, 2, 3))
            point[wide] = np.where(h < 0xE0, (h & 0x1F) << 6 | one, np.where(h < 0xF0, (h & 0xF) << 12 | one << 6 | two, (h & 7) << 18 | one << 12 | two << 6 | three))
        kind = kinds()[point]
        m = len(lead)
        fresh = np.zeros(m + 1, bool)  # a text begins here
        cut = np.concatenate(cuts)
        fresh[np.searchsorted(lead, cut[cut < n])] = True
        fresh[m] = True
        gap = kind == 0
        start = fresh[:-1].copy()
        ahead = np.append(gap[1:], True) | fresh[1:]  # the next character is white space, or there is none
        behind, blank = np.append(0, kind[:-1]), np.append(False, head[:-1] == 32)
        start |= np.where(gap, (behind != 0) | ~ahead, (behind != kind) & ~blank)
        quote = np.flatnonzero((head == 39) & start)
        if len(quote):
            text_end = np.append(np.flatnonzero(fresh), m)
            left = text_end[np.searchsorted(text_end, quote, "right")] - quote
            seen = np.append(point, [0, 0, 0])
            one, two = seen[quote + 1], seen[quote + 2]
            short = np.isin(one, [115, 116, 109, 100]) & (left >= 2)
            long = (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)) & (left >= 3)
            start[quote[short | long] + 1] = False
            start[quote[long] + 2] = False
            after = np.append(quote[short] + 2, quote[long] + 3)
            start[after[after < m]] = True
        starts = lead[start]
        if inner:
            starts = starts[~np.isin(starts, np.concatenate(inner))]
        sums = np.zeros(n + 1, U)
        np.cumsum(raw.astype(U) * powers(n), out=sums[1:])
        ends = np.append(starts[1:], n)
        hashes = mix((sums[ends] - sums[starts]) * inverse_powers(n + 1)[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))
        return starts, np.searchsorted(starts, offsets), hashes

    def encode(self, column: pa.Array) -> pa.ListArray:
        """Ids of each text; special tokens' strings become their ids; a null is the empty text."""
        raw, offsets = buffers(column)
        pieces, new = [], {}
        at, n = 0, len(offsets) - 1
        while at < n:  # slices of about SLICE bytes
            stop = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1))
            own = raw[offsets[at] : offsets[stop]]
            starts, first, hashes = self.words(own, offsets[at : stop + 1] - offsets[at])
            distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            lack = where[~np.isin(distinct, self.known, assume_unique=True)]
            ends = np.append(starts[1:], len(own))
            base = int(offsets[at])
            new.update(zip(hashes[lack].tolist(), zip((starts[lack] + base).tolist(), (ends[lack] + base).tolist(), strict=True), strict=True))
            pieces.append((distinct, inverse.astype(np.int32), np.diff(first)))
            at = stop
        if new:
            if len(self.known) + len(new) > CACHED:  # what this batch needs is encoded anew
                need = np.unique(np.concatenate([self.always, *(p[0] for p in pieces)]))
                keep = np.flatnonzero(np.isin(self.known, need, assume_unique=True))
                self.flat, self.sizes = self.flat[spans(self.first[keep], self.sizes[keep])], self.sizes[keep]
                self.known, self.first = self.known[keep], np.cumsum(self.sizes) - self.sizes
            places = np.array(list(new.values()), np.int64).reshape(-1, 2)
            flat, sizes = self.merge(raw, places[:, 0], places[:, 1])
            self._keep(np.fromiter(new, U, len(new)), flat, sizes)
        ids, counts = [], []
        for distinct, inverse, per_text in pieces:
            entry = np.searchsorted(self.known, distinct)[inverse]
            sizes = self.sizes[entry]
            ids.append(self.flat[spans(self.first[entry], sizes)])
            ends = np.append(0, np.cumsum(sizes))
            counts.append(np.diff(ends[np.append(0, np.cumsum(per_text))]))
        ends = np.zeros(n + 1, np.int32)
        if counts:
            np.cumsum(np.concatenate(counts), out=ends[1:])
        return pa.ListArray.from_arrays(ends, np.concatenate(ids) if ids else np.zeros(0, np.int32))

    def _keep(self, hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Add encoded words to the known ones, which are sorted by hash."""
        known, all_sizes = np.append(self.known, hashes), np.append(self.sizes, sizes)
        first = np.append(self.first, len(self.flat) + np.cumsum(sizes) - sizes)
        flat = np.append(self.flat, flat)
        order = np.argsort(known)
        self.known, self.sizes, self.first, self.flat = known[order], all_sizes[order], first[order], flat

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each row's ids; bytes that are not UTF-8 become U+FFFD; a null row is the empty text."""
        ends = np.append(0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        tokens = ids.flatten().to_numpy(zero_copy_only=False)
        out, at, n = [], 0, len(ids)
        while at < n:
            stop = min(n, max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1))
            own = tokens[ends[at] : ends[stop]]
            sizes = self.token_sizes[own]
            data = self.token_bytes[spans(self.token_first[own], sizes)]
            edges = np.append(0, np.cumsum(sizes))[ends[at : stop + 1] - ends[at]].astype(np.int64)
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), stop - at, [None, pa.py_buffer(edges), pa.py_buffer(data)])
            try:
                out.append(binary.cast(pa.large_string()).cast(pa.string()))
            except pa.ArrowInvalid:
                out.append(pa.array([x.as_py().decode("utf-8", "replace") for x in binary], pa.string()))
            at = stop
        return pa.concat_arrays(out) if out else pa.array([], pa.string())


_encoders: dict[int, PairIndexBPE] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encoder(spec) -> PairIndexBPE:
    key = hash(spec.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PairIndexBPE(spec.value)
    return _encoders[key]


def _with(batch: pa.RecordBatch, keep: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *more.values()], [*keep, *more])


def _passed(df: DataFrame, names: tuple[str, ...], *without: str) -> list[str]:
    return [c for c in df.columns if c.lower() not in {n.lower() for n in (*names, *without)}]


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (array of int): the BPE ids of every whole text; the text column is kept."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    keep = _passed(docs, (ids,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec)
        for batch in batches:
            yield _with(batch, keep, {ids: encoder.encode(batch.column(text))})

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return docs.select(*keep).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", vocabulary: str | None = None, out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the text of ``ids``; bytes that are not UTF-8 become U+FFFD; null ids give the empty text."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    keep = _passed(df, (out,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec)
        for batch in batches:
            yield _with(batch, keep, {out: encoder.decode(batch.column(ids))})

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.StringType())])
    return df.select(*keep).mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids, decoded of every whole text: ``encode``, then ``decode`` of its ids, in one pass."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec)
        for batch in batches:
            ids = encoder.encode(batch.column("text"))
            yield _with(batch, ["doc_id"], {"ids": ids, "decoded": encoder.decode(ids)})

    of = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {of}, ids array<int>, decoded string")


def digests(trip: DataFrame, *more: str) -> DataFrame:
    """Of each document the ids' count and digests, and the columns ``more``."""
    return trip.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *more,
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with its token ids, their count and digests."""
    return digests(round_trip(docs), "ids")

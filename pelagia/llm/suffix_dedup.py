"""Suffix-array dedup of bytes by prefix-free parsing.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (smaller doc_id, or the same document, earlier) is removed.

Prefix-free parsing: a phrase ends where the rolling hash of ``TRIGGER`` bytes is 0 modulo ``MODULUS``, and the next begins with
those bytes, so phrases depend on content alone and none is a prefix of another. The work is cut by phrases:

1. Every string has an anchor, the unit (the fewest phrases in a row that have ``UNIT`` bytes) of least hash that lies in it, or the
   string itself where none does. Consecutive strings with
   one anchor occurrence are a run, of about 25. Equal strings have equal anchors at equal offsets, so the strings of a run all differ,
   and a run whose anchor occurs once in the corpus repeats nothing. Blocks of documents ask for their distinct anchors (``_blocks``).
2. Runs of recurring anchors are told apart by their whole content. All but the first with one content are repeats, and where an
   anchor has one content only, that is all. Most copies end here, as hashes of content spread over the cluster.
3. The first runs of anchors with several contents go by their anchor to tasks that build the order of the corpus among them: the
   distinct phrases (the dictionary) and the sequence of phrases (the parse) get suffix arrays of their own, and a suffix of
   the text is ordered by its phrase's suffix in the dictionary and then by the parse that follows. Neighbours in that order that share
   ``LENGTH`` bytes (compared byte by byte) are equal strings, of which the first in the corpus stays.

An anchor with more than ``GROUP`` contents is dealt to several tasks by content; the strings that are first in their task meet again
by hash. Texts lie in a bucketed table of blocks, so the joins with what a block is answered do not move them.

Defined results: a null text is empty; texts under ``LENGTH`` bytes lose nothing; repeated rows (doc_id and text equal) are one place in
the corpus and do not repeat each other; rows of one doc_id with different texts are ordered by the texts' hashes; a null doc_id is the
largest; only doc_id and text are read, so other columns cannot clash. Anchors only choose what is compared; runs' contents
and strings that meet across tasks are compared by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pelagia.llm import _blocks as blocks
from pelagia.llm import keys
from pelagia.llm._text import U, buffers, inverse_powers, mix, powers, signed, slices, spans
from pelagia.session import scratch, table, written

LENGTH, TRIGGER, MODULUS = 100, 8, 8
UNIT = 32
GROUP = 512
#: Bytes of texts that a worker looks at together: a block, and what is compared.
BLOCK, COMPARED = 1_000_000, 1_500_000
PLACE_BITS = 28


class Parse:
    """Triggers of a slice of texts (raw, offsets); first byte ``start`` and last byte + 1 ``end`` of each unit of phrases of one text;
    and polynomial sums for the hash of any range of bytes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(raw.astype(U) * powers(n), out=self.sums[1:])
        self.down = inverse_powers(n + 1)
        if n < TRIGGER:
            self.triggers = np.zeros(0, np.int64)
        else:
            roll = (self.sums[TRIGGER:] - self.sums[:-TRIGGER]) * self.down[: n - TRIGGER + 1]
            roll ^= roll >> U(32)
            roll *= U(0xD6E8FEB86659FD93)
            roll ^= roll >> U(29)
            at = np.flatnonzero(roll % U(MODULUS) == 0)
            self.triggers = at[at + TRIGGER <= offsets[np.searchsorted(offsets, at, "right")]]
        # units: the fewest whole phrases from a trigger on that have UNIT bytes
        to = np.searchsorted(self.triggers, self.triggers + max(1, UNIT - TRIGGER))
        whole = np.flatnonzero(to < len(self.triggers))
        text = np.searchsorted(offsets, self.triggers, "right")
        whole = whole[text[whole] == text[to[whole]]]
        self.start, self.end = self.triggers[whole], self.triggers[to[whole]] + TRIGGER

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U) * U(0xA24BAED4963EE407))


class Runs:
    """Runs of a slice of texts: text, first (the first string's byte in the slice), count (strings), anchor and content (hashes)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
        self.parse = parse = Parse(raw, offsets)
        n = len(raw)
        stop = offsets[1:] - length + 1  # of each text's strings
        having = np.flatnonzero(stop > offsets[:-1])
        hashes = parse.hash(parse.start, parse.end)
        keyed = hashes & ~U((1 << PLACE_BITS) - 1) | np.arange(len(hashes), dtype=U)
        # the phrases in the string at p are those with start >= p and end <= p + length: both bounds move at marks only
        marks = np.zeros(n + 1, bool)
        marks[parse.start + 1] = True
        enters = parse.end - length
        marks[enters[enters >= 0]] = True
        allowed = np.zeros(n + 1, np.int32)
        allowed[offsets[having]] += 1
        allowed[stop[having]] -= 1
        marks &= np.cumsum(allowed, dtype=np.int32) > 0
        marks[offsets[having]] = True
        begin = np.flatnonzero(marks)
        text = np.searchsorted(offsets, begin, "right") - 1
        until = np.minimum(np.append(begin[1:], n), stop[text])
        low = np.searchsorted(parse.start, begin)
        high = np.searchsorted(parse.end, begin + length, "right")
        bare = high <= low
        place = self._least(keyed, low[~bare], high[~bare])
        # a run for every anchor occurrence
        b, u, t = begin[~bare], until[~bare], text[~bare]
        fresh = np.append(True, (place[1:] != place[:-1]) | (t[1:] != t[:-1]) | (u[:-1] != b[1:])) if len(b) else np.zeros(0, bool)
        at = np.flatnonzero(fresh)
        last = np.append(at[1:], len(b)) - 1
        first, count = b[at], u[last] - b[at] if len(b) else b[at]
        anchor = hashes[place[at]]
        # and one for every string without a phrase
        alone = spans(begin[bare], until[bare] - begin[bare])
        self.first = np.append(first, alone)
        self.count = np.append(count, np.ones(len(alone), np.int64))
        self.content = parse.hash(self.first, self.first + self.count - 1 + length)
        self.anchor = np.append(anchor, self.content[len(first) :] ^ U(0x9E3779B97F4A7C15))
        self.text = np.append(t[at], np.repeat(text[bare], until[bare] - begin[bare]))

    @staticmethod
    def _least(keyed: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Index of the least hash in keyed[low:high], the leftmost of equal ones, by a table of minima over powers of two."""
        size = high - low
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.zeros(len(low), U)
        minima, k = keyed, 0
        for k in range(int(level.max(initial=-1)) + 1):
            own = level == k
            out[own] = np.minimum(minima[low[own]], minima[high[own] - (1 << k)])
            if len(minima) > 1 << k:
                minima = np.minimum(minima[: -(1 << k)], minima[1 << k :])
        return (out & U((1 << PLACE_BITS) - 1)).astype(np.int64)


def _made(docs: DataFrame, n: int) -> DataFrame:
    """The bucketed table of blocks: b, d, h (a slice's documents, equal ones once), times (how often), sizes and raw (their texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = blocks.block_ids()
        for batch in batches:
            for part in slices(batch, limit=BLOCK):
                d, h = (part.column(c).to_numpy() for c in ("_d", "_h"))
                order = np.lexsort((h, d))
                fresh = np.flatnonzero(np.append(True, (d[order][1:] != d[order][:-1]) | (h[order][1:] != h[order][:-1])))
                times = np.diff(np.append(fresh, len(order)))
                part = part.take(pa.array(order[fresh]))
                raw, offsets = buffers(part.column("text"))
                one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                arrays = [pa.array([next(names)], pa.int64()), one(part.column("_d")), one(part.column("_h")), one(pa.array(times)), pa.array([blocks.pack(np.diff(offsets))], pa.binary()), pa.array([blocks.pack(raw)], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["b", "d", "h", "times", "sizes", "raw"])

    spark, name = docs.sparkSession, f"blocks_{uuid.uuid4().hex}"
    found = keys.rows(docs).mapInArrow(run, "b long, d array<long>, h array<long>, times array<long>, sizes binary, raw binary")
    found.repartition(n, "b").write.format("parquet").bucketBy(n, "b").option("path", scratch(spark)).saveAsTable(name)
    return spark.table(name)


class Block:
    """A row of the blocks' table."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.b = batch.column("b")[i].as_py()
        self.offsets = np.append(0, np.cumsum(blocks.unpack(batch.column("sizes")[i].as_py(), np.int64)))
        self.raw = blocks.unpack(batch.column("raw")[i].as_py(), np.uint8)
        self.d, self.h = (np.array(batch.column(c)[i].values.to_numpy(zero_copy_only=False)) for c in "dh")

    def ranks(self) -> np.ndarray:
        """The order of the documents by (d, h), equal for equal ones."""
        order = np.lexsort((self.h, self.d))
        d, h = self.d[order], self.h[order]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(np.append(False, (d[1:] != d[:-1]) | (h[1:] != h[:-1])))
        return out


def _runs(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, Block, Runs]]:
    for i in range(batch.num_rows):
        block = Block(batch, i)
        yield i, block, Runs(block.raw, block.offsets, length)


def _replied(batch: pa.RecordBatch, i: int, column: str, wanted: np.ndarray, n: int) -> np.ndarray:
    """The flags of a block's distinct keys."""
    given = {r["p"]: r["flags"] for r in batch.column(column)[i].as_py() or ()}
    out = np.zeros(len(wanted), np.uint8)
    for p, at in blocks.in_parts(blocks.part(wanted, n), n):
        out[at] = blocks.unpack(given[p], np.uint8)
    return out


def _asked_anchors(made: DataFrame, n: int, length: int) -> DataFrame:
    """Distinct anchors of each block with their least and largest content, and whether several runs have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block, runs in _runs(batch, length):
                order = np.argsort(runs.anchor, kind="stable")
                anchor, content = runs.anchor[order], runs.content[order]
                if not len(anchor):
                    continue
                at = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
                least, most = np.minimum.reduceat(content, at), np.maximum.reduceat(content, at)
                several = np.diff(np.append(at, len(anchor))) > 1
                own = anchor[at]
                out = [(p, blocks.pack(np.concatenate((own[k], least[k], least[k] ^ most[k], several[k].astype(U))))) for p, k in blocks.in_parts(blocks.part(own, n), n)]
                p, packed = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([block.b] * len(p), pa.int64()), pa.array(p, pa.int32()), pa.array(packed, pa.binary())], ["b", "p", "asked"])

    return made.select("b", "d", "h", "sizes", "raw").mapInArrow(run, "b long, p int, asked binary")


def _replies(asked: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    packed = [blocks.pack(x) for x in np.split(flags.astype(np.uint8), np.cumsum(sizes)[:-1])]
    return pa.table({"b": asked.column("b"), "p": asked.column("p"), "flags": pa.array(packed, pa.binary())})


def _recurring(asked: pa.Table) -> pa.Table:
    """For each asked anchor: 1 if it recurs, 3 if it recurs with several contents."""
    found = [blocks.unpack(x, U).reshape(4, -1) for x in asked.column("asked").to_pylist()]
    anchor, least, most, several = np.concatenate(found, axis=1)
    most = least ^ most
    _, place, times = np.unique(anchor, return_inverse=True, return_counts=True)
    order = np.argsort(place, kind="stable")
    at = np.cumsum(times) - times
    low, high = np.minimum.reduceat(least[order], at), np.maximum.reduceat(most[order], at)
    recurs = (times > 1) | (np.maximum.reduceat(several[order], at) > 0)
    return _replies(asked, (recurs.astype(np.uint8) * (1 + 2 * (low != high)))[place], [x.shape[1] for x in found])


def _first(asked: pa.Table) -> pa.Table:
    """For each asked content: 1 if an earlier block's place has it, by (d, h, byte)."""
    found = [blocks.unpack(x, np.int64).reshape(4, -1) for x in asked.column("asked").to_pylist()]
    content, d, h, s = np.concatenate(found, axis=1)
    order = np.lexsort((s, h, d, content))
    fresh = np.append(True, content[order][1:] != content[order][:-1])
    lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    later = (d[order] != d[lead]) | (h[order] != h[lead]) | (s[order] != s[lead])
    flags = np.empty(len(order), np.uint8)
    flags[order] = later
    return _replies(asked, flags, [x.shape[1] for x in found])


class Recurring:
    """A block's runs whose anchor recurs: of each its document's rank and byte, and the first of each distinct content."""

    def __init__(self, batch: pa.RecordBatch, i: int, block: Block, runs: Runs, n: int):
        anchors, place = np.unique(runs.anchor, return_inverse=True)
        flags = _replied(batch, i, "anchors", anchors, n)[place]
        own = np.flatnonzero(flags)
        self.flags, self.text, self.anchor, self.content, self.count = flags[own], runs.text[own], runs.anchor[own], runs.content[own], runs.count[own]
        self.first, self.at = runs.first[own], runs.first[own] - block.offsets[runs.text[own]]
        order = block.ranks()[self.text] << 32 | self.at
        by = np.lexsort((order, self.content))
        fresh = np.flatnonzero(np.append(True, self.content[by][1:] != self.content[by][:-1])) if len(by) else np.zeros(0, np.int64)
        self.lead = by[fresh]
        self.contents = self.content[self.lead]
        self.which = np.searchsorted(self.contents, self.content)
        self.later = order > order[self.lead][self.which] if len(by) else np.zeros(0, bool)


def _asked_contents(joined: DataFrame, n: int, length: int) -> DataFrame:
    """Distinct contents of each block's recurring runs, with the place of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block, runs in _runs(batch, length):
                r = Recurring(batch, i, block, runs, n)
                if not len(r.lead):
                    continue
                text, at = r.text[r.lead], r.at[r.lead]
                rows = np.stack((signed(r.contents), block.d[text], block.h[text], at))
                p, packed = zip(*((p, blocks.pack(rows[:, k])) for p, k in blocks.in_parts(blocks.part(r.contents, n), n)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([block.b] * len(p), pa.int64()), pa.array(p, pa.int32()), pa.array(packed, pa.binary())], ["b", "p", "asked"])

    return joined.mapInArrow(run, "b long, p int, asked binary")


def _merged(text: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rows (text, first, strings) of the runs given, neighbours joined."""
    order = np.lexsort((at, text))
    text, at, end = text[order], at[order], (at + count)[order]
    fresh = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (at[1:] != end[:-1]))) if len(text) else np.zeros(0, np.int64)
    last = np.append(fresh[1:], len(text)) - 1 if len(text) else fresh
    return np.stack((text[fresh], at[fresh], end[last] - at[fresh]))


def _settled(joined: DataFrame, n: int, length: int) -> DataFrame:
    """Rows (b, gone): the repeats of each block that contents show; and rows (b, i, d, h, s, a, text): the first runs of anchors
    with several contents, to be compared."""
    names = ["b", "gone", "i", "d", "h", "s", "a", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block, runs in _runs(batch, length):
                r = Recurring(batch, i, block, runs, n)
                elsewhere = _replied(batch, i, "contents", r.contents, n).astype(bool)
                gone = r.later | elsewhere[r.which] if len(r.which) else r.later
                rows = _merged(r.text[gone], r.at[gone], r.count[gone])
                yield pa.RecordBatch.from_arrays([pa.array([block.b], pa.int64()), pa.array([blocks.pack(rows)], pa.binary()), *(pa.nulls(1, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names)
                k = r.lead[~elsewhere] if len(r.lead) else r.lead
                k = k[r.flags[k] == 3]
                if not len(k):
                    continue
                sizes = r.count[k] - 1 + length
                ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
                texts = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(ends), pa.py_buffer(block.raw[spans(r.first[k], sizes)])])
                t = r.text[k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block.b)), pa.nulls(len(k), pa.binary()), pa.array(t.astype(np.int32)), pa.array(block.d[t]), pa.array(block.h[t]), pa.array(r.at[k].astype(np.int32)), pa.array(signed(r.anchor[k])), texts], names)

    return written(joined.mapInArrow(run, "b long, gone binary, i int, d long, h long, s int, a long, text binary"))


def _ranks(values: np.ndarray, bits: int) -> np.ndarray:
    """Places of all suffixes of ``values`` (of ``bits`` bits each) in their order, equal for equal ones; a 0 ends its suffix. The first
    entries, as many as fit into 63 bits, are sorted at once; then what is known is doubled, for suffixes that go on only."""
    n, have = len(values), 63 // bits
    left = np.minimum.accumulate(np.where(values == 0, np.arange(n), n)[::-1])[::-1] - np.arange(n)  # entries up to the next 0
    packed = np.zeros(n, np.int64)
    for k in range(have):
        packed <<= bits
        packed[: max(0, n - k)] |= np.where(left[: max(0, n - k)] > k, values[k:], 0)
    order = np.argsort(packed, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.append(True, packed[order][1:] != packed[order][:-1]), np.arange(n), 0)) if n else order
    at = np.flatnonzero(left >= have)
    while len(at):
        key = rank[at] * np.int64(n + 1) + rank[np.minimum(at + have, n - 1)]
        order = np.argsort(key)
        at, key = at[order], key[order]
        own, here = rank[at], np.arange(len(at))
        group = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), here, 0))
        equal = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), here, 0))
        rank[at] = own + equal - group
        have *= 2
        at = at[left[at] >= have]
    return rank


def corpus_order(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The strings of all texts in the order of their suffixes, as bytes in ``raw``, and whether each equals the one before.

    Each text's phrases run from its start or a trigger to the end of the next trigger or its end. The dictionary holds the distinct
    ones, each followed by a 0; the parse holds their ranks, each text followed by a 0."""
    parse = Parse(raw, offsets)
    texts = len(offsets) - 1
    start = np.union1d(offsets[:-1][np.diff(offsets) > 0], parse.triggers)
    text = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(raw)) + TRIGGER, offsets[text + 1])
    # a trigger at a text's very start ends the empty phrase before it
    distinct, where, phrase = np.unique(parse.hash(start, end), return_index=True, return_inverse=True)
    size = (end - start)[where]
    first = np.cumsum(size + 1) - (size + 1)
    dictionary = np.zeros(int((size + 1).sum()), np.int64)
    dictionary[spans(first, size)] = raw[spans(start[where], size)].astype(np.int64) + 1
    suffix = _ranks(dictionary, 9)
    phrase_rank = np.unique(suffix[first], return_inverse=True)[1] + 1
    # the parse: phrases of each text, then 0
    place = np.arange(len(start)) + text
    sequence = np.zeros(len(start) + texts + 1, np.int64)
    sequence[place] = phrase_rank[phrase]
    follow = _ranks(sequence, max(1, len(first).bit_length()))
    # strings: where their suffix starts in its phrase, and what follows the phrase
    stop = np.maximum(offsets[1:] - length + 1, offsets[:-1])
    at = spans(offsets[:-1], stop - offsets[:-1])
    own = np.searchsorted(start, at, "right") - 1
    order = np.argsort(suffix[first[phrase[own]] + at - start[own]] * np.int64(len(sequence) + 1) + follow[place[own] + 1])
    at = at[order]
    # neighbours that share all bytes
    padded = np.append(raw, np.zeros(8, np.uint8))
    words = np.zeros(len(raw), U)
    for k in range(8):
        words = words << U(8) | padded[k : k + len(raw)].astype(U)
    equal = np.zeros(len(at), bool)
    equal[1:] = True
    for k in [*range(0, length - 7, 8), length - 8] if length >= 8 else []:
        live = np.flatnonzero(equal)
        equal[live] = words[at[live] + k] == words[at[live - 1] + k]
    for k in range(length) if length < 8 else []:
        live = np.flatnonzero(equal)
        equal[live] = raw[at[live] + k] == raw[at[live - 1] + k]
    return at, equal


def _compared(found: DataFrame, length: int, group: int, limit: int = COMPARED) -> DataFrame:
    """Rows (b, i, s, n, w, d, h) of the runs ``found``: strings s .. s + n - 1 of document i of block b that an earlier run of the
    same task has (w null), or one string that is the first of its task, by its hash w, where an anchor has several tasks."""
    names = ["b", "i", "s", "n", "w", "d", "h"]

    def settle(part: pa.Table) -> Iterator[pa.RecordBatch]:
        column = lambda c: part.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        texts = pa.concat_arrays(part.column("text").chunks).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        b, i, d, h, s, tasks = (column(c) for c in ("b", "i", "d", "h", "s", "tasks"))
        at, equal = corpus_order(raw, offsets, length)
        text = np.searchsorted(offsets, at, "right") - 1
        by = np.lexsort((h, d))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(np.append(False, (d[by][1:] != d[by][:-1]) | (h[by][1:] != h[by][:-1])))
        byte = s[text] + at - offsets[text]
        order = rank[text] << 32 | byte
        head = np.flatnonzero(~equal)
        of = np.cumsum(~equal) - 1
        later = order > np.minimum.reduceat(order, head)[of]
        rows = _merged(text[later], byte[later], np.ones(int(later.sum()), np.int64))
        t = rows[0]
        yield pa.RecordBatch.from_arrays([pa.array(b[t]), pa.array(i[t]), pa.array(rows[1].astype(np.int32)), pa.array(rows[2].astype(np.int32)), pa.nulls(len(t), pa.int64()), pa.array(d[t]), pa.array(h[t])], names)
        kept = np.flatnonzero(~later & (tasks[text] > 1))
        t = text[kept]
        hashes = Parse(raw, offsets).hash(at[kept], at[kept] + length)
        yield pa.RecordBatch.from_arrays([pa.array(b[t]), pa.array(i[t]), pa.array(byte[kept].astype(np.int32)), pa.array(np.ones(len(t), np.int32)), pa.array(signed(hashes)), pa.array(d[t]), pa.array(h[t])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, 1000)
                at += piece.num_rows
                held.append(piece)
                size += piece.column("text").nbytes
                if size < limit:
                    continue
                whole = pa.Table.from_batches(held)
                a, z = (whole.column(c).to_numpy() for c in ("a", "z"))
                edges = np.flatnonzero((a[1:] != a[:-1]) | (z[1:] != z[:-1]))
                if len(edges):  # the last group may go on
                    cut = int(edges[-1]) + 1
                    yield from settle(whole.slice(0, cut))
                    held = whole.slice(cut).to_batches()
                    size = sum(x.column("text").nbytes for x in held)
        if held:
            yield from settle(pa.Table.from_batches(held))

    tasks = written(found.groupBy("a").agg(F.count(F.lit(1)).alias("n"))).select("a", F.expr(f"cast((n - 1) div {group} as int) + 1").alias("tasks"))
    dealt = found.join(tasks, "a").withColumn("z", F.pmod(F.xxhash64("text"), F.col("tasks")).cast("int"))
    dealt = dealt.select("a", "z", "b", "i", "d", "h", "s", "tasks", "text").repartition("a", "z").sortWithinPartitions("a", "z")
    return written(dealt.mapInArrow(run, "b long, i int, s int, n int, w long, d long, h long"))


def repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The blocks of ``docs``; (b, gone): packed rows (document, first byte, strings) that repeat earlier ones; and more such rows
    (b, i, s, n)."""
    spark = docs.sparkSession
    n, k = blocks.parts(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = _made(docs, k)
    anchors = blocks.answered(_asked_anchors(made, n, length), _recurring, "b long, p int, flags binary")
    with_anchors = blocks.joined(made, anchors, "flags").withColumnRenamed("replies", "anchors")
    contents = blocks.answered(_asked_contents(with_anchors, n, length), _first, "b long, p int, flags binary")
    with_both = blocks.joined(with_anchors, contents, "flags").withColumnRenamed("replies", "contents")
    settled = _settled(with_both, n, length)
    compared = _compared(settled.where("gone is null").drop("gone"), length, group)
    met = compared.where("w is not null")
    lead = written(met.groupBy("w").agg(F.min(F.struct("d", "h", "s")).alias("k")))
    later = met.join(lead, "w").where(F.struct("d", "h", "s") > F.col("k"))
    more = written(compared.where("w is null").select("b", "i", "s", "n").unionByName(later.select("b", "i", "s", "n")))
    return made, settled.where("gone is not null").select("b", "gone"), more


def dedup(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes [first, last)) and kept (the bytes left) of every document."""
    made, gone, more = repeats(docs, length, group)
    more = more.groupBy("b").agg(F.collect_list(F.struct("i", "s", "n")).alias("more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i)
                rows = blocks.unpack(batch.column("gone")[i].as_py(), np.int64).reshape(3, -1)
                listed = batch.column("more")[i].values
                if listed is not None and len(listed):
                    rows = np.concatenate((rows, np.stack([listed.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "isn"])), axis=1)
                total = len(block.raw)
                first = block.offsets[rows[0]] + rows[1]
                marks = np.bincount(first, minlength=total + 1) - np.bincount(first + rows[2] - 1 + length, minlength=total + 1)
                away = np.cumsum(marks[:total]) > 0
                texts = len(block.d)
                edge = np.zeros(total + 1, bool)
                edge[block.offsets] = True
                begin = np.flatnonzero(away & (edge[:total] | ~np.append(False, away[:-1]))) if total else np.zeros(0, np.int64)
                end = np.flatnonzero(away & (edge[1:] | ~np.append(away[1:], False))) + 1 if total else begin
                own = np.searchsorted(block.offsets, begin, "right") - 1
                per = np.append(0, np.cumsum(np.bincount(own, minlength=texts))).astype(np.int32)
                fields = [pa.array((x - block.offsets[own]).astype(np.int32)) for x in (begin, end)]
                spanned = pa.ListArray.from_arrays(per, pa.StructArray.from_arrays(fields, ["first", "last"]))
                upto = np.append(0, np.cumsum(~away))[block.offsets]
                kept = pa.Array.from_buffers(pa.binary(), texts, [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(block.raw[~away])])
                sizes = np.diff(block.offsets)
                out = pa.RecordBatch.from_arrays([pa.array(block.d), pa.array(sizes), pa.array(sizes - np.diff(upto)), spanned, kept], ["_d", "n_bytes", "n_removed", "spans", "kept"])
                times = batch.column("times")[i].values.to_numpy(zero_copy_only=False)
                yield out if (times == 1).all() else out.take(pa.array(np.repeat(np.arange(texts), times)))

    found = made.join(gone, "b").join(more, "b", "left")
    found = found.mapInArrow(run, "_d long, n_bytes long, n_removed long, spans array<struct<first:int,last:int>>, kept binary")
    return found.select(keys.doc_id(F.col("_d")).alias("doc_id"), "n_bytes", "n_removed", "spans", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

"""N-gram Jaccard join by PartEnum signatures.

A text's set holds its distinct ``SHINGLE``-word shingles (64-bit hashes); two sets link when their Jaccard similarity is
at least 0.8. Equal sets are one node from the start. Sets are put in size bands; the feature domain of a band is
partitioned by hash, and a signature is a partition's number with all of the set's elements in it.

Why no link is lost: similar sets of sizes a <= b <= a / 0.8 differ in at most k = (a + b) / 9 elements, which touch at
most k partitions. Let j be the first partition, in a fixed order, that no difference touches and that is not empty. All
non-empty partitions before j are touched, k at most, so j is among the first k + 1 non-empty partitions of both sets,
and there both have the same elements. A set of m elements therefore emits the signatures of its first m // 4 + 1
non-empty partitions (k <= m / 4), in its own band and, where a partner may lie in the next band, in that one. Small
bands have a partition for every element; larger ones have ``SPREAD`` times k + 1 partitions, so that k + 1 are filled.

Frequent shingles (boilerplate) come in the last partitions of the order, so a signature is of frequent shingles only
where a set has little else. Which hash cells are frequent is counted over all documents; the bit map of cells that is
broadcast has a fixed size (``CELLS`` bits), and any map gives the same links.

A signature's members are compared with one of them, the one that meets the most others over all its signatures,
not with each other: a group of copies costs a comparison
for each member. Members whose components then still differ are compared in pairs; those of a signature's largest component meet
only the members outside it. What stays quadratic is the number of members of one signature that lie outside its largest
component. A pair whose sizes exclude a link is
dropped, and so is one whose histograms do: each set has counts of its elements in ``HISTOGRAM`` hash cells, and sets
differ in at least the sum of the counts' differences. What is left is compared exactly, on whole texts. Components follow.

A signature can be hot, that is shared by one set in ``FREQUENT`` or more, only if its elements are frequent. Signatures of frequent elements are therefore
dealt by (signature, salt), all others by the signature alone; sums over the salts are joined back to both.

Defined results: a null or wordless text has an empty set, links with nothing and is its own component; under five
words the whole sequence is the one shingle; repeated rows share a component; a null doc_id counts as larger than any
and its component_id is null where it is alone; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pelagia.llm import keys
from pelagia.llm._text import U, Words, inverse_powers, mix, powers, signed, slices, spans
from pelagia.llm.components import components
from pelagia.session import table, written

SHINGLE = 5
CELLS = 1 << 20
#: A cell is frequent if tasks where it stands out see it, together, for one in so many documents, and so often at least.
FREQUENT, FREQUENT_AT_LEAST = 2000, 24
SMALL, SPREAD = 128, 1.5
#: Cells of a set's histogram.
HISTOGRAM = 256
#: Members of a signature that are compared in one group of pairs, about.
BLOCK = 256
#: Tasks over which the members of a signature of frequent elements are dealt.
SALTS = 32


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and the texts' offsets into them."""
    words = Words(column, lower=True)
    counts, n = words.counts, len(words.starts)
    sums = np.zeros(n + 1, U)
    np.cumsum(words.hashes * powers(n), out=sums[1:])
    size = np.clip(counts, 0, SHINGLE)
    shingles = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    text = np.repeat(np.arange(len(counts)), shingles)
    start = words.first[text] + np.arange(len(text)) - (np.cumsum(shingles) - shingles)[text]
    end = start + size[text]
    h = mix((sums[end] - sums[start]) * inverse_powers(n + 1)[start] + size[text].astype(U))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    once = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])) if len(h) else np.zeros(0, bool)
    h, text = h[once], text[once]
    return h, np.searchsorted(text, np.arange(len(counts) + 1))


def set_hashes(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash of each set, from its size and its elements in any order; 0 for an empty set."""
    size = np.diff(offsets)
    a = np.append(U(0), np.cumsum(mix(h ^ U(0x5851F42D4C957F2D))))
    return np.where(size > 0, mix(a[offsets[1:]] - a[offsets[:-1]] + size.astype(U)), U(0))


def band(size: np.ndarray) -> np.ndarray:
    """Band b holds the sizes from 2**b to 2**(b+1) - 1."""
    return np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)


def partitions(b: np.ndarray) -> np.ndarray:
    """Partitions of a band's domain; 0: one for every element."""
    top = 2 ** (b + 1) - 1
    return np.where(top < SMALL, 0, (SPREAD * (top // 4 + 1)).astype(np.int64))


def signatures(h: np.ndarray, offsets: np.ndarray, frequent: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set, whether of frequent elements) of the sets that ``use`` marks. frequent: a flag for each cell."""
    size = np.diff(offsets)
    own = band(size)
    nexts = size * 5 >= 2 ** (own + 1) * 4  # 1.25 * size reaches the next band
    out_s, out_o, out_late = [], [], []
    rare_last = frequent[(h >> U(44)).astype(np.int64)] if len(h) else np.zeros(0, bool)
    text = np.repeat(np.arange(len(size)), size)
    for step in (0, 1):
        chosen = use & (size > 0) & (nexts if step else True)
        mine = chosen[text]
        e, t, late = h[mine], text[mine], rare_last[mine]
        if not len(e):
            continue
        b = own[t] + step
        parts = partitions(b)
        # the order of partitions: first those of rare elements, then those of frequent ones
        hashed = mix(e + (b.astype(U) + U(1)) * U(0x2545F4914F6CDD1D))
        part = np.where(parts > 0, hashed % np.maximum(parts, 1).astype(U), hashed >> U(1)) | (late.astype(U) << U(63))
        order = np.lexsort((part, t))
        e, t, part, b = e[order], t[order], part[order], b[order]
        fresh = np.append(True, (t[1:] != t[:-1]) | (part[1:] != part[:-1]))
        begin = np.flatnonzero(fresh)
        sums = np.append(U(0), np.cumsum(mix(e)))
        end = np.append(begin[1:], len(e))
        sig = mix(mix(sums[end] - sums[begin]) ^ mix(part[begin] + b[begin].astype(U) * U(0x9FB21C651E98DF25)) + (end - begin).astype(U))
        t = t[begin]
        rank = np.arange(len(t)) - np.searchsorted(t, t)
        keep = rank <= size[t] // 4
        out_s.append(sig[keep])
        out_o.append(t[keep])
        out_late.append(late[order][begin][keep])
    if not out_s:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(out_s), np.concatenate(out_o), np.concatenate(out_late)


def histograms(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[set, cell]: how many elements fall in each cell, 255 at most."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(text * HISTOGRAM + (mix(h) >> U(56)).astype(np.int64), minlength=n * HISTOGRAM)
    return np.minimum(counts, 255).astype(np.uint8).reshape(n, HISTOGRAM)


def _blobs(table: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(table.shape[1]), len(table), [None, pa.py_buffer(np.ascontiguousarray(table))]).cast(pa.binary())


def _sets(docs: DataFrame) -> DataFrame:
    """_d, _h, n (set size), g (set hash), hist of every document, and (cell, n) rows, with null _d, of the cells that stand out in a task."""
    names = ["_d", "_h", "n", "g", "hist", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for part in slices(batch):
                h, offsets = shingle_sets(part.column("text"))
                seen += np.bincount((h >> U(44)).astype(np.int64), minlength=CELLS).astype(np.uint32)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("_d"), part.column("_h"), pa.array(np.diff(offsets)), pa.array(signed(set_hashes(h, offsets))), _blobs(histograms(h, offsets)), pa.nulls(n, pa.int32())], names)
        # a few thousand cells stand out by chance in a task; their sums stay small
        mean = seen.mean()
        cells = np.flatnonzero(seen >= max(2, np.ceil(mean + 3 * np.sqrt(mean)))).astype(np.int32)
        empty = pa.nulls(len(cells), pa.int64())
        yield pa.RecordBatch.from_arrays([empty, empty, pa.array(seen[cells].astype(np.int64)), empty, pa.nulls(len(cells), pa.binary()), pa.array(cells)], names)

    return docs.mapInArrow(run, "_d long, _h long, n long, g long, hist binary, cell int")


def _may_link(pairs: DataFrame) -> DataFrame:
    """x, y of the pairs (x, y, nx, ny, hx, hy) whose histograms do not exclude a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hx, hy = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HISTOGRAM).astype(np.int16) for c in ("hx", "hy"))
                sizes = batch.column("nx").to_numpy().astype(np.int64) + batch.column("ny").to_numpy()
                batch = batch.filter(pa.array(9 * np.abs(hx - hy).sum(1) <= sizes))
            yield batch.select(["x", "y"])

    return pairs.mapInArrow(run, "x long, y long")


def _signed_sets(docs: DataFrame, cells: np.ndarray) -> DataFrame:
    """s (signature), salt (0, or 1 to SALTS where the signature is of frequent elements), g (set), n (its size); a set that a
    task has met before is not signed again."""
    bits = np.zeros(CELLS, bool)
    bits[cells] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, met = np.unpackbits(shared.value).astype(bool), np.zeros(0, U)
        for batch in batches:
            for part in slices(batch):
                h, offsets = shingle_sets(part.column("text"))
                g, size = set_hashes(h, offsets), np.diff(offsets)
                distinct, first = np.unique(g, return_index=True)
                use = np.zeros(len(g), bool)
                use[first[~np.isin(distinct, met, assume_unique=True)]] = True
                met = np.union1d(met, distinct)
                s, own, late = signatures(h, offsets, frequent, use)
                salt = np.where(late, (mix(g[own]) % U(SALTS)).astype(np.int32) + 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(signed(s)), pa.array(salt), pa.array(signed(g[own])), pa.array(size[own].astype(np.int32))], ["s", "salt", "g", "n"])

    return docs.select("text").mapInArrow(run, "s long, salt int, g long, n int")


def _pairs_within(members: DataFrame) -> DataFrame:
    """x, y of the pairs of one signature's members (s, g, n, root, hist) in different components that sizes and histograms
    let link. A signature's members are dealt to blocks of about ``BLOCK``: first those outside its largest component, then those of
    it, which meet the first only. Each pair of blocks is one task's group, so no group grows and only the pairs that may link
    are made."""
    each = members.groupBy("s", "root").count().groupBy("s").agg(F.max(F.struct("count", "root")).alias("k"), F.sum("count").alias("all"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    sizes = written(each.select("s", F.col("k.root").alias("largest"), blocks(F.col("all") - F.col("k.count")).alias("some"), blocks(F.col("k.count")).alias("more")))
    outside, h = F.col("root") != F.col("largest"), F.xxhash64("g")
    place = F.when(outside, F.pmod(h, F.col("some"))).otherwise(F.col("some") + F.pmod(h, F.col("more"))).cast("int")
    dealt = members.join(sizes, "s").withColumn("b", place)
    # a member meets every block, or every block of the first kind: in the pair (smaller block, larger block)
    met = dealt.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("some") - 1 + F.when(outside, F.col("more")).otherwise(0))))
    met = met.select("s", F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j"), "b", "g", "n", "root", "hist")

    names = ["s", "i", "j", "b", "g", "n", "root"]

    def survivors(rows: pa.Table) -> pa.RecordBatch:
        """Of whole groups, in order of (s, i, j, b)."""
        s, i, j, b, g, n, root = (rows.column(c).to_numpy().astype(np.int64) for c in names)
        hist = np.frombuffer(b"".join(rows.column("hist").to_pylist()), np.uint8).reshape(-1, HISTOGRAM)
        group = np.cumsum(np.append(0, (s[1:] != s[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        end = np.searchsorted(group, group, "right")
        # a row of block i meets the later rows of its group, or all of block j where that is another block
        first = np.searchsorted(group * 2 + (b == j), group * 2 + 1)  # where block j begins in the group
        start = np.where(i == j, np.arange(len(s)) + 1, first)
        count = np.where(b == i, end - start, 0)
        out, at, upto = [np.zeros((0, 2), np.int64)], 0, np.cumsum(count)
        while at < len(s):  # about 200,000 pairs at a time
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 200_000, "right")))
            x, y = np.repeat(np.arange(at, min(stop, len(s))), count[at:stop]), spans(start[at:stop], count[at:stop])
            keep = (root[x] != root[y]) & (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y]))
            x, y = x[keep], y[keep]
            for k in range(0, len(x), 20_000):
                u, v = x[k : k + 20_000], y[k : k + 20_000]
                near = 9 * np.abs(hist[u].astype(np.int16) - hist[v]).sum(1) <= n[u] + n[v]
                u, v = g[u[near]], g[v[near]]
                out.append(np.stack((np.minimum(u, v), np.maximum(u, v)), 1))
            at = stop
        found = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None  # the last group waits for the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            last = np.ones(rows.num_rows, bool)
            for c in ("s", "i", "j"):
                column = rows.column(c).to_numpy()
                last &= column == column[-1]
            cut = int(np.argmax(last))
            if cut:
                yield survivors(rows.slice(0, cut))
            rest = rows.slice(cut)
        if rest is not None:
            yield survivors(rest)

    return met.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j", "b").mapInArrow(run, "x long, y long")


def _links(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (x, y) of sets that link, compared on the texts of the sets' least documents."""
    needed = pairs.select(F.col("x").alias("g")).unionByName(pairs.select(F.col("y").alias("g"))).distinct().join(nodes.select("g", "_d", "_h"), "g")
    texts = written(needed.join(rows, ["_d", "_h"]).dropDuplicates(["g"]).select("g", "text"))
    left = pairs.join(texts.select(F.col("g").alias("x"), F.col("text").alias("tx")), "x")
    both = left.join(texts.select(F.col("g").alias("y"), F.col("text").alias("ty")), "y").select("x", "y", "tx", "ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "tx"):
                y = part.column("ty").dictionary_encode()  # a text that meets many is shingled once
                a, b = shingle_sets(part.column("tx")), shingle_sets(y.dictionary)
                at = y.indices.to_numpy()
                n = part.num_rows
                both = np.zeros(n, np.int64)
                for i in range(n):
                    u, v = a[0][a[1][i] : a[1][i + 1]], b[0][b[1][at[i]] : b[1][at[i] + 1]]
                    if len(u) and len(v):
                        place = np.searchsorted(v, u)
                        place[place == len(v)] = 0
                        both[i] = np.count_nonzero(v[place] == u)
                every = np.diff(a[1]) + np.diff(b[1])[at] - both
                yield part.select(["x", "y"]).filter(pa.array(100 * both >= 80 * every))

    return both.mapInArrow(run, "x long, y long")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, _d, _h (its key), and stays: whether it has the least key of its group."""
    rows = keys.rows(docs)
    every = written(_sets(rows))
    sets = every.where("_d is not null").drop("cell", "hist")
    least_often = max(FREQUENT_AT_LEAST, sets.count() // FREQUENT)
    often = every.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= least_often)
    cells = np.array([r.cell for r in often.select("cell").collect()], np.int64)  # CELLS at most
    # one row for a set: its least document
    nodes = every.where("n > 0").groupBy("g").agg(F.min(F.struct("_d", "_h", "n", "hist")).alias("k")).select("g", "k.*")
    nodes = written(nodes)
    # one exchange of signatures serves the counts and the join: both need all its columns (_n), no filter of the counts can move
    # below it (_salt), and the join's null filters are there already
    dealt = _signed_sets(rows, cells).where("s is not null and salt is not null").repartition("s", "salt")
    counts = dealt.groupBy("s", "salt").agg(F.min("g").alias("least"), F.max("g").alias("most"), F.count("*").alias("size"), F.max("salt").alias("_salt"), F.max("n").alias("_n"))
    # a signature is of frequent elements always or never: its salts are 1 to SALTS, or 0
    some = counts.where("_n > 0 and (_salt > 0 or least < most)").groupBy("s").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("size").alias("size"), F.max("_salt").alias("_salt"))
    salts = F.when(F.col("_salt") > 0, F.sequence(F.lit(1), F.lit(SALTS))).otherwise(F.array(F.lit(0)))
    groups = some.where("least < most").select("s", F.explode(salts).alias("salt"), "size")
    shared = written(dealt.join(groups, ["s", "salt"]).select("s", "g", "n", "size").distinct())
    # the member that meets the most others over all its signatures leads: the text that the copies of a group come from
    meets = shared.groupBy("g").agg(F.sum("size").alias("meets"))
    ranked = written(shared.join(meets, "g").select("s", "g", "n", "meets"))
    # sums are written before a join, so that Spark can split the join's hot keys
    leads = written(ranked.groupBy("s").agg(F.max(F.struct("meets", "g", "n")).alias("k")).select("s", F.col("k.g").alias("y"), F.col("k.n").alias("ny")))
    members = written(ranked.join(leads, "s").select("s", "g", "n", "y", "ny"))
    sizes_fit = 5 * F.least("nx", "ny") >= 4 * F.greatest("nx", "ny")
    x, y = (nodes.select(F.col("g").alias(k), F.col("n").cast("int").alias(f"n{k}"), F.col("hist").alias(f"h{k}")) for k in "xy")
    pairs = members.where("g <> y").select(F.col("g").alias("x"), F.col("n").alias("nx"), "y", "ny").where(sizes_fit).select("x", "y").distinct()
    links = _links(written(_may_link(pairs.join(x, "x").join(y, "y"))), nodes, rows)
    roots = components(links)
    # signatures whose members are in several components still
    placed = members.join(roots.withColumnRenamed("node", "g"), "g", "left").withColumn("root", F.coalesce("root", "g"))
    split = written(placed.groupBy("s").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("s"))
    open_ = written(placed.join(split, "s").join(nodes.select("g", "hist"), "g").select("s", "g", "n", "root", "y", "hist"))
    more = written(_pairs_within(open_.where("g <> y").select("s", "g", "n", "root", "hist")).distinct())
    if more.head(1):  # the first roots stand for the first links
        known = roots.select(F.col("node").alias("x"), F.col("root").alias("y"))
        roots = components(known.unionByName(_links(more, nodes, rows)))
    # the least document of each component
    ends = written(roots.select(F.col("node").alias("g"), "root").unionByName(roots.select(F.col("root").alias("g"), "root").distinct()))
    least = written(ends.join(nodes.select("g", "_d", "_h"), "g").groupBy("root").agg(F.min(F.struct("_d", "_h")).alias("k")))
    first = ends.join(least, "root").select("g", "k")
    own = F.coalesce("k", F.struct("_d", "_h"))
    of = written(nodes.join(first, "g", "left").select("g", own.alias("k")).select("g", F.col("k._d").alias("component"), F.col("k._h").alias("_least_h")))
    stays = F.when(F.col("n") > 0, (F.col("_d") == F.col("component")) & (F.col("_h") == F.col("_least_h"))).otherwise(True)
    found = sets.join(of, "g", "left").withColumn("stays", stays).withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_d")))
    return found.select(keys.doc_id(F.col("_d")).alias("doc_id"), F.col("n").alias("n_shingles"), keys.doc_id(F.col("component")).alias("component_id"), "_d", "_h", "stays")


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group one document, that with the least doc_id (of several texts under it that with the least
    hash, of equal rows any one); all others without links. Rows are told apart by (_d, _h), so null and repeated ids count."""
    found = join(docs.select("doc_id", "text"))
    fates = written(found.groupBy("_d", "_h").agg(F.min("stays").alias("stays"), F.max("n_shingles").alias("n"), F.count("*").alias("rows")))
    key, own = ["_d", "_h"], keys.hidden(docs, "doc_id", "text")
    keyed = own.withColumns({"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(keys.LAST)), "_h": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    left = keyed.join(fates.where("not stays").select(*key), key, "left_anti")
    twice = fates.where("stays and n > 0 and rows > 1").select(*key)
    if twice.head(1):  # equal rows of a group's least document
        left = left.join(twice, key, "left_anti").unionByName(left.join(twice, key, "left_semi").dropDuplicates(key))
    return left.select(*own.columns).toDF(*docs.columns)

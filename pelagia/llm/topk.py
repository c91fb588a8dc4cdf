"""Exact top-k search: an impact-ordered, score-at-a-time index over integer vectors.

Candidates are dealt once, to blocks of at most about ``BLOCK`` rows, and every block has one index, made once. Queries go to
every block and stream through its task in batches of at most ``QUERIES`` (fewer for large blocks), after the block's candidates, so a task holds one block and
one batch, and the rows shuffled are the candidates and blocks x queries. A block's index holds, for each
dimension, its posting list in order of value: equal values are one segment, whose impact for a query is the query's
component times the value, taken from the least such product. Segments are processed in levels of descending impact; an
unprocessed posting adds at most the level's impact, which bounds every row's score. Processing stops when only few rows
could still be among the k best, by proof: their bounds reach the k-th exact score among the rows found so far. The
possible members are scored exactly. The k best of all blocks are ranked by query.

Defined results: ties go to the smaller vec_id; vectors that are null or have null or non-finite components, and rows without a
vec_id, take no part; shorter vectors count as padded with zeros; a query does not find rows of its own vec_id; repeated candidate
rows count each, repeated query rows once; distinct vectors under one query id are ranked apart, so a rank occurs once for each;
an empty table gives no rows; scores are 64-bit and wrap beyond; only vec_id and embedding are read, so other columns
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pelagia.session import table

BLOCK, QUERIES = 131_072, 1024
#: Bounds, a number for each row of a block and query of a batch, that a task holds at a time, about.
BOUNDS = 1 << 23
#: Blocks are not made smaller than this to occupy more tasks.
LEAST_BLOCK = 4096
#: Levels of impact, as shares of a query's highest.
LEVELS = (0.1, 0.04)


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, as long; null where a component is null or not finite."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long")))


def _matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """[row, component], padded with zeros, or cut, to ``width``."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    most = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), max(most, width or 0)), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out[:, :width]


class ImpactIndex:
    """Posting lists of one block: for each dimension, segments of the rows with one value."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.most = float(np.abs(rows).max(initial=0))
        # 32-bit sums where no score can overflow them
        self.narrow = self.most**2 * rows.shape[1] < 2**29
        self.rows, self.ids = np.ascontiguousarray(rows[order].astype(np.int32 if self.narrow else np.int64)), ids[order]
        self.segments = []  # (dimension, value, rows)
        for d, column in enumerate(self.rows.T):
            by_value = np.argsort(column, kind="stable")
            values = column[by_value]
            edges = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else []
            self.segments += [(d, int(values[a]), by_value[a:b]) for a, b in zip(edges, [*edges[1:], len(values)], strict=True)]
        self.of = np.array([x[0] for x in self.segments], np.int64)
        self.value = np.array([x[1] for x in self.segments], self.rows.dtype)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of each query's k best rows, best first; own: the queries' ids."""
        n = len(self.ids)
        kind = np.int32 if self.narrow and self.most * float(np.abs(queries).max(initial=0)) * queries.shape[1] < 2**29 else np.int64
        queries = queries.astype(kind)
        out: list = [None] * len(queries)
        todo = np.arange(len(queries))
        for share in LEVELS if n > 8 * k else ():
            bound = self.bounds(queries[todo], share)
            later = []
            for column, at in enumerate(todo):
                mine = np.flatnonzero(self.ids != own[at])
                bounds = bound[column, mine]
                some = mine[np.argpartition(bounds, len(mine) - k)[len(mine) - k :]] if len(mine) > k else mine
                floor = (self.rows[some] @ queries[at]).min(initial=2**29)  # at least k rows reach it
                left = mine[bounds >= floor]
                if len(left) <= max(8 * k, n // 8):
                    out[at] = self._best(queries[at], left, k)
                else:
                    later.append(at)
            todo = np.array(later, np.int64)
            if not len(todo):
                break
        for at in todo:  # nothing is ruled out
            out[at] = self._best(queries[at], np.flatnonzero(self.ids != own[at]), k)
        return out

    def bounds(self, queries: np.ndarray, share: float) -> np.ndarray:
        """[query, row]: no row's score is higher. Segments are processed by descending impact (product of the query's
        component and the value, from the dimension's least) until it is under ``share`` of each query's highest; what
        a dimension adds to rows not processed is at most that level, or its highest impact."""
        width = self.rows.shape[1]
        product = queries[:, self.of] * self.value  # [query, segment]
        edges = np.searchsorted(self.of, np.arange(width))
        low, high = np.minimum.reduceat(product, edges, axis=1), np.maximum.reduceat(product, edges, axis=1)
        top = high - low
        caps = np.minimum(top, (top.max(1, initial=0, keepdims=True) * share).astype(top.dtype))
        more = np.maximum(product - low[:, self.of] - caps[:, self.of], 0).astype(queries.dtype)
        impact = more.max(0, initial=0)
        bound = np.repeat((low.sum(1) + caps.sum(1)).astype(queries.dtype)[None, :], len(self.ids), 0)
        more = np.ascontiguousarray(more.T)
        for s in np.argsort(-impact, kind="stable"):
            if impact[s] <= 0:
                break
            bound[self.segments[s][2]] += more[s]
        return np.ascontiguousarray(bound.T)

    def _best(self, query: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = self.rows[rows] @ query
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][order], scores[order].astype(np.int64)


def search(candidates: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``candidates`` for each row of ``queries`` (vec_id, embedding)."""
    own = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v")).where("v is not null and vec_id is not null")
    rows, asked = own(candidates), own(queries).dropDuplicates(["vec_id", "v"])
    n, tasks = candidates.count(), int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // BLOCK), min(tasks, -(-n // LEAST_BLOCK)))
    tag = F.xxhash64("v")  # tells the vectors of one id apart
    a = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "vec_id", tag.alias("tag"), "v")
    b = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "vec_id", tag.alias("tag"), "v")
    # by range: a block shares its task with another only where there are more blocks than tasks
    dealt = a.unionByName(b).repartitionByRange(blocks, "block").sortWithinPartitions("block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, index, width = None, [], None, 0
        for batch in batches:
            of, asks = (batch.column(c).to_numpy() for c in ("block", "asks"))
            edges = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (asks[1:] != asks[:-1]))) if len(of) else []
            for lo, hi in zip(edges, [*edges[1:], len(of)], strict=True):
                if of[lo] != block:
                    block, held, index = of[lo], [], None
                part = batch.slice(lo, hi - lo)
                if not asks[lo]:
                    held.append((part.column("vec_id").to_numpy(), _matrix(part.column("v"))))
                    continue
                if index is None and held:
                    width = max(m.shape[1] for _, m in held)
                    index = ImpactIndex(np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, m in held]), np.concatenate([i for i, _ in held]))
                    held = []
                size = min(QUERIES, max(16, BOUNDS // len(index.ids))) if index is not None else 1
                for at in range(0, part.num_rows if index is not None else 0, size):
                    some = part.slice(at, size)
                    ids, tags = some.column("vec_id").to_numpy(), some.column("tag").to_numpy()
                    found = index.search(_matrix(some.column("v"), width), ids, k)
                    sizes = [len(x) for x, _ in found]
                    columns = [np.repeat(ids, sizes), np.repeat(tags, sizes), *(np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "tag", "vec_id", "score"])

    parts = dealt.mapInArrow(run, "query_id long, tag long, vec_id long, score long")
    best = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""

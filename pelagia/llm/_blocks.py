"""Packed exchange between blocks of documents and a table of keys that no task could hold.

A block is a bounded slice of documents, a row of a written table with an id of its own. Each block asks once for each of its distinct
keys, in one row for each part of the key space (``part``), as sorted arrays; what many documents of a block ask for is thus one
key. A part's rows are gathered by key hash and answered by arrays in the same order, which are joined back by the block's id. A
key that a third of all documents have is one entry a block, so no part is hot; a part holds its share of the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pelagia.llm._text import U, mix
from pelagia.session import written

CODEC = pa.Codec("zstd", 1)


def pack(values: np.ndarray) -> bytes:
    """An array's bytes, compressed; its length stands before them."""
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + CODEC.compress(raw, asbytes=True)


def unpack(blob: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return np.frombuffer(CODEC.decompress(blob[8:], n, asbytes=True), dtype) if n else np.zeros(0, dtype)


def block_ids() -> Iterator[int]:
    """Ids for the blocks that a task writes: no other committed task of the job has them."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId()
    yield from (at << 32 | i for i in range(1 << 32))


def parts(spark) -> int:
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def part(keys: np.ndarray, n: int) -> np.ndarray:
    """The part of each key."""
    return (mix(keys.astype(U)) % U(n)).astype(np.int64)


def answered(asked: DataFrame, answer: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """The rows that ``answer`` makes of all rows of a part (b, p, ...), written."""
    return written(asked.groupBy("p").applyInArrow(answer, schema))


def joined(blocks: DataFrame, replies: DataFrame, column: str) -> DataFrame:
    """``blocks`` with ``replies``: the (p, ``column``) of each block."""
    found = replies.groupBy("b").agg(F.collect_list(F.struct("p", column)).alias("replies"))
    return blocks.join(found, "b", "left")


def in_parts(where: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indices in ascending order) of every part that occurs."""
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(n + 1))
    for p in np.flatnonzero(np.diff(edges)):
        yield int(p), order[edges[p] : edges[p + 1]]

"""Mergeable quantile summaries: greedy bucket histograms.

A summary of a key is a list of disjoint buckets (low, high, count). It is made from the counts of distinct values: in order of value,
a value belongs to the window that the count before it falls in (``before * WINDOWS div n``), and a window's values are one bucket.
A value with a window's count or more is heavy and a bucket of its own; it ends its window, so no bucket reaches over it. The two
least values and the largest stand alone as well. A bucket of several values thus holds less than 2 / WINDOWS of the rows (the
error share), and a summary has at most 2 x WINDOWS + 3 buckets, whatever the input.

``merge`` takes summaries whose buckets overlap. All lows and highs of a key cut its range into segments; a bucket gives each
segment it covers a share by width, in units of 2**-16 rows, so counts stay whole and their sum exact; single values keep their own
segment. The segments are packed again by the same windows. At any value, each summary has one bucket at most that reaches over it,
so merging errs by less than 2 / WINDOWS of all rows, and packing by as much again. Summaries of a key are bounded, and so is
what ``merge`` gathers for a key: 2 x (2 x WINDOWS + 3) rows for each summary. Merge very many by levels (hours, days, months):
the error grows by 2 / WINDOWS a level.

Counting runs over ranges of (key, value), not over keys, so a key with a third of all rows is many tasks' work: rows are dealt by range,
running counts are made inside a range in Arrow batches, and what the earlier ranges of a key hold is added by a join. The written
table makes the ranges final before anything is added.

Defined results: rows whose key or value is null take no part (a null part counts as the part of the empty id); NaN and infinite
money is dropped; repeated rows count; a key with one value has one bucket; an empty table has no summaries; columns beside
those named are not read, so they cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from pelagia.session import table, written

WINDOWS = 150
SALT = 4_000
BATCHES, PER_MILLE, QUANTILES, LEAST = 8, 50, 10, 20


def counts(rows: DataFrame, keys: list[str], part: str, value: str) -> DataFrame:
    """Distinct values of every (keys, part) and their counts: keys, part, value, c."""
    return rows.dropna(subset=[*keys, value]).groupBy(*keys, part, value).agg(F.count(F.lit(1)).alias("c"))


def _changes(columns: list[pa.Array], last: list | None) -> np.ndarray:
    """Where a row's ``columns`` differ from the row before; ``last`` is the row before the first."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    for i, column in enumerate(columns):
        out[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        out[0] |= last is None or column[0].as_py() != last[i]
    return out


def _running(keys: list[str], part: str, value: str):
    """Adds to sorted rows: _p (range), _bw, _bp (rows of the key, and of the key's part, before the value, inside the range) and
    _i (values of the part before it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        last, last_value, whole, tied = None, None, 0, 0
        parts: dict[int, tuple[int, int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            named = [batch.column(k) for k in keys]
            c = batch.column("c").to_numpy(zero_copy_only=False).astype(np.int64)
            x = batch.column(value).to_numpy(zero_copy_only=False)
            p = batch.column(part).to_numpy(zero_copy_only=False)
            fresh = _changes(named, last)
            n = len(c)
            if fresh[0]:
                whole, tied, parts, last_value = 0, 0, {}, None
            # the key: rows before this value, ties of one value (its parts) not counted
            total = np.cumsum(c)
            begins = fresh | (np.arange(n) == 0)
            begin, key_of = np.flatnonzero(begins), np.cumsum(begins) - 1
            before = total - c - (total - c)[begin][key_of]
            before[key_of == 0] += whole
            new = fresh | np.append(True, x[1:] != x[:-1])
            if not fresh[0] and last_value == x[0]:
                new[0] = False
            tie_at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            bw = np.where(tie_at >= 0, before[np.maximum(tie_at, 0)], tied)
            # the parts
            order = np.lexsort((np.arange(n), p, key_of))
            po, ko, co = p[order], key_of[order], c[order]
            edge = np.append(True, (po[1:] != po[:-1]) | (ko[1:] != ko[:-1]))
            first = np.flatnonzero(edge)
            run_of = np.cumsum(edge) - 1
            sums = np.cumsum(co) - co
            local = sums - sums[first][run_of]
            index = np.arange(n) - first[run_of]
            for r in np.flatnonzero(ko[first] == 0):  # carried from the batch before
                s, i = parts.get(int(po[first[r]]), (0, 0))
                own = run_of == r
                local[own] += s
                index[own] += i
            bp, idx = np.empty(n, np.int64), np.empty(n, np.int64)
            bp[order], idx[order] = local, index
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v) for v in (np.full(n, at, np.int32), bw, bp, idx))], [*batch.schema.names, "_p", "_bw", "_bp", "_i"])
            # carry the last key
            ends = np.append(first[1:], n) - 1
            kept = parts if len(begin) == 1 else {}
            for e in ends[ko[ends] == key_of[-1]]:
                kept[int(po[e])] = (int(local[e] + co[e]), int(index[e] + 1))
            parts, last, last_value = kept, [v[n - 1].as_py() for v in named], x[-1]
            whole, tied = int(before[-1] + c[-1]), int(bw[-1])

    return run


def ranked(counted: DataFrame, keys: list[str], part: str, value: str) -> DataFrame:
    """``counted`` with the place of every value: bp, np, i, m (of its part: rows before, rows, values before, values) and
    bw, nw, mw (of its key: rows before, rows, rows of ``counted``)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema) + ", _p int, _bw long, _bp long, _i long"
    dealt = counted.repartitionByRange(*keys, value).sortWithinPartitions(*keys, value, part)
    placed = written(dealt.mapInArrow(_running(keys, part, value), schema))
    before = lambda *by: Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    every = lambda *by: Window.partitionBy(*by)
    own = written(placed.groupBy(*keys, part, "_p").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("m")))
    w = own.groupBy(*keys, "_p").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))
    w = w.select(*keys, "_p", F.coalesce(F.sum("c").over(before(*keys)), F.lit(0)).alias("_ow"), F.sum("c").over(every(*keys)).alias("nw"), F.sum("m").over(every(*keys)).alias("mw"))
    own = own.select(*keys, part, "_p", F.coalesce(F.sum("c").over(before(*keys, part)), F.lit(0)).alias("_op"), F.sum("c").over(every(*keys, part)).alias("np"), F.coalesce(F.sum("m").over(before(*keys, part)), F.lit(0)).alias("_oi"), F.sum("m").over(every(*keys, part)).alias("m"))
    known = written(own.join(w, [*keys, "_p"]))
    found = placed.join(known, [*keys, part, "_p"])
    return found.select(*keys, part, value, "c", (F.col("_bp") + F.col("_op")).alias("bp"), "np", (F.col("_i") + F.col("_oi")).alias("i"), "m", (F.col("_bw") + F.col("_ow")).alias("bw"), "nw", "mw")


def _packed(before: Column, count: Column, n: Column, i: Column, m: Column, low: Column) -> tuple[Column, Column]:
    """(window, own value or null) that tell the buckets apart."""
    alone = (count * WINDOWS >= n) | (i < 2) | (i == m - 1)
    return _div(before * WINDOWS, n), F.when(alone, low)


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of longs."""
    return F.call_function("div", a, b)


def summarise(placed: DataFrame, keys: list[str], part: str, value: str) -> DataFrame:
    """Buckets of every (keys, part) of a ``ranked`` table: keys, part, low, high, count, top (rows that have the value high), n."""
    window, own = _packed(F.col("bp"), F.col("c"), F.col("np"), F.col("i"), F.col("m"), F.col(value))
    packed = placed.select(*keys, part, value, "c", "np", window.alias("_w"), own.alias("_o"))
    alone = packed.where("_o is not null").select(*keys, part, F.col(value).alias("low"), F.col(value).alias("high"), F.col("c").alias("count"), F.col("c").alias("top"), F.col("np").alias("n"))
    light = packed.where("_o is null").groupBy(*keys, part, F.col("np").alias("n"), "_w").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.sum("c").alias("count"), F.max_by("c", value).alias("top"))
    return alone.unionByName(light.drop("_w"))


def merge(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """One summary of each of ``keys`` from all its summaries (keys, low, high, count): keys, low, high, count."""
    width = F.col("high") - F.col("low") + 1
    mass = F.shiftleft(F.col("count"), 16)
    cut = summaries.select(*keys, "low", "high", _div(mass, width).alias("d"), F.pmod(mass, width).alias("rest"))
    opens = cut.select(*keys, F.col("low").alias("v"), "d", "rest")
    closes = cut.select(*keys, (F.col("high") + 1).alias("v"), (-F.col("d")).alias("d"), F.lit(0).cast("long").alias("rest"))
    edges = opens.unionByName(closes).groupBy(*keys, "v").agg(F.sum("d").alias("d"), F.sum("rest").alias("rest"))
    w = Window.partitionBy(*keys).orderBy("v")
    segments = edges.select(*keys, F.col("v").alias("low"), (F.lead("v").over(w) - 1).alias("high"), F.sum("d").over(w).alias("d"), "rest")
    segments = segments.select(*keys, "low", "high", (F.coalesce(F.col("d") * (F.col("high") - F.col("low") + 1), F.lit(0)) + F.col("rest")).alias("mass"))
    w = Window.partitionBy(*keys).orderBy("low")
    segments = segments.select(*keys, "low", "high", F.sum("mass").over(w).alias("upto"), "mass")
    segments = segments.select(*keys, "low", "high", F.shiftright(F.col("upto") - F.col("mass"), 16).alias("before"), F.shiftright("upto", 16).alias("upto")).where("upto > before")
    every = Window.partitionBy(*keys)
    segments = segments.select(*keys, "low", "high", "before", (F.col("upto") - F.col("before")).alias("c"), (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(every).alias("m"), F.max("upto").over(every).alias("n"))
    window, own = _packed(F.col("before"), F.col("c"), F.col("n"), F.col("i"), F.col("m"), F.col("low"))
    return segments.groupBy(*keys, window.alias("_w"), own.alias("_o")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("c").alias("count")).drop("_w", "_o")


def target(i: Column, n: Column, quantiles: int = QUANTILES) -> Column:
    """ceil(i * n / quantiles)."""
    return _div(i * n + (quantiles - 1), F.lit(quantiles).cast("long"))


def _hits(before: Column, count: Column, n: Column, quantiles: int) -> Column:
    """The quantiles i whose target lies in (before, before + count]."""
    first = F.greatest(_div(before * quantiles, n), F.lit(1).cast("long"))
    last = F.least(_div((before + count) * quantiles, n), F.lit(quantiles - 1).cast("long"))
    some = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    return F.filter(some, lambda i: (target(i, n, quantiles) > before) & (target(i, n, quantiles) <= before + count))


def estimate(summaries: DataFrame, keys: list[str], quantiles: int = QUANTILES) -> DataFrame:
    """keys, n, points, i, answer and, of the answer's bucket, upto and top (null if the summary has none): the value that the
    summary gives for the ceil(i * n / quantiles)-th smallest, i below ``quantiles``."""
    top = F.col("top") if "top" in summaries.columns else F.lit(None).cast("long")
    w, every = Window.partitionBy(*keys).orderBy("low"), Window.partitionBy(*keys)
    found = summaries.select(*keys, "high", "count", top.alias("top"), F.sum("count").over(w).alias("upto"), F.sum("count").over(every).alias("n"), F.count(F.lit(1)).over(every).alias("points"))
    hits = _hits(F.col("upto") - F.col("count"), F.col("count"), F.col("n"), quantiles)
    return found.select(*keys, "n", "points", F.explode(hits).alias("i"), F.col("high").alias("answer"), "upto", "top")


def exact(placed: DataFrame, keys: list[str], before: str, count: str, n: str, value: str, quantiles: int = QUANTILES) -> DataFrame:
    """keys, i, exact_x: the target-th smallest value of each key of a ``ranked`` table."""
    hits = _hits(F.col(before), F.col(count), F.col(n), quantiles)
    return placed.select(*keys, F.explode(hits).alias("i"), F.col(value).alias("exact_x"))


def below(placed: DataFrame, answers: DataFrame, keys: list[str], value: str, quantiles: int = QUANTILES) -> DataFrame:
    """keys, i, n_below, n_upto: rows of a ``ranked`` table under, and at or under, each answer (keys, i, answer). A key's rows are
    dealt to one salt for every ``SALT`` of them, and summed under each before they meet."""
    wide = answers.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, F.col("answer"))).alias(f"a{i}") for i in range(1, quantiles)))
    salts = (_div(F.col("mw"), F.lit(SALT).cast("long")) + 1).alias("_n")
    rows = placed.select(*keys, value, "c", salts).withColumn("_s", F.pmod(F.xxhash64(value), F.col("_n"))).drop("_n")
    sizes = placed.groupBy(*keys).agg(F.max("mw").alias("mw")).select(*keys, salts)
    dealt = written(wide.join(sizes, keys).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n"))
    met = rows.join(dealt, [*keys, "_s"])
    sums = [F.sum(F.when(test(F.col(value), F.col(f"a{i}")), F.col("c")).otherwise(0)).alias(f"{name}{i}") for i in range(1, quantiles) for name, test in (("b", lambda x, a: x < a), ("u", lambda x, a: x <= a))]
    part = met.groupBy(*keys, "_s").agg(*sums)
    total = part.groupBy(*keys).agg(*(F.sum(f"{name}{i}").alias(f"{name}{i}") for i in range(1, quantiles) for name in "bu"))
    return total.select(*keys, F.inline(F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.col(f"b{i}").alias("n_below"), F.col(f"u{i}").alias("n_upto")) for i in range(1, quantiles)))))


def streams(spark, sf_dir: str) -> DataFrame:
    """stream, grp, batch, x, c: distinct values of both streams' batches. Lines are counted by item before they meet the items."""
    batch = lambda c: F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(BATCHES)).cast("int").alias("batch")
    sane = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias("money")
    x = (F.floor(100 * F.col("money") + 0.5) + 1000 * F.col("batch")).cast("long").alias("x")
    clicks = table(spark, sf_dir, "clicks").select("click_id", "client_id", "value").groupBy("click_id").agg(F.min(F.struct("client_id", "value")).alias("r"))
    clicks = clicks.select(F.col("r.client_id").cast("string").alias("grp"), F.col("r.value").alias("value"), "click_id").select("grp", sane("value"), batch("click_id"))
    clicks = clicks.select(F.lit("value").alias("stream"), "grp", "batch", x, F.lit(1).cast("long").alias("c"))
    lines = table(spark, sf_dir, "sale_lines").select("item_id", batch("vendor_id")).dropna(subset=["item_id"]).groupBy("item_id", "batch").agg(F.count(F.lit(1)).alias("c"))
    items = table(spark, sf_dir, "items").select("item_id", F.col("brand").alias("grp"), sane("price"))
    prices = lines.join(items.hint("shuffle_merge"), "item_id").select(F.lit("price").alias("stream"), "grp", "batch", x, "c")
    return clicks.unionByName(prices).dropna(subset=["grp", "x"]).groupBy("stream", "grp", "batch", "x").agg(F.sum("c").alias("c"))


def query(spark, sf_dir: str) -> DataFrame:
    keys, of = ["stream", "grp"], ["stream", "grp", "batch"]
    placed = written(ranked(streams(spark, sf_dir), keys, "batch", "x"))
    parts = written(summarise(placed, keys, "batch", "x"))
    whole = merge(parts, keys)
    answers = written(estimate(parts.where(F.col("n") >= LEAST), of))
    merged = written(estimate(whole, keys).where(F.col("n") >= LEAST))
    by_part = answers.join(exact(placed.where(F.col("np") >= LEAST), of, "bp", "c", "np", "x"), [*of, "i"])
    by_part = by_part.select(*of, "i", "n", "exact_x", "points", "answer", (F.col("upto") - F.col("top")).alias("n_below"), F.col("upto").alias("n_upto"))
    big = placed.where(F.col("nw") >= LEAST)
    ties = big.groupBy(*keys, "x").agg(F.min("bw").alias("bw"), F.sum("c").alias("c"), F.max("nw").alias("nw"))
    by_key = merged.join(exact(ties, keys, "bw", "c", "nw", "x"), [*keys, "i"]).join(below(big, merged, keys, "x"), [*keys, "i"])
    by_key = by_key.select(*keys, F.lit(-1).alias("batch"), "i", "n", "exact_x", "points", "answer", "n_below", "n_upto")
    found = by_part.unionByName(by_key).withColumn("target", target(F.col("i"), F.col("n")))
    error = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    found = found.withColumn("rank_error", error).withColumn("within", 1000 * F.col("rank_error") <= PER_MILLE * F.col("n"))
    return found.select(*of, F.col("i").cast("int").alias("i"), "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within")


def _shares(before: str, count: str, n: str, i: str, m: str, low: str) -> str:
    """The SQL of ``_packed``: two columns, w and o."""
    return f"({before} * {WINDOWS}) // {n} as w, case when {count} * {WINDOWS} >= {n} or {i} < 2 or {i} = {m} - 1 then {low} end as o"


def _estimated(of: str, keys: str) -> str:
    return f"""select {keys}, n, points, q as i, high as answer, upto, top from (select {keys}, high, count, top, (sum(count) over (partition by {keys} order by low))::bigint as upto, (sum(count) over (partition by {keys}))::bigint as n, count(*) over (partition by {keys}) as points from {of}), range(1, {QUANTILES}) r(q)
where n >= {LEAST} and (q * n + {QUANTILES - 1}) // {QUANTILES} > upto - count and (q * n + {QUANTILES - 1}) // {QUANTILES} <= upto"""


def _exact(of: str, keys: str) -> str:
    return f"select {keys}, q as i, x as exact_x from {of}, range(1, {QUANTILES}) r(q) where n >= {LEAST} and (q * n + {QUANTILES - 1}) // {QUANTILES} > before and (q * n + {QUANTILES - 1}) // {QUANTILES} <= before + c"


def sql() -> str:
    """The query as DuckDB SQL; crc32 is folded bit by bit into a table, and by bytes over the ids."""
    bits = "list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(id::varchar, ''), lambda h: unicode(h)::bigint)), lambda c, h: xor(c >> 8, t[(xor(c, h) & 255) + 1])), 4294967295)"
    return f"""with t as (select list({bits} order by b) as t from (select unnest(range(256))::bigint as b)),
ids as materialized (select distinct click_id as id from clicks union select distinct vendor_id from sale_lines),
b as materialized (select id, (case when id is null then 0 else {crc} end % {BATCHES})::int as batch from ids, t),
one as (select click_id as id, any_value(client_id)::varchar as grp, any_value(value) as money from clicks group by click_id),
rows_ as (select 'value' as stream, grp, id, money from one union all select 'price', brand, vendor_id, price from sale_lines join items using (item_id)),
c as materialized (select stream, grp, batch, floor(100 * money + 0.5)::bigint + 1000 * batch as x, count(*) as c from rows_ join b on b.id is not distinct from rows_.id where grp is not null and money is not null and isfinite(money) group by all),
p as materialized (select *, (sum(c) over k - c)::bigint as before, (sum(c) over a)::bigint as n, row_number() over k - 1 as j, count(*) over a as m from c window k as (partition by stream, grp, batch order by x), a as (partition by stream, grp, batch)),
s as materialized (select stream, grp, batch, min(x) as low, max(x) as high, sum(c)::bigint as count, arg_max(c, x) as top from (select *, {_shares('before', 'c', 'n', 'j', 'm', 'x')} from p) group by stream, grp, batch, w, o),
e as (select stream, grp, low as v, (count << 16) // (high - low + 1) as d, (count << 16) % (high - low + 1) as rest from s union all select stream, grp, high + 1, -((count << 16) // (high - low + 1)), 0 from s),
f as (select stream, grp, v, sum(d) as d, sum(rest) as rest from e group by all),
g as (select stream, grp, v as low, lead(v) over k - 1 as high, sum(d) over k as d, rest from f window k as (partition by stream, grp order by v)),
h as (select stream, grp, low, high, (coalesce(d * (high - low + 1), 0) + rest)::bigint as mass from g),
l as (select *, (sum(mass) over (partition by stream, grp order by low))::bigint as upto from h),
o as (select stream, grp, low, high, (upto - mass) >> 16 as before, (upto >> 16) - ((upto - mass) >> 16) as c, upto >> 16 as upto from l where upto >> 16 > (upto - mass) >> 16),
q as (select *, row_number() over (partition by stream, grp order by low) - 1 as j, count(*) over (partition by stream, grp) as m, max(upto) over (partition by stream, grp) as n from o),
u as materialized (select stream, grp, min(low) as low, max(high) as high, sum(c)::bigint as count, null::bigint as top from (select *, {_shares('before', 'c', 'n', 'j', 'm', 'low')} from q) group by stream, grp, w, o),
y as materialized ({_estimated('s', 'stream, grp, batch')}), z as materialized ({_estimated('u', 'stream, grp')}),
wx as materialized (select stream, grp, x, sum(c)::bigint as c from c group by all),
wp as (select *, (sum(c) over (partition by stream, grp order by x) - c)::bigint as before, (sum(c) over (partition by stream, grp))::bigint as n from wx),
wb as (select stream, grp, i, (coalesce(sum(c) filter (x < answer), 0))::bigint as n_below, (coalesce(sum(c) filter (x <= answer), 0))::bigint as n_upto from z join wx using (stream, grp) group by all),
r as (select stream, grp, batch, i, n, exact_x, points, answer, upto - top as n_below, upto as n_upto from y join ({_exact('p', 'stream, grp, batch')}) using (stream, grp, batch, i)
  union all select stream, grp, -1, i, n, exact_x, points, answer, n_below, n_upto from z join ({_exact('wp', 'stream, grp')}) using (stream, grp, i) join wb using (stream, grp, i)),
v as (select *, (i * n + {QUANTILES - 1}) // {QUANTILES} as target from r), x as (select *, greatest(0, n_below + 1 - target, target - n_upto)::bigint as rank_error from v)
select stream, grp, batch::int as batch, i::int as i, n, target, exact_x, points, answer, n_below, n_upto, rank_error, 1000 * rank_error <= {PER_MILLE} * n as within from x"""

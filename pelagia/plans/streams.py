"""Queries over streams; each equals a batch query, which is its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia.plans.register import ORACLE, QUERIES, R, r6
from pelagia.session import scratch
from pelagia.streaming import incremental as S, keyed


def _add(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


@_add("ss_incremental_topk", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 25")
def _(spark, sf_dir):
    return keyed.best(S.table_stream(spark, sf_dir, "documents").select("doc_id", "n_chars"), [], ["n_chars", "doc_id"], [True, False], 25, scratch(spark))


@_add("ss_global_index", "select page_id, row_number() over (order by page_id) - 1 as i from pages")
def _(spark, sf_dir):
    return S.indexed(S.table_stream(spark, sf_dir, "pages").select("page_id"), "page_id")


@_add("ss_poll_monitor", f"select user_id, {R('max(value)')} as peak, {R('sum(value)')} as total from events group by user_id")
def _(spark, sf_dir):
    found = keyed.peaks(S.table_stream(spark, sf_dir, "events").select("user_id", "value"), "user_id", "value", scratch(spark))
    return found.select("user_id", r6("peak").alias("peak"), r6("total").alias("total"))


@_add("ss_rl_controller", f"""with l as (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) - 1 as age from events), k as (select *, count(*) over (partition by user_id) as n from l where age < 50),
b as (select user_id, count(*) as n, avg(value) as recent, sum(value * case when age = n - 1 then 1 else 0.1 end * pow(0.9::double, age)) as balance from k group by user_id)
select user_id, n, {R('recent')} as recent, {R('balance')} as balance, {R('greatest(-5, least(5, 0.2 * (50 - balance)))')} as step from b""")
def _(spark, sf_dir):
    events = S.table_stream(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    buffer = keyed.best(events, ["user_id"], ["ts", "event_id"], [True, True], 50, scratch(spark))
    found = S.control(buffer, "user_id", ["ts", "event_id"], "value", target=50.0, alpha=0.1, gain=0.2, bound=5.0)
    return found.select("user_id", "n", *(r6(c).alias(c) for c in ("recent", "balance", "step")))


@_add("ss_event_windows", "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2")
def _(spark, sf_dir):
    stream = S.table_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return S.windows(stream, "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")

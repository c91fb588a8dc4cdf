"""Mixing sources to target weights by iterative proportional fitting (raking); DataFrame functions only.

Documents are summed to cells (source, language, topic) before anything is shuffled by a key, so a source with a third of
all rows is a few cells. Each step scales the cells' token weights so that one margin meets its target; the margins are
taken in turn, ``ITERATIONS`` times. A document's calibrated ratio is its cell's raked weight over its tokens: documents
of ratio r are sampled with probability min(1, r) by a hash of the id, and carry the weight max(1, r), so the expected
weighted tokens of every cell are the raked ones. ``copies`` puts the weight into whole numbers: floor(r) of each document and
one more with probability r - floor(r), by the same hash. No row is sampled before the end, and a document's tokens are counted
once, from its whole text.

Targets are shares of tokens by value. The default of a margin is its own share to the power ``TEMPERATURE``, normalised;
values without a target in a given table get none.

Defined results: a null source or language is a value of its own (shown as null); a null text has no tokens and its cell,
if it has no others, the ratio 1; repeated rows count each and share a fate; a null doc_id is sampled as id ``null``; ``mix``
passes no other input columns on, ``stage`` passes all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pelagia.llm import keys
from pelagia.session import table, written

MARGINS, ITERATIONS, TEMPERATURE, SEED = ("source", "lang", "topic"), 12, 0.8, "mix-1"
#: Sums of a margin, and cells, are broadcast up to this number of rows; beyond it they are joined by a shuffle.
BROADCAST_CELLS = 20_000


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    """A rough form of the text: table, shout, short, long or prose."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("!!")), "shout").when(tokens < 100, "short").when(tokens >= 1000, "long").otherwise("prose")


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id alone, equal on every engine and at every size."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets_of(cells: DataFrame, margin: str, temperature: float = TEMPERATURE) -> DataFrame:
    """(margin, target): shares in proportion to token shares to the power ``temperature``."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t"))
    powers = sums.select(margin, F.when(F.col("t") > 0, F.pow("t", F.lit(temperature))).otherwise(0.0).alias("p"))
    total = powers.agg(F.sum("p").alias("total"))
    return powers.join(F.broadcast(total)).select(margin, (F.when(F.col("total") > 0, F.col("p") / F.col("total")).otherwise(0.0)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], margins=MARGINS, iterations: int = ITERATIONS) -> DataFrame:
    """``cells`` (margins, tokens) with w: the raked tokens. targets: margin -> DataFrame (margin, target share). A margin's
    sums are aggregated map-side, so a margin of few values is no hot task; each round of margins is one plan."""
    known = cells.agg(F.sum("tokens").alias("total"), *(F.approx_count_distinct(F.coalesce(F.col(m), F.lit(""))).alias(m) for m in margins)).first()
    total = float(known.total or 0)
    df = cells.withColumn("w", F.col("tokens").cast("double"))
    for m in margins:
        own = targets[m].select(F.col(m).alias("_k"), F.col("target").alias(f"_t_{m}"))
        df = df.join(own, F.col(m).eqNullSafe(F.col("_k")), "left").drop("_k").withColumn(f"_t_{m}", F.coalesce(f"_t_{m}", F.lit(0.0)))
    df = written(df)
    for _ in range(iterations):
        for m in margins:
            sums = df.groupBy(F.col(m).alias("_k")).agg(F.sum("w").alias("_now"))
            sums = F.broadcast(sums) if known[m] <= BROADCAST_CELLS else sums
            scaled = F.when(F.col("_now") > 0, F.col("w") * F.col(f"_t_{m}") * total / F.col("_now")).otherwise(0.0)
            df = df.join(sums, F.col(m).eqNullSafe(F.col("_k")), "left").withColumn("w", scaled).drop("_k", "_now")
        df = written(df)
    return df.select(*margins, "tokens", "w")


def described(docs: DataFrame, topic_of=topic) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens of every document."""
    counted = docs.select("doc_id", "source", "lang", "text", n_tokens(F.col("text")).alias("n_tokens"))
    return counted.select("doc_id", "source", "lang", topic_of(F.col("text"), F.col("n_tokens")).alias("topic"), "n_tokens")


def _ratios(rows: DataFrame, targets: dict[str, DataFrame] | None = None, iterations: int = ITERATIONS) -> DataFrame:
    """(_source, _lang, _topic, ratio) of every cell of ``rows``; few cells are marked for a broadcast."""
    cells = written(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    raked = written(rake(cells, {m: (targets or {}).get(m) or targets_of(cells, m) for m in MARGINS}, iterations=iterations))
    ratio = raked.select(*(F.col(m).alias(f"_{m}") for m in MARGINS), F.when(F.col("tokens") > 0, F.round(F.col("w") / F.col("tokens"), 9)).otherwise(1.0).alias("ratio"))
    # few cells are broadcast; beyond that the join is a shuffle that Spark splits where a cell is hot
    return F.broadcast(ratio) if ratio.count() <= BROADCAST_CELLS else ratio


def copies() -> Column:
    """How often a row of (doc_id, ratio) is taken: ``ratio`` times on average."""
    whole = F.floor("ratio")
    return (whole + (uniform(F.col("doc_id")) < F.col("ratio") - whole).cast("long")).cast("long")


def _same_cell(topic: str = "topic") -> Column:
    on = F.col(topic).eqNullSafe(F.col("_topic"))
    for m in MARGINS[:2]:
        on = on & F.col(m).eqNullSafe(F.col(f"_{m}"))
    return on


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, ratio, probability, weight, sampled, copies of every document."""
    rows = written(described(docs))
    p = F.least(F.col("ratio"), F.lit(1.0))
    found = rows.join(_ratios(rows, targets, iterations), _same_cell(), "left").drop(*(f"_{m}" for m in MARGINS))
    return found.select("doc_id", *MARGINS, "n_tokens", "ratio", p.alias("probability"), F.greatest(F.col("ratio"), F.lit(1.0)).alias("weight"), (uniform(F.col("doc_id")) < p).alias("sampled"), copies().alias("copies"))


def query(spark, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("ratio", "probability", "weight")})


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as ``copies`` says, so the corpus meets the targets in expectation: documents
    of cells with a ratio under 1 are sampled, those of cells with a ratio over 1 are repeated. Each row is decided by its own cell and
    id; rows are not joined by doc_id, so null and repeated ids count like any."""
    ratios = _ratios(written(described(docs)))
    own = keys.hidden(docs, "doc_id", "text", "source", "lang")
    placed = own.withColumn("_cell_topic", topic(F.col("text"), n_tokens(F.col("text")))).join(ratios, _same_cell("_cell_topic"), "left")
    n = copies()
    return placed.where(n > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*own.columns).toDF(*docs.columns)


def sql() -> str:
    parts = [
        r"""with d as (select doc_id, source, lang, coalesce(text, '') as text,
  coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0)::bigint as n_tokens from documents),
r as (select doc_id, source, lang, case when contains(text, ' | ') then 'table' when contains(text, '!!') then 'shout'
  when n_tokens < 100 then 'short' when n_tokens >= 1000 then 'long' else 'prose' end as topic, n_tokens from d),
c as (select source, lang, topic, sum(n_tokens)::bigint as tokens from r group by all)"""
    ]
    for m in MARGINS:
        parts.append(f"t_{m} as (select {m}, p / sum(p) over () as target from (select {m}, pow(sum(tokens)::double, {TEMPERATURE}) as p from c group by {m}))")
    parts.append("w0 as materialized (select c.*, tokens::double as w, (select sum(tokens)::double from c) as total, " + ", ".join(f"t_{m}.target as g_{m}" for m in MARGINS) + " from c " + " ".join(f"join t_{m} on c.{m} is not distinct from t_{m}.{m}" for m in MARGINS) + ")")
    at = 0
    for _ in range(ITERATIONS):
        for m in MARGINS:
            parts.append(f"w{at + 1} as materialized (select * replace (w * g_{m} * total / sum(w) over (partition by {m}) as w) from w{at})")
            at += 1
    parts.append(f"q as (select source, lang, topic, case when tokens > 0 then round(w / tokens, 9) else 1.0 end as ratio from w{at})")
    return ",\n".join(parts) + f"""
select doc_id, r.source, r.lang, r.topic, n_tokens, round(ratio, 6) as ratio, round(least(ratio, 1.0), 6) as probability,
  round(greatest(ratio, 1.0), 6) as weight, u < least(ratio, 1.0) as sampled, floor(ratio)::bigint + (u < ratio - floor(ratio))::bigint as copies
from (select *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint / 4294967296.0::double as u from r) r join q on r.source is not distinct from q.source and r.lang is not distinct from q.lang and r.topic = q.topic
"""

"""URL filter by a character language-model ratio.

A character is a byte of the URL's UTF-8, so a letter beyond ASCII counts as several. Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, give each URL a length-normalised
log-likelihood difference (rejected minus accepted, a byte); a URL is blocked above a threshold calibrated on a
held-out fifth of the labelled URLs. The labels are what the rule list says of the URLs that a rule fits, or a
``labels`` column of the caller. Every order backs off to the next shorter one (Dirichlet smoothing), order 0 to the
uniform law. n-grams and contexts are counted exactly, each under a key of its own bytes, over all labelled URLs, so the
model is a table that grows with the input.

A byte's difference depends on the last ``ORDERS`` bytes alone (a window). Spark gives every distinct window of the URLs
its difference by a join with the counts; orders of at most two bytes, which nearly all windows share, have few keys
and are broadcast. The ``HOT`` most frequent windows are broadcast to the URLs, a fixed size; URLs with others look
these up by a join. Any ``HOT`` gives the same scores.

Defined results: a null URL or one without ``://`` has empty host and path and fits no rule; without a host there is no
evidence, so it scores 0 and is allowed, whatever the threshold; repeated rows give repeated rows; input columns named host, path,
rule, said, score, threshold or verdict are replaced; without labelled URLs of both kinds every URL scores 0 and is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pelagia.llm._text import LOWER, buffers, slices
from pelagia.session import table, written

ORDERS, PRIOR, HOT = 5, 8.0, 1 << 18
#: Bytes of the longest n-grams whose counts are broadcast (at most 256 + 65536 n-grams and as many contexts).
SHORT = 2
#: verdict, host, path
RULES = (("block", "com", "en/"), ("allow", "example.com", "en/7"), ("allow", "net", "de/"), ("block", "example.net", "de/8"), ("block", "org", "es/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule (``host/path`` or null) and said (the rule's verdict or null)."""
    host, path = host_and_path(F.col("url"))
    df = pages.withColumns({"host": host, "path": path})
    rule = said = F.lit(None).cast("string")
    for verdict, of, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is tested first
        fits = ((F.col("host") == of) | F.endswith(F.col("host"), F.lit("." + of))) & F.startswith(F.col("path"), F.lit("/" + prefix))
        rule, said = F.when(fits, f"{of}/{prefix}").otherwise(rule), F.when(fits, verdict).otherwise(said)
    return df.withColumns({"rule": rule, "said": said})


def windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The last ORDERS bytes up to each byte as one number (before a text's start there are zeros), and each byte's text."""
    raw, offsets = buffers(column)
    raw = LOWER[raw].astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(raw)) - offsets[text]
    out = raw.copy()
    for k in range(1, min(ORDERS, len(raw))):
        out[k:] |= np.where(at[k:] >= k, raw[:-k], 0) << 8 * k
    return out, text


def _tag(k: int, context: bool) -> int:
    """The bits above the bytes in the key of an n-gram of k + 1 bytes, or of its context of k bytes."""
    return (2 * k + context) << 8 * ORDERS


def gram_keys(window):
    """(order, is context, key) of the n-grams that end a window and of their contexts; numbers, arrays or Columns."""
    shift = (lambda w: F.shiftright(w, 8)) if isinstance(window, Column) else (lambda w: w >> 8)
    both = (lambda w, m: w.bitwiseAND(F.lit(m).cast("long"))) if isinstance(window, Column) else (lambda w, m: w & m)
    for k in range(ORDERS):
        yield k, False, both(window, (1 << 8 * (k + 1)) - 1) + _tag(k, False)
        yield k, True, both(shift(window), (1 << 8 * k) - 1) + _tag(k, True)


def count_grams(df: DataFrame) -> DataFrame:
    """(key, n0, n1): how often accepted and rejected URLs of (url, rejected) have each n-gram and context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "url"):
                found, text = windows(part.column("url"))
                bad = part.column("rejected").to_numpy(zero_copy_only=False).astype(np.int64)[text]
                each, n = np.unique(found * 2 + bad, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(each >> 1), pa.array(np.where(each & 1, 0, n)), pa.array(np.where(each & 1, n, 0))], ["w", "n0", "n1"])

    sums = [F.sum("n0").alias("n0"), F.sum("n1").alias("n1")]
    whole = df.select("url", "rejected").mapInArrow(run, "w long, n0 long, n1 long").groupBy("w").agg(*sums)
    # each distinct window is counted before its shorter n-grams are
    return whole.select(F.explode(F.array(*(key for _, _, key in gram_keys(F.col("w"))))).alias("key"), "n0", "n1").groupBy("key").agg(*sums)


def url_windows(urls: DataFrame) -> DataFrame:
    """(w, m): the distinct windows of the column url and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "url"):
                each, n = np.unique(windows(part.column("url"))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(n)], ["w", "m"])

    return urls.select("url").where("url is not null").mapInArrow(run, "w long, m long").groupBy("w").agg(F.sum("m").alias("m"))


def differences(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``found`` (w, m) with s: log p(rejected) - log p(accepted) of each window's last byte."""
    short = {(k, c) for k in range(ORDERS) for c in (False, True) if k + (not c) <= SHORT}
    is_short = F.lit(False)
    for k, c in sorted(short):
        is_short = is_short | (F.shiftright(F.col("key"), 8 * ORDERS) == 2 * k + c)
    few = counts.where(is_short).toPandas()
    order = np.argsort(few.key.to_numpy())
    known = tuple(few[c].to_numpy()[order] for c in ("key", "n0", "n1"))
    shared = found.sparkSession.sparkContext.broadcast(known)
    long = [(2 * k + c, key) for k, c, key in gram_keys(F.col("w")) if (k, c) not in short]
    asked = found.select("w", "m", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), key.alias("key")) for i, key in long))).alias("q")).select("w", "m", "q.*")
    joined = asked.join(counts.where(~is_short), "key", "left")
    numbers = [F.coalesce(F.max(F.when(F.col("i") == i, F.col(n))), F.lit(0)).alias(f"{n}_{i}") for i, _ in long for n in ("n0", "n1")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, *few = shared.value
        for batch in batches:
            w = batch.column("w").to_numpy()
            p = np.full((2, len(w)), 1 / 256)
            own = {}
            for k, c, key in gram_keys(w):
                if (k, c) in short:
                    at = np.searchsorted(keys, key)
                    at[at == len(keys)] = 0
                    own[k, c] = [np.where(keys[at] == key, n[at], 0) for n in few]
                else:
                    own[k, c] = [batch.column(f"{n}_{2 * k + c}").to_numpy() for n in ("n0", "n1")]
            for k in range(ORDERS):
                p = (np.stack(own[k, False]) + PRIOR * p) / (np.stack(own[k, True]) + PRIOR)
            yield pa.RecordBatch.from_arrays([batch.column("w"), batch.column("m"), pa.array(np.log(p[1]) - np.log(p[0]))], ["w", "m", "s"])

    return joined.groupBy("w", "m").agg(*numbers).mapInArrow(run, "w long, m long, s double")


def fit(labelled: DataFrame, urls: DataFrame) -> tuple | None:
    """The model of (url, rejected) for the column url of ``urls``: windows and differences that are hot, sorted, and a
    DataFrame (w, s) of all or, where all are hot, null; null without URLs of both classes."""
    counts = written(count_grams(labelled))
    start = counts.where(F.col("key") == _tag(0, True)).select("n0", "n1").first()  # the empty context: all bytes
    if start is None or not start.n0 or not start.n1:
        return None
    each = written(differences(url_windows(urls), counts))
    hot = each.orderBy(F.col("m").desc(), "w").limit(HOT).select("w", "s").toPandas().sort_values("w")
    w, s = hot.w.to_numpy(), hot.s.to_numpy()
    if len(w) < HOT:
        return w, s, None
    return w, s, each.select("w", "s")


def calibrate(scored: DataFrame) -> float:
    """The threshold with the best balanced accuracy over (score, rejected), of 512 steps between -4 and 4."""
    step = F.least(F.greatest(F.floor((F.col("score") + 4) * 64), F.lit(0)), F.lit(511))
    table = scored.groupBy(step.cast("int").alias("step"), "rejected").count().toPandas()
    counts = np.zeros((2, 512))
    counts[table.rejected, table.step] = table["count"]
    if not counts.sum(1).all():
        return 0.0
    # blocked: a step at or above the threshold's
    blocked = counts[:, ::-1].cumsum(1)[:, ::-1] / counts.sum(1, keepdims=True)
    gain = blocked[1] - blocked[0]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[len(best) // 2]) / 64 - 4


def score(df: DataFrame, model: tuple | None) -> DataFrame:
    """``df`` with score: the mean difference of the url's bytes; 0 for a null or empty URL."""
    if model is None:
        return df.withColumn("score", F.lit(0.0))
    *hot, rest = model
    shared = df.sparkSession.sparkContext.broadcast(hot)

    def looked_up(part: pd.Series) -> tuple[np.ndarray, ...]:
        """Windows, texts, differences (0: not hot), and whether they are hot."""
        known, s = shared.value
        found, text = windows(pa.array(part.fillna(""), pa.string()))
        at = np.searchsorted(known, found)
        at[at == len(known)] = 0
        good = known[at] == found if len(known) else np.zeros(len(found), bool)
        return found, text, np.where(good, s[at] if len(known) else 0.0, 0.0), good

    @F.pandas_udf("double")
    def hot_sum(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            sums = []
            for at in range(0, len(part), 5000):
                own = part[at : at + 5000]
                _, text, s, _ = looked_up(own)
                sums.append(np.bincount(text, s, len(own)))
            yield pd.Series(np.concatenate(sums) if sums else np.zeros(0))

    @F.pandas_udf("array<long>")
    def others(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            found, text, _, good = looked_up(part)
            yield pd.Series(np.split(found[~good], np.cumsum(np.bincount(text[~good], minlength=len(part)))[:-1]), dtype=object)

    url = F.coalesce(F.col("url"), F.lit(""))
    total, bytes_ = hot_sum(url), F.greatest(F.octet_length(url), F.lit(1))
    if rest is None:
        return df.withColumn("score", total / bytes_)
    cold = df.select("url").where("url is not null").distinct().select("url", F.explode(others(url)).alias("w"))
    # written first: a join of two tables can be split where a URL has a third of all rows, one on an aggregate's exchange cannot
    sums = written(cold.join(rest, "w").groupBy("url").agg(F.sum("s").alias("_cold")))
    return df.join(sums, "url", "left").withColumn("score", (total + F.coalesce("_cold", F.lit(0.0))) / bytes_).select(*df.columns, "score")


def filter_urls(pages: DataFrame, rules=RULES, labels: str | None = None) -> DataFrame:
    """``pages`` with host, path, rule, score, threshold and verdict. ``labels``: a boolean column, true for rejected URLs,
    that is learned from instead of the rules' verdicts."""
    keep = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "said", "score", "threshold", "verdict"}]
    judged = with_rules(pages.select(*keep), rules)
    rejected = F.col(labels).cast("int") if labels else (F.col("said") == "block").cast("int")
    own = judged.select("url", rejected.alias("rejected")).where("rejected is not null and url is not null")
    fold = F.crc32(F.col("url")) % 5 == 0
    model = fit(own.where(~fold), pages)
    threshold = calibrate(score(own.where(fold), model)) if model is not None else 0.0
    known = F.col("host") != ""
    scored = score(judged, model).withColumn("score", F.when(known, F.col("score")).otherwise(0.0)).withColumn("threshold", F.lit(threshold))
    verdict = F.coalesce(F.col("said"), F.when(known & (F.col("score") > F.col("threshold")), "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).drop("said")


def query(spark, sf_dir: str) -> DataFrame:
    found = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "score")

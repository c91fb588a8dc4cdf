"""Ranking with context, weighted scores, embeddings against prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pelagia.operators.scans import numbered

PROMPTS = 10_000


def weighted_score(components: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean; a missing component adds nothing while its weight stays in the denominator."""
    total = sum(weights.values())
    parts = [F.coalesce(components[k], F.lit(0.0)) * w for k, w in weights.items() if k in components]
    return (sum(parts[1:], parts[0]) if parts else F.lit(0.0)) / total


def top_k(df: DataFrame, k: int, score: str = "score", order: str = "scan") -> DataFrame:
    """The k highest, ties to the earliest; a take-ordered limit, so only k rows of a task are moved. Adds rank."""
    best = df.orderBy(F.desc(score), order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), order)))  # k rows


def with_context(df: DataFrame, kept: DataFrame, reach: int = 5, key: str = "scene", order: str = "scan", path: str = "path") -> DataFrame:
    """``kept`` with the paths of up to ``reach`` rows before and after in scan order, within the key. Rows are numbered by ranges, so a
    key with a third of all rows is many tasks' work, and each kept row asks for the numbers beside its own."""
    rows = numbered(df.select(key, order, path), [key], [order])
    asked = rows.join(kept.select(F.col(key).alias("_key"), F.col(order).alias("_at")), F.col(key).eqNullSafe(F.col("_key")) & (F.col(order) == F.col("_at")))
    steps = F.explode(F.array(*(F.lit(d) for d in range(-reach, reach + 1) if d))).alias("_d")
    asked = asked.select("_key", "_at", "_g", steps).select("_key", "_at", "_d", (F.col("_g") + F.col("_d")).alias("_n"))
    near = asked.join(rows, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_g") == F.col("_n"))).groupBy("_at").agg(F.collect_list(F.struct("_d", path)).alias("_near"))
    side = lambda test: F.transform(F.array_sort(F.filter(F.coalesce("_near", F.array()), test)), lambda x: x[path])
    return kept.join(near, kept[order] == near["_at"], "left").withColumns({"before": side(lambda x: x["_d"] < 0), "after": side(lambda x: x["_d"] > 0)}).drop("_near", "_at")


def ranked(df: DataFrame, key: str, score: str = "score", order: str = "scan") -> DataFrame:
    """``df`` with rank, the place by falling score within the key, ties to the earliest; no key is one task's."""
    return numbered(df, [key], [F.desc(score), F.asc(order)]).withColumn("rank", (F.col("_g") + 1).cast("int")).drop("_g")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def prompt_scores(images: DataFrame, prompts: DataFrame) -> DataFrame:
    """vec_id, prompt, cos: unit embeddings against prompt embeddings, which are broadcast; at most ``PROMPTS``."""
    if prompts.limit(PROMPTS + 1).count() > PROMPTS:
        raise ValueError(f"prompts are broadcast; at most {PROMPTS}")
    return images.crossJoin(F.broadcast(prompts)).select("vec_id", "prompt", dot(F.col("embedding"), F.col("p")).alias("cos"))


def softmax(images: DataFrame, prompts: DataFrame, scale: float) -> DataFrame:
    """vec_id, shares: an array of (prompt, cos, p), p the softmax of scale * cos over the prompts. The prompts are one array,
    broadcast (at most ``PROMPTS``), so an image's cosines are an array of its own row and nothing is exchanged."""
    if prompts.limit(PROMPTS + 1).count() > PROMPTS:
        raise ValueError(f"prompts are broadcast; at most {PROMPTS}")
    every = prompts.agg(F.array_sort(F.collect_list(F.struct("prompt", "p"))).alias("_all"))  # one row
    df = images.crossJoin(F.broadcast(every)).select("vec_id", "_all", F.transform("_all", lambda q: dot(F.col("embedding"), q["p"])).alias("_cos"))
    df = df.select("vec_id", "_all", "_cos", F.array_max("_cos").alias("_top"))
    df = df.select("vec_id", "_all", "_cos", F.transform("_cos", lambda c: F.exp(scale * (c - F.col("_top")))).alias("_e"))
    df = df.select("vec_id", "_all", "_cos", "_e", F.aggregate("_e", F.lit(0.0), lambda s, x: s + x).alias("_sum"))
    known = F.zip_with("_all", "_cos", lambda q, c: F.struct(q["prompt"].alias("prompt"), c.alias("cos")))
    return df.select("vec_id", F.zip_with(known, "_e", lambda r, e: F.struct(r["prompt"].alias("prompt"), r["cos"].alias("cos"), (e / F.col("_sum")).alias("p"))).alias("shares"))


def classified(images: DataFrame, prompts: DataFrame, scale: float) -> DataFrame:
    """vec_id, cls, p: the prompt of the largest share (ties to the least prompt, shares to nine digits)."""
    shares = softmax(images, prompts, scale)
    best = F.array_max(F.transform("shares", lambda r: F.struct(F.round(r["p"], 9).alias("p"), (-r["prompt"]).alias("prompt"))))
    return shares.select("vec_id", (-best["prompt"]).alias("cls"), F.array_max(F.transform("shares", lambda r: r["p"])).alias("p"))

"""Segmented scans: the same results whatever the ranges and blocks, with a key of a third of all rows and null keys."""

import random

import pytest
from pyspark.sql import functions as F

from pelagia.operators import ranking, scans, telemetry as T


def rows(n: int = 900, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    out = [("hot" if i % 3 == 0 else None if i % 50 == 1 else f"s{rng.randrange(40)}", i, round(rng.uniform(-5, 5), 3)) for i in range(n)]
    rng.shuffle(out)
    return out


def by_key(data: list[tuple]) -> dict:
    found: dict = {}
    for k, o, v in sorted(data, key=lambda r: r[1]):
        found.setdefault(k, []).append((o, v))
    return found


@pytest.mark.parametrize("ranges", [1, 3, 7, 40])
def test_numbers(spark, ranges):
    data = rows()
    found = scans.numbered(spark.createDataFrame(data, "k string, o long, v double"), ["k"], ["o"], ranges)
    want = {(k, o): i for k, own in by_key(data).items() for i, (o, _) in enumerate(own)}
    assert {(r.k, r.o): r._g for r in found.collect()} == want
    falling = scans.numbered(spark.createDataFrame(data, "k string, o long, v double"), ["k"], [F.desc("v"), "o"], ranges)
    want = {(k, o): i for k, own in by_key(data).items() for i, (o, _) in enumerate(sorted(own, key=lambda x: (-x[1], x[0])))}
    assert {(r.k, r.o): r._g for r in falling.collect()} == want


def test_a_hot_key_is_many_tasks_work(spark):
    df = spark.createDataFrame(rows(3000), "k string, o long, v double").where("k = 'hot'")
    by = ["k", "o"]
    tasks = df.repartitionByRange(7, *by).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) == 7 and max(r["count"] for r in tasks) < 300
    blocks = scans.halo(scans.numbered(df, ["k"], ["o"], 7), 5, 5, 64).groupBy("_b").agg(F.count("*").alias("n"), F.count_if("_own").alias("own")).collect()
    assert max(r.n for r in blocks) <= 74 and sum(r.own for r in blocks) == 1000


@pytest.mark.parametrize("block", [6, 17, 1 << 16])
def test_halos_and_carried_values(spark, block):
    data = rows(400)
    df = scans.numbered(spark.createDataFrame(data, "k string, o long, v double"), ["k"], ["o"], 5)
    near = scans.halo(df, 3, 2, block).withColumns({"a": F.lag("o", 3).over(scans.by_block(["k"])), "b": F.lead("o", 2).over(scans.by_block(["k"]))}).where("_own")
    want = {(k, o): (own[i - 3][0] if i >= 3 else None, own[i + 2][0] if i + 2 < len(own) else None) for k, own in by_key(data).items() for i, (o, _) in enumerate(own)}
    got = near.collect()
    assert len(got) == len(data) and {(r.k, r.o): (r.a, r.b) for r in got} == want
    sums = scans.carried(df, ["k"], {"s": F.sum("o"), "m": F.max("v")}, {"s": "sum", "m": "max"}, block).collect()
    for r in sums:
        before = by_key(data)[r.k][: r._b * block]
        assert (r.s, r.m) == ((sum(o for o, _ in before), max(v for _, v in before)) if before else (None, None))


def telemetry(spark, n: int = 700):
    rng = random.Random(5)
    return [(i % 3 if i % 3 else 0, 0, 1e9 + rng.uniform(0, 1)) for i in range(n)]


@pytest.mark.parametrize("block", [200, 256, 1 << 16])
def test_trends_of_large_values(spark, block):
    data: dict = {}
    for run, _, v in telemetry(spark):
        data.setdefault(run, []).append(v)
    df = spark.createDataFrame([(r, i + 1, v) for r, own in data.items() for i, v in enumerate(own)], "run long, step int, value double")
    for row in T.rolling_trend(df, 40, 10, 1e9, block).collect():
        own = data[row.run][max(0, row.step - 40) : row.step]
        n, k = len(own), len(own) // 2
        want = 0.0 if n < 10 else (sum(own[k:]) / (n - k) - sum(own[:k]) / k) / (abs(sum(own) / n) + 1e-8)
        assert abs(row.trend - want) < 1e-13
    with pytest.raises(ValueError):
        T.rolling_trend(df, 40, block=39)


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_records_regions_gaps(spark, block):
    rng = random.Random(8)
    data = [(i % 2, i // 2 + 1, float(rng.randrange(50))) for i in range(120)]
    df = spark.createDataFrame(data, "run long, step int, value double")
    best, peak, energy = set(), {}, {}
    for run, step, v in sorted(data):
        if run not in peak or v > peak[run]:
            best.add((run, step))
        peak[run], energy[run] = max(peak.get(run, v), v), energy.get(run, 0.0) + v / 3600
        peak[run, step], energy[run, step] = peak[run], energy[run]
    assert {(r.run, r.step) for r in T.best_checkpoints(df, "value", F.lit(True), block).collect()} == best
    for r in T.running(df, block).collect():
        assert r.peak == peak[r.run, r.step] and abs(r.energy - energy[r.run, r.step]) < 1e-12
    kept = df.where("value > 20")
    steps = sorted((r.run, r.step) for r in kept.collect())
    want = {(a, s, t) for (a, s), (b, t) in zip(steps, steps[1:], strict=False) if a == b and t - s > 1}
    assert {(r.run, r["at"], r.to) for r in T.gaps(kept, "run", "step", block).collect()} == want
    covered = {(r.run, s) for r in T.regions(df, F.col("value") > 20).collect() for s in range(r.start, r.end)}
    assert covered == set(steps)


def test_context_at_the_edges_and_in_a_null_key(spark):
    data = [("a", i, f"a{i}") for i in range(4)] + [(None, 9, "n9"), (None, 10, "n10"), ("b", 20, "b20")]
    df = spark.createDataFrame(data, "scene string, scan long, path string")
    got = {r.scan: (r.before, r.after) for r in ranking.with_context(df, df.where("scan in (0, 2, 10, 20)"), 2).collect()}
    assert got == {0: ([], ["a1", "a2"]), 2: (["a0", "a1"], ["a3"]), 10: (["n9"], []), 20: ([], [])}

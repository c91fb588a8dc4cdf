"""Keyed streaming state: restarts on a checkpoint, shards, and what leaves the state."""

import random

from pyspark.sql import functions as F

from pelagia.streaming import incremental, keyed

SCHEMA = "k string, t long, v double"


def rows(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    return [("hot" if i % 3 == 0 else None if i % 20 == 1 else f"k{rng.randrange(4)}", seed * 1000 + i, None if i % 17 == 0 else round(rng.uniform(-9, 9), 2)) for i in range(n)]


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_best_and_peaks_go_on_where_they_ended(spark, tmp_path):
    path, seen = f"{tmp_path}/in", []
    for turn in (1, 2):
        more = rows(turn, 90)
        seen += more
        spark.createDataFrame(more, SCHEMA).repartition(2).write.mode("append").parquet(path)
        top = keyed.best(stream(spark, path).where("v is not null"), [], ["v", "t"], [True, False], 7, f"file://{tmp_path}/top")
        assert [(r.v, r.t) for r in top.collect()] == [(v, t) for _, t, v in sorted((r for r in seen if r[2] is not None), key=lambda r: (-r[2], r[1]))][:7]
        last = keyed.best(stream(spark, path), ["k"], ["t"], [True], 5, f"file://{tmp_path}/last", shards=3)
        want = {k: sorted((t for q, t, _ in seen if q == k), reverse=True)[:5] for k in {r[0] for r in seen}}
        got: dict = {}
        for r in last.collect():
            got.setdefault(r.k, []).append(r.t)
        assert {k: sorted(v, reverse=True) for k, v in got.items()} == want
        found = {r.k: (r.peak, round(r.total, 6), r.n) for r in keyed.peaks(stream(spark, path), "k", "v", f"file://{tmp_path}/peaks").collect()}
        for k in want:
            values = [v for q, _, v in seen if q == k and v is not None]
            assert found[k] == (max(values), round(sum(values), 6), sum(q == k for q, _, _ in seen))
    # what lost has left the state: at most n rows a shard
    held = keyed._known(spark, f"file://{tmp_path}/last", "best").groupBy("key").count()
    assert held.agg(F.max("count")).first()[0] <= 5


def test_an_empty_stream(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    assert keyed.best(stream(spark, f"{tmp_path}/in"), [], ["t"], [True], 3, f"file://{tmp_path}/c").collect() == []


def test_states_of_old_batches_go(spark, tmp_path):
    path = f"{tmp_path}/in"
    spark.createDataFrame([(i,) for i in range(40)], "n long").repartition(8).write.parquet(path)
    found = incremental.indexed(spark.readStream.schema("n long").option("maxFilesPerTrigger", 2).parquet(path), "n").collect()
    assert sorted(r.i for r in found) == list(range(40)) and len({r.n for r in found}) == 40


def test_sums_are_an_aggregate_and_a_hot_key_is_cut_before_it_is_exchanged(spark, tmp_path):
    df = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i, float(i)) for i in range(3000)], SCHEMA).coalesce(1)
    kept = keyed._first_rows(df, ["k"], ["t"], [True], 5).collect()
    assert len(kept) == 40 and sorted(r.t for r in kept if r.k == "hot") == [2993, 2995, 2996, 2998, 2999][-5:]
    df.write.parquet(f"{tmp_path}/in")
    before = spark.conf.get(keyed.PROVIDER, None)
    found = {r.k: (r.peak, r.total, r.n) for r in keyed.peaks(stream(spark, f"{tmp_path}/in"), "k", "v", f"file://{tmp_path}/p").collect()}
    assert found["hot"] == (2999.0, float(sum(i for i in range(3000) if i % 3)), 2000) and len(found) == 8
    assert spark.conf.get(keyed.PROVIDER, None) == before and not hasattr(keyed, "Peaks")
    # one state for each key, not one for each shard of it
    keyed.best(stream(spark, f"{tmp_path}/in"), ["k"], ["t"], [True], 5, f"file://{tmp_path}/b").collect()
    assert keyed._known(spark, f"file://{tmp_path}/b", "best").groupBy("key").count().count() == 8

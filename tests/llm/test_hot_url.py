"""One URL in a third of all rows, with more windows than are broadcast: the same scores and verdicts."""

import math
import random

from pyspark.sql import functions as F

from pelagia.llm import urlfilter


def test_a_hot_url_beyond_the_broadcast(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))
    rows = [(i, "http://hot.example/very/common/path" if i % 3 == 0 else f"http://{word()}.{'zz' if i % 2 else 'com'}/{word()}", bool(i % 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean").repartition(4)
    want = {r.page_id: (r.score, r.verdict) for r in urlfilter.filter_urls(df, rules=(), labels="bad").collect()}
    monkeypatch.setattr(urlfilter, "HOT", 20)
    found = urlfilter.filter_urls(df, rules=(), labels="bad")
    got = {r.page_id: (r.score, r.verdict) for r in found.collect()}
    assert set(got) == set(want) == set(range(600))
    assert all(math.isclose(got[k][0], want[k][0], abs_tol=1e-9) and got[k][1] == want[k][1] for k in want)
    assert len({got[i] for i in range(0, 600, 3)}) == 1
    # the verdict is the score against the threshold, for each URL with a host and no rule
    for r in found.where(F.col("rule").isNull()).collect():
        assert r.verdict == ("block" if r.score > r.threshold else "allow")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 0, "the sums are a table of their own"

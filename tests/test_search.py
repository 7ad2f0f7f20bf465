"""Trials side by side: order, errors, halving."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from journeyspark.operators import splits
from journeyspark.plans import models, search


def table(spark, n=400):
    r = np.random.default_rng(6)
    y = r.integers(0, 3, n)
    x = r.normal(size=(n, 4)) + np.eye(4)[y] * 1.5
    df = spark.createDataFrame([(i, str(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id bigint, y string, v array<double>")
    p = splits.three_way(df, "y", "id")
    return p.where("part = 'train'").drop("part"), p.where("part = 'val'").drop("part")


def test_results_keep_their_order_and_overlap(spark):
    running, most, lock = [0], [0], threading.Lock()

    def work(i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.3)
        n = spark.range(i + 1).count()
        with lock:
            running[0] -= 1
        return n

    assert search.side_by_side(spark, [lambda i=i: work(i) for i in range(8)], 4) == list(range(1, 9)) and most[0] == 4


def test_an_error_ends_the_others(spark):
    start = time.time()
    slow = lambda: spark.range(10**13).selectExpr("sum(sqrt(id))").collect()

    def broken():
        time.sleep(1)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost|cancelled"):
        search.side_by_side(spark, [slow, broken], 2)
    assert time.time() - start < 60


def test_wide_errors_are_no_results(spark, monkeypatch):
    train, val = table(spark, 60)
    assert models.unfit(ValueError("x")) and models.unfit(Exception("requirement failed: no")) and not models.unfit(Exception("ExecutorLostFailure")) and not models.unfit(OSError("No space left on device"))
    monkeypatch.setattr(models, "fit", lambda c, t: (_ for _ in ()).throw(RuntimeError("ExecutorLostFailure")))
    with pytest.raises(RuntimeError, match="ExecutorLost"):
        search.evaluate([models.ROSTER["naive_bayes"]], train, val)
    with pytest.raises(RuntimeError, match="ExecutorLost"):
        models.cross_validate(models.ROSTER["naive_bayes"], train, 2)


def test_the_exhaustive_winner_is_a_finalist(spark):
    train, val = table(spark)
    grid = [search.forest(numTrees=t, maxDepth=d) for t, d in ((1, 1), (2, 1), (1, 2), (20, 4), (30, 6), (40, 6))]
    every = search.evaluate(grid, train, val)
    won = max(every, key=lambda r: r["f1_macro"])
    got = search.halving(grid, train, val, shares=(0.4, 1.0), keep=0.5)
    finalists = [r for r in got if r["share"] == 1.0]
    assert len(got) == 6 and len(finalists) == 3 and won["name"] in {r["name"] for r in finalists}
    assert [r["f1_macro"] for r in finalists] == sorted((r["f1_macro"] for r in finalists), reverse=True)
    with pytest.raises(ValueError, match="all rows"):
        search.halving(grid, train, val, shares=(0.5,))


def test_shares_hold_each_other(spark):
    seen = []
    train = spark.range(3000).select("id", F.lit("a").alias("y"), F.array(F.lit(1.0)).alias("v"))
    real = search.evaluate
    try:
        search.evaluate = lambda live, rows, val, threads: seen.append({r.id for r in rows.collect()}) or [{"name": str(i), "error": None, "f1_macro": float(i)} for i in range(len(live))]
        got = search.halving(list("abcdef"), train, train, shares=(0.1, 0.3, 1.0))
    finally:
        search.evaluate = real
    assert seen[0] < seen[1] < seen[2] and len(seen[2]) == 3000 and 200 < len(seen[0]) < 400 and len(got) == 6

"""Principal components from merged co-moments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from journeyspark.operators import components


def frame(spark, x, parts):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>").repartition(parts)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_components_by_brute_force(spark, parts):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 5)) @ r.normal(size=(5, 5)) + 1e6
    got = components.principal_components(frame(spark, x, parts))
    e, q = np.linalg.eigh(np.cov(x.T))
    assert got.n == 60 and np.allclose(got.variances, e[::-1], rtol=1e-8)
    assert np.allclose(np.abs((q[:, ::-1] * got.axes).sum(0)), 1, atol=1e-6) and (got.axes[np.abs(got.axes).argmax(0), range(5)] > 0).all()
    p = {r.id: r.p for r in components.apply_components(frame(spark, x, parts), got).collect()}
    assert np.allclose([p[i] for i in range(60)], (x - x.mean(0)) @ got.axes)
    assert got.shares.sum() == pytest.approx(1)


def test_merging_is_the_same_in_any_order():
    r = np.random.default_rng(5)
    parts = [components._own(r.normal(size=(n, 3)) + n) for n in (1, 2, 7, 30)]
    one = two = None
    for m in parts:
        one = components.merged(one, m)
    for m in reversed(parts):
        two = components.merged(two, m)
    assert one[0] == two[0] == 40 and all(np.allclose(a, b) for a, b in zip(one[1:], two[1:], strict=True))


def test_edges(spark):
    with pytest.raises(ValueError, match="no rows"):
        components.principal_components(frame(spark, np.zeros((0, 2)), 1))
    one = components.principal_components(frame(spark, np.array([[1.0, 2.0]]), 1))
    assert one.n == 1 and one.variances.tolist() == [0, 0] and one.shares.tolist() == [0, 0]
    flat = frame(spark, np.ones((9, 2)), 3)
    assert all(r.p == [0, 0] for r in components.apply_components(flat, components.principal_components(flat)).collect())
    gaps = flat.withColumn("v", F.when(F.col("id") > 0, F.col("v")))
    assert components.co_moments(gaps)[0] == 8


def test_ten_runs_agree(spark):
    x = np.random.default_rng(1).normal(size=(200, 64))
    runs = [components.principal_components(frame(spark, x, 4), 2) for _ in range(10)]
    assert all(np.allclose(r.axes, runs[0].axes, atol=1e-9) for r in runs)

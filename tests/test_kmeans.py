"""k-means side by side and density summaries at many radii."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from journeyspark.operators import cluster, kmeans


def frame(spark, x, parts=3):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>").repartition(parts)


def blobs(seed=0, n=40):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(c, 0.4, (n, 2)) for c in ((0, 0), (6, 0), (0, 6), (6, 6))])


def test_sums_by_brute_force(spark):
    x, c = blobs(), [np.array([[0.0, 0.0], [5.0, 5.0]]), np.array([[1.0, 1.0], [9.0, 9.0], [1.0, 1.0]])]
    got = {(r.m, r.label): r for r in kmeans.assignment_sums(frame(spark, x), c).collect()}
    for m, centres in enumerate(c):
        d = ((x[:, None] - centres) ** 2).sum(2)
        near = d.argmin(1)
        for j in range(len(centres)):
            on = near == j
            assert got[m, j].n == on.sum() and got[m, j].cost == pytest.approx(d[on, j].sum()) and np.allclose(got[m, j].total, x[on].sum(0))


def test_every_start_settles_where_lloyd_does(spark):
    x = blobs(3)
    df = frame(spark, x)
    models = kmeans.fit_many(df, [(k, s) for k in (2, 4) for s in range(3)], rounds=30)
    for m in models:
        near = ((x[:, None] - m.centres) ** 2).sum(2).argmin(1)
        assert np.allclose(m.centres, [x[near == j].mean(0) for j in range(m.k)], atol=1e-3) and m.settled
    best = kmeans.best_of(models)[4]
    labels = {r.id: r.labels[0] for r in kmeans.labelled(df, [best]).collect()}
    groups = [{labels[i] for i in range(lo, lo + 40)} for lo in range(0, 160, 40)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4


def test_partitions_and_edges(spark):
    x = blobs(5)
    one, two = (kmeans.fit_many(frame(spark, x, n), [(3, 1)])[0] for n in (1, 7))
    assert np.allclose(one.centres, two.centres)
    few = kmeans.fit_many(frame(spark, np.ones((6, 2)), 2), [(3, 0)])[0]
    assert len(few.centres) == 1 and few.cost == 0
    with pytest.raises(ValueError, match="no rows"):
        kmeans.fit_many(frame(spark, np.zeros((0, 2)), 1), [(2, 0)])


def test_probe_measures_as_the_measures_do(spark):
    df = frame(spark, blobs(1, 15))
    probe = {r.k: r for r in cluster.k_probe(df, (2, 4)).collect()}
    for k in (2, 4):
        best = kmeans.best_of(kmeans.fit_many(df, [(k, s) for s in range(3)]))
        lab = df.join(kmeans.labelled(df, [best[k]]).select("id", F.col("labels")[0].alias("label")), "id")
        assert probe[k].silhouette == pytest.approx(cluster.silhouette(lab).first()[0])
        assert probe[k].davies_bouldin == pytest.approx(cluster.davies_bouldin(lab).first()[0])
        assert probe[k].calinski_harabasz == pytest.approx(cluster.calinski_harabasz(lab).first()[0])
    assert probe[4].silhouette > 0.7 > probe[2].silhouette


def test_density_summaries_are_those_of_each_radius(spark):
    r = np.random.default_rng(2)
    x = np.vstack([blobs(2, 20), r.uniform(-3, 9, (30, 2)), [[0.0, 0.0]] * 6])
    df = frame(spark, x)
    radii = [0.2, 0.5, 1.1]
    for got, eps in zip(cluster.density_summaries(df, radii, 5), radii, strict=True):
        want = cluster.dbscan_summary(cluster.dbscan(df, eps, 5)).first().asDict()
        assert {c: got[c] for c in want} == pytest.approx(want)

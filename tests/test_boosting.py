"""Boosted trees and calibrated probabilities: brute force, quality, storage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from journeyspark.functions import metrics
from journeyspark.functions.lineage import written
from journeyspark.operators import splits
from journeyspark.plans import boosting, calibration, models


def rings(n, seed=0):
    """Three classes that no single feature separates, and three features of noise."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2))
    y = np.digitize(np.hypot(*x.T), [0.8, 1.5])
    return np.hstack([x, r.normal(size=(n, 3))]), y


def frame(spark, x, y):
    return spark.createDataFrame([(i, str(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id bigint, y string, v array<double>")


def split_by_hand(x, g, h, cuts, l2):
    best = (0.0, -1, 0)
    for f, c in enumerate(cuts):
        b = np.searchsorted(c, x[:, f], "left")
        for at in range(len(c)):
            left = b <= at
            gain = sum(g[m].sum() ** 2 / (h[m].sum() + l2) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + l2)
            if left.any() and (~left).any() and gain > best[0] + 1e-9:
                best = (gain, f, at)
    return best


def test_rounds_by_brute_force(spark):
    x, y = rings(150)
    rows = frame(spark, x, y).select(F.col("y").cast("int").alias("label"), "v").repartition(3)
    got = boosting.fit_trees(rows, 3, rounds=3, rate=0.5, depth=2, bins=8)
    scores = np.tile(np.log(np.bincount(y) / len(y)), (len(y), 1))
    assert np.allclose(got.base, scores[0])
    for t in range(3):
        p = boosting.softmax(scores)
        for k in range(3):
            g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])
            at = np.zeros(len(y), int)
            for level in range(2):
                nxt = at.copy()
                for node in range(1 << level):
                    m = at == node
                    inner = node + (1 << level) - 1
                    gain, f, cut = split_by_hand(x[m], g[m], h[m], got.cuts, 1.0)
                    assert (got.features[t][k, inner], got.bins[t][k, inner]) == (f, cut) or (f == -1 and got.features[t][k, inner] == -1)
                    nxt[m] = 2 * node + (np.searchsorted(got.cuts[f], x[m, f], "left") > cut if f >= 0 else 0)
                at = nxt
            want = np.array([-0.5 * g[at == n].sum() / (h[at == n].sum() + 1.0) for n in range(4)])
            assert np.allclose(got.leaves[t][k], want)
            scores[:, k] += want[at]
    assert np.allclose(got.scores(x), scores)


def test_about_as_good_as_a_forest(spark):
    x, y = rings(600, 1)
    parts = splits.holdout(frame(spark, x, y), "y", "id", 0.3)
    train, test = (written(parts.where(F.col("is_test") == t).drop("is_test"), "part") for t in (False, True))

    def f1(name):
        pred, labels = models.predict(models.fit(models.ROSTER[name], train), test)
        return metrics.bundle(written(pred, "pred"), labels).first()["f1_macro"]

    boosted = f1("boosted_trees")
    assert boosted >= f1("random_forest") - 0.02 and boosted > 0.8  # 180 rows: a row or three


def test_many_rounds_have_a_short_plan(spark, monkeypatch):
    """Sixty rounds, six of them with scores written anew; the last scan's plan is as long as the first's."""
    x, y = rings(40)
    rows = frame(spark, x[:, :2], y).select(F.col("y").cast("int").alias("label"), "v").coalesce(1)
    seen, real = [], boosting.best_splits

    def watched(sums, *args):
        seen.append(len(sums._jdf.queryExecution().logical().toString()) if len(seen) % 10 == 0 else 0)
        return real(sums, *args)

    monkeypatch.setattr(boosting, "best_splits", watched)
    got = boosting.fit_trees(rows, 3, rounds=60, depth=1, bins=4)
    sizes = [n for n in seen if n]
    assert len(got.leaves) == 60 and len(sizes) == 6 and max(sizes) < min(sizes) + 200
    assert (got.probabilities(x[:, :2]).argmax(1) == y).mean() > 0.6


def test_kept_as_tables(spark, tmp_path):
    x, y = rings(80)
    model = models.fit(models.Candidate("boosted", lambda k, n: boosting.BoostedTrees(rounds=2)), frame(spark, x, y))
    again = models.save(model, f"file://{tmp_path}/m")
    old, new = (sorted(map(tuple, models.predict(m, frame(spark, x, y))[0].select("id", "y_pred", "probs").collect())) for m in (model, again))
    assert old == new and again.stages[0].labels == ["0", "1", "2"]
    trees = boosting.tree_table(spark, again.stages[1].trees)
    assert trees.where("round >= 0").count() == 2 * 3 * 15 and trees.where("f >= 0 and cut is null").count() == 0


def test_constant_rows_and_lonely_classes(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0])] * 5 + [(2, [1.0, 2.0])], "label int, v array<double>")
    got = boosting.fit_trees(rows, 3, rounds=2, depth=2)
    assert all((f == -1).all() for f in got.features)
    p = got.probabilities(np.array([[1.0, 2.0]]))[0]
    assert p[0] > p[2] > p[1] and p.sum() == pytest.approx(1)


def test_pooling_by_brute_force():
    r = np.random.default_rng(3)
    for _ in range(50):
        n = r.integers(1, 9, 12)
        hits = r.integers(0, n + 1)
        want = [max(min(hits[j : k + 1].sum() / n[j : k + 1].sum() for k in range(i, 12)) for j in range(i + 1)) for i in range(12)]
        got = calibration.pooled(n, hits)
        assert np.allclose(got, want) and (np.diff(got) >= 0).all() and (got * n).sum() == pytest.approx(hits.sum())


def test_calibration_lowers_the_brier_score(spark):
    x, y = rings(900, 2)
    x = np.hstack([x, x[:, :2] ** 2, x[:, :2] ** 2])  # doubled features make the independent model too sure
    parts = splits.holdout(frame(spark, x, y), "y", "id", 0.4)
    train, test = (written(parts.where(F.col("is_test") == t).drop("is_test"), "part") for t in (False, True))
    model, fitted = calibration.fit_calibrated(models.ROSTER["naive_bayes"], train)
    pred, labels = models.predict(model, test)
    pred = written(pred, "pred")
    better = calibration.calibrate(pred, fitted)
    before, after = (calibration.brier(p, labels).first()["brier"] for p in (pred, better))
    assert after < before
    assert all(sum(r.probs) == pytest.approx(1) and min(r.probs) >= 0 for r in better.collect())


def test_unknown_buckets_and_empty_maps(spark):
    scored = spark.createDataFrame([(1, "a", [0.05, 0.95]), (2, "b", [0.5, 0.5]), (3, "a", [1.0, 0.0])], "id int, y_true string, probs array<double>")
    none = calibration.calibrate(scored, calibration.Isotonic(["a", "b"], {"a": ([], []), "b": ([], [])}))
    assert [r.probs for r in none.orderBy("id").collect()] == [[0.05, 0.95], [0.5, 0.5], [1.0, 0.0]]
    fitted = calibration.Isotonic(["a", "b"], {"a": ([2, 4, 8], [0.1, 0.2, 0.6]), "b": ([4], [0.3])}, 10)
    got = [r.probs for r in calibration.calibrate(scored, fitted).orderBy("id").collect()]
    assert np.allclose(got, [[0.25, 0.75], [0.4, 0.6], [2 / 3, 1 / 3]])  # buckets 0 (below the first), 5 and 9
    zeros = calibration.Isotonic(["a", "b"], {"a": ([0, 8], [0.0, 0.5]), "b": ([0], [0.0])}, 10)
    assert [r.probs for r in calibration.calibrate(scored, zeros).orderBy("id").collect()] == [[0.05, 0.95], [0.5, 0.5], [1.0, 0.0]]

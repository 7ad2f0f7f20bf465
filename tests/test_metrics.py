"""All measures in one row are those of the single measures."""

import numpy as np
import pytest

from journeyspark.functions import metrics


def test_bundle_is_the_single_measures(spark):
    r = np.random.default_rng(8)
    rows = [(i, str(r.integers(0, 4)), str(r.integers(0, 5)), r.dirichlet(np.ones(4)).round(1).tolist()) for i in range(120)] + [(120, "4", "0", [0.1, 0.2, 0.3, 0.4]), (121, "0", "0", None)]
    p = spark.createDataFrame(rows, "id int, y_true string, y_pred string, probs array<double>")
    labels = ["0", "1", "2", "3"]
    got = metrics.bundle(p, labels).first().asDict()
    for part in (metrics.accuracy(p), metrics.macro(p), metrics.weighted(p), metrics.balanced_accuracy(p), metrics.top_k_hits(p, labels), metrics.roc_auc(p, labels), metrics.pr_auc(p, labels)):
        for name, value in part.first().asDict().items():
            assert got.pop(name) == pytest.approx(value)
    assert not got and "roc_auc" not in metrics.bundle(p).columns
    hits = np.mean([t in labels and ps is not None and sum(q > ps[int(t)] or (q == ps[int(t)] and str(j) < t) for j, q in enumerate(ps)) < 3 for _, t, _, ps in rows])
    assert metrics.top_k_hits(p, labels).first().top_k == pytest.approx(hits)

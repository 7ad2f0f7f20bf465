"""Gradient boosting for several classes at once, on histograms.

Features are put into quantile bins once. A round grows one tree for each class: at every level a scan sums gradients and
curvatures of the softmax loss by (class, node, feature, bin), the sums meet in one `groupBy`, and each node's best split is a
running sum over its bins. What reaches the driver is a row for each node and class. Scores are written every few rounds and
newer trees travel with the scan, so the plan is as long in the last round as in the first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from journeyspark.functions.lineage import written
from journeyspark.functions.quantiles import MOST, exact_quantiles

#: Rounds between two writings of the scores.
STRIDE = 10
#: Gains that agree in so many decimals are equal, and the first feature and bin has it; sums come in any order.
DIGITS = 9
#: Rows of a batch that are scored at a time.
ROWS = 2048


@dataclass
class Trees:
    """Full trees of one depth for every round and class: feature (-1: none), bin, value of each inner node and leaf.

    A row goes right where its feature's bin is above the node's; cuts[f] are the values between the bins of feature f.
    """

    cuts: list[list[float]]
    base: list[float]
    depth: int
    features: list[np.ndarray] = field(default_factory=list)  # of each round: classes by inner nodes
    bins: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)  # classes by leaves

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], 1).astype(np.int64) if len(self.cuts) else np.zeros((len(x), 0), np.int64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return add_trees(np.tile(self.base, (len(x), 1)), self.binned(x), self.features, self.bins, self.leaves, self.depth)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.scores(x))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def nodes_of(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row and class after so many levels: 0, 1, … from the left."""
    at, k = np.zeros((len(x), len(feature)), np.int64), np.arange(len(feature))
    for level in range(levels):
        inner = at + (1 << level) - 1
        f = feature[k, inner]
        right = (f >= 0) & (np.take_along_axis(x, np.maximum(f, 0), 1) > cut[k, inner])
        at = 2 * at + right
    return at


def add_trees(scores: np.ndarray, x: np.ndarray, features, bins, leaves, depth: int) -> np.ndarray:
    """Scores with the leaves' values of some rounds added."""
    for f, b, v in zip(features, bins, leaves, strict=True):
        scores = scores + np.take_along_axis(v.T, nodes_of(x, f, b, depth), 0)
    return scores


def feature_cuts(rows: DataFrame, bins: int = 32, v: str = "v", most: int = MOST) -> list[list[float]]:
    """For each entry of v the different quantiles between bins of about equal size; a row is right of a cut if it is above."""
    long = rows.select(F.posexplode(F.col(v).cast("array<double>")).alias("f", "x"))
    got = exact_quantiles(long, ["f"], "x", [i / bins for i in range(1, bins)], most)
    cuts = got.groupBy("f").agg(F.array_sort(F.collect_set("value")).alias("cuts")).orderBy("f").collect()  # a row for each feature
    out: list[list[float]] = [[] for _ in range(max((r["f"] for r in cuts), default=-1) + 1)]
    for r in cuts:
        out[r["f"]] = r["cuts"]
    return out


def histograms(rows: DataFrame, trees: Trees, level: int = 0, feature: np.ndarray | None = None, cut: np.ndarray | None = None, since: int = 0) -> DataFrame:
    """(k, node, f, g, h): for each class, node and feature the sums of gradients and curvatures by bin (arrays of double).

    rows: (label, w, b, s), b the bins of a row and s its scores without the trees of rounds from `since` on. feature
    and cut are those of the round's own trees as far as they are grown.
    """
    k, d = len(trees.base), len(trees.cuts)
    width = max((len(c) for c in trees.cuts), default=0) + 1
    newer, depth, nodes = (trees.features[since:], trees.bins[since:], trees.leaves[since:]), trees.depth, 1 << level

    def summed(batches):
        g, h = np.zeros((k, nodes * d * width)), np.zeros((k, nodes * d * width))
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                label, w, x, s = _arrays(part, d, k)
                p = softmax(add_trees(s, x, *newer, depth))
                grad = (p - (label[:, None] == np.arange(k))) * w[:, None]
                curve = p * (1 - p) * w[:, None]
                at = nodes_of(x, feature, cut, level) if level else np.zeros((len(x), k), np.int64)
                place = np.arange(d) * width + x
                for c in range(k):
                    slot = (at[:, c, None] * (d * width) + place).ravel()
                    g[c] += np.bincount(slot, np.repeat(grad[:, c], d), nodes * d * width)
                    h[c] += np.bincount(slot, np.repeat(curve[:, c], d), nodes * d * width)
        g, h = g.reshape(-1, width), h.reshape(-1, width)
        rows = np.flatnonzero(h.any(1))
        c, node, f = np.unravel_index(rows, (k, nodes, d)) if len(rows) else (rows, rows, rows)
        lists = [pa.ListArray.from_arrays(np.arange(0, len(rows) * width + 1, width, dtype=np.int32), pa.array(a[rows].ravel())) for a in (g, h)]
        yield pa.RecordBatch.from_arrays([*(pa.array(a.astype(np.int32)) for a in (c, node, f)), *lists], names=["k", "node", "f", "g", "h"])

    parts = rows.select("label", "w", "b", "s").mapInArrow(summed, "k int, node int, f int, g array<double>, h array<double>")
    # Each task has summed its rows, so a group holds one list for each task.
    zeros = F.array_repeat(F.lit(0.0), width)
    total = lambda c: F.aggregate(F.collect_list(c), zeros, lambda a, x: F.zip_with(a, x, lambda u, v: u + v)).alias(c)
    return parts.groupBy("k", "node", "f").agg(total("g"), total("h"))


def _arrays(part: pa.RecordBatch, d: int, k: int):
    n = part.num_rows
    return np.asarray(part.column(0)), np.asarray(part.column(1)), np.asarray(part.column(2).flatten(), np.int64).reshape(n, d), np.asarray(part.column(3).flatten()).reshape(n, k)


def best_splits(sums: DataFrame, l2: float = 1.0, least: float = 1e-3) -> DataFrame:
    """(k, node, f, bin, gain, gl, hl, gr, hr): the split of each node of most gain; ties go to the first feature and bin.

    The gain is that of Newton steps on both sides over one step on all; a side needs a curvature of `least`. A node
    without a gain has f = -1 and all on its left.
    """

    def of_feature(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g, h = (np.asarray(batch.column(i).flatten()).reshape(n, -1) for i in (3, 4))
            gt, ht = g.sum(1), h.sum(1)
            gl, hl = g.cumsum(1), h.cumsum(1)
            gr, hr = gt[:, None] - gl, ht[:, None] - hl
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (gt**2 / (ht + l2))[:, None]
            gain = np.where((hl >= least) & (hr >= least) & (gain > 1e-12) & (np.arange(g.shape[1]) < g.shape[1] - 1), gain, 0.0)
            at, i = np.round(gain, DIGITS).argmax(1), np.arange(n)
            on = gain[i, at] > 0
            cells = [(gain[i, at], 0.0), (gl[i, at], gt), (hl[i, at], ht), (gr[i, at], 0.0), (hr[i, at], 0.0)]
            f, b = np.where(on, np.asarray(batch.column(2)), -1), np.where(on, at, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f.astype(np.int32)), pa.array(b.astype(np.int32)), *[pa.array(np.where(on, x, y)) for x, y in cells]], names=names)

    names = ["k", "node", "f", "bin", "gain", "gl", "hl", "gr", "hr"]
    each = sums.select("k", "node", "f", "g", "h").mapInArrow(of_feature, "k int, node int, f int, bin int, gain double, gl double, hl double, gr double, hr double")
    best = F.max_by(F.struct(*names[2:]), F.struct(F.round("gain", DIGITS), (-F.col("f")).alias("nf"))).alias("s")
    return each.groupBy("k", "node").agg(best).select("k", "node", "s.*")


def prepared(rows: DataFrame, trees: Trees, label: str = "label", weight: str | None = None, v: str = "v") -> DataFrame:
    """(label, w, b, s): bins and first scores of rows, written."""
    cuts, base = trees, np.array(trees.base)

    def put(batches):
        for batch in batches:
            x = np.asarray(batch.column(2).flatten(), float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(cuts.cuts)))
            b, s = cuts.binned(x), np.tile(base, len(x))
            lists = [pa.ListArray.from_arrays(np.arange(0, len(x) * n + 1, n, dtype=np.int32) if n else np.zeros(len(x) + 1, np.int32), pa.array(a)) for n, a in ((b.shape[1], b.ravel().astype(np.int16)), (len(base), s))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["label", "w", "b", "s"])

    src = rows.select(F.col(label).cast("int").alias("label"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.col(v).cast("array<double>").alias("v"))
    return written(src.mapInArrow(put, "label int, w double, b array<smallint>, s array<double>"), "boost-rows")


def _rescored(rows: DataFrame, trees: Trees, since: int) -> DataFrame:
    k, d = len(trees.base), len(trees.cuts)
    newer, depth = (trees.features[since:], trees.bins[since:], trees.leaves[since:]), trees.depth

    def put(batches):
        for batch in batches:
            _, _, x, s = _arrays(batch, d, k)
            s = add_trees(s, x, *newer, depth)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(np.arange(0, s.size + 1, k, dtype=np.int32), s.ravel())], names=["label", "w", "b", "s"])

    return written(rows.mapInArrow(put, "label int, w double, b array<smallint>, s array<double>"), "boost-rows")


def first_trees(rows: DataFrame, classes: int, bins: int = 32, depth: int = 3, label: str = "label", weight: str | None = None, v: str = "v") -> Trees:
    """No rounds yet: cuts of the features, and the logarithms of the classes' shares as first scores."""
    n = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("int")).agg(F.sum(weight) if weight else F.count("*")).collect()}  # a row for each class
    total = sum(n.values()) or 1.0
    return Trees(feature_cuts(rows, bins, v), [float(np.log(max(n.get(c, 0), 1e-9) / total)) for c in range(classes)], depth)


def fit_trees(rows: DataFrame, classes: int, rounds: int = 200, rate: float = 0.1, depth: int = 3, bins: int = 32, l2: float = 1.0, least: float = 1e-3, label: str = "label", weight: str | None = None, v: str = "v") -> Trees:
    """Rows (label 0 to classes - 1, v) to trees. bins: up to so many for each feature, 32 000 at most."""
    trees = first_trees(rows, classes, bins, depth, label, weight, v)
    data, since = prepared(rows, trees, label, weight, v), 0
    for turn in range(rounds):
        feature, cut = np.full((classes, (1 << depth) - 1), -1, np.int64), np.zeros((classes, (1 << depth) - 1), np.int64)
        leaf = np.zeros((classes, 1 << depth))
        for level in range(depth):
            for r in best_splits(histograms(data, trees, level, feature, cut, since), l2, least).collect():  # a row for each class and node
                at = r["node"] + (1 << level) - 1
                feature[r["k"], at], cut[r["k"], at] = r["f"], r["bin"]
                if level == depth - 1:
                    leaf[r["k"], 2 * r["node"]], leaf[r["k"], 2 * r["node"] + 1] = (-rate * g / (h + l2) for g, h in ((r["gl"], r["hl"]), (r["gr"], r["hr"])))
        trees.features.append(feature)
        trees.bins.append(cut)
        trees.leaves.append(leaf)
        if (turn + 1) % STRIDE == 0 and turn + 1 < rounds:
            data, since = _rescored(data, trees, since), turn + 1
    return trees


def tree_table(spark: SparkSession, trees: Trees) -> DataFrame:
    """(round, k, node, f, bin, cut, value): inner nodes from 0 by level, then leaves with their values; round -1 holds the first scores."""
    rows = [(-1, k, 0, None, None, None, float(b)) for k, b in enumerate(trees.base)]
    inner = (1 << trees.depth) - 1
    for t, (f, b, v) in enumerate(zip(trees.features, trees.bins, trees.leaves, strict=True)):
        for k in range(len(trees.base)):
            rows += [(t, k, i, int(f[k, i]), int(b[k, i]), trees.cuts[f[k, i]][b[k, i]] if f[k, i] >= 0 else None, None) for i in range(inner)]
            rows += [(t, k, inner + i, None, None, None, float(v[k, i])) for i in range(inner + 1)]
    return spark.createDataFrame(rows, "round int, k int, node int, f int, bin int, cut double, value double")


def trees_of(nodes: DataFrame, cuts: DataFrame) -> Trees:
    """The way back from `tree_table` and (f, cuts)."""
    own = cuts.orderBy("f").collect()
    rows = nodes.orderBy("round", "k", "node").collect()
    base = [r["value"] for r in rows if r["round"] < 0]
    k = len(base)
    rest = [r for r in rows if r["round"] >= 0]
    per = max((r["node"] for r in rest), default=0) + 1
    inner = (per - 1) // 2
    out = Trees([list(r["cuts"]) for r in own], base, (inner + 1).bit_length() - 1)
    for lo in range(0, len(rest), k * per):
        part = [rest[lo + i * per : lo + (i + 1) * per] for i in range(k)]
        out.features.append(np.array([[r["f"] for r in p[:inner]] for p in part], np.int64).reshape(k, inner))
        out.bins.append(np.array([[r["bin"] for r in p[:inner]] for p in part], np.int64).reshape(k, inner))
        out.leaves.append(np.array([[r["value"] for r in p[inner:]] for p in part]))
    return out


class BoostedTreesModel(Model, MLWritable, MLReadable):
    """Adds probability (vector) and prediction (double) to rows with features; works on streams."""

    def __init__(self, trees: Trees | None = None):
        super().__init__()
        self.trees = trees

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees = self.trees

        @F.pandas_udf("array<double>")
        def scored(v):
            import pandas as pd

            x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, len(trees.cuts)))
            return pd.Series(list(trees.probabilities(np.asarray(x, float))))

        p = scored(vector_to_array("features"))
        out = dataset.withColumn("_p", p)
        return out.withColumn("probability", array_to_vector("_p")).withColumn("prediction", (F.array_position("_p", F.array_max("_p")) - 1).cast("double")).drop("_p")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: BoostedTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        spark = SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        tree_table(spark, self.model.trees).write.parquet(f"{path}/trees")
        spark.createDataFrame(list(enumerate(self.model.trees.cuts)), "f int, cuts array<double>").write.parquet(f"{path}/cuts")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> BoostedTreesModel:
        spark = SparkSession.getActiveSession()
        told = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls(trees_of(spark.read.parquet(f"{path}/trees"), spark.read.parquet(f"{path}/cuts")))
        model._resetUid(told["uid"])
        return model


class BoostedTrees(Estimator):
    """`fit_trees` as an estimator over (features, label[, weight])."""

    def __init__(self, rounds: int = 200, rate: float = 0.1, depth: int = 3, bins: int = 32, l2: float = 1.0, weight: str | None = None):
        super().__init__()
        self.settings = {"rounds": rounds, "rate": rate, "depth": depth, "bins": bins, "l2": l2, "weight": weight}

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        rows = dataset.withColumn("v", vector_to_array("features"))
        classes = int(rows.agg(F.max("label")).first()[0] or 0) + 1
        return BoostedTreesModel(fit_trees(rows, classes, **self.settings))

"""Probabilities from scores: isotonic regression by pooling, cross-fitted, for one class against the rest at a time.

Scores are counted in fine buckets, which merge across partitions as any sum does; neighbours that fall are then pooled
within each class (a bounded number of buckets), and new scores look their bucket up. The map is made from scores of
rows that the model has not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from journeyspark.functions.lineage import written
from journeyspark.operators import splits

from . import models

#: Scores from 0 to 1 are counted in so many buckets.
BUCKETS = 4096


def bucket(p: Column, buckets: int = BUCKETS) -> Column:
    return F.least(F.floor(F.greatest(p, F.lit(0.0)) * buckets), F.lit(buckets - 1)).cast("int")


def score_buckets(scored: DataFrame, labels: list, buckets: int = BUCKETS) -> DataFrame:
    """(label, bucket, n, hits) from (y_true, probs): how many scores of a class lie in a bucket, and how many are of that class. Null probabilities take no part."""
    long = scored.select("y_true", F.posexplode("probs").alias("i", "p")).where("p is not null and not isnan(p)")
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("i") + 1)
    return long.groupBy(label.alias("label"), bucket(F.col("p"), buckets).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("y_true") == label).alias("hits"))


def pooled(n: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to hits / n (squares weighted by n): falling neighbours become their common mean."""
    size, total, width = [], [], []
    for a, b in zip(n.tolist(), hits.tolist(), strict=True):
        size.append(a)
        total.append(b)
        width.append(1)
        while len(size) > 1 and total[-2] * size[-1] >= total[-1] * size[-2]:
            for held in (size, total, width):
                last = held.pop()
                held[-1] += last
    return np.repeat(np.array(total, float) / np.array(size, float), width)


def fit_isotonic(counts: DataFrame) -> DataFrame:
    """(label, bucket, n, hits, value) from (label, bucket, n, hits): a task takes one class's buckets."""
    kind = counts.schema["label"].dataType.simpleString()

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        return pdf.assign(value=pooled(pdf["n"].to_numpy(), pdf["hits"].to_numpy()))[["label", "bucket", "n", "hits", "value"]]

    return counts.groupBy("label").applyInPandas(pool, f"label {kind}, bucket int, n bigint, hits bigint, value double")


@dataclass
class Isotonic:
    """steps[label]: bucket edges and values; a score takes the value of the last known bucket at or below its own, or the first."""

    labels: list
    steps: dict
    buckets: int = BUCKETS


def isotonic(fitted: DataFrame, labels: list, buckets: int = BUCKETS) -> Isotonic:
    """A fit as a small object: where its values change, at most `buckets` numbers for each class."""
    rows = fitted.select("label", "bucket", "value").orderBy("label", "bucket").collect()
    steps: dict = {x: ([], []) for x in labels}
    for r in rows:
        at, values = steps[r["label"]]
        if not values or values[-1] != r["value"]:
            at.append(r["bucket"])
            values.append(r["value"])
    return Isotonic(labels, steps, buckets)


def calibrate(scored: DataFrame, fitted: Isotonic) -> DataFrame:
    """scored with its probs mapped and made to sum to 1; where all are mapped to 0, the scores stay. Works on streams."""
    out = F.array()
    for i, label in enumerate(fitted.labels):
        at, values = fitted.steps[label]
        own = bucket(F.col("probs")[i], fitted.buckets)
        if not at:
            out = F.concat(out, F.array(F.col("probs")[i]))
            continue
        place = F.greatest(F.array_size(F.filter(F.array(*map(F.lit, at)), _up_to(own))), F.lit(1))
        out = F.concat(out, F.array(F.element_at(F.array(*map(F.lit, values)), place)))
    total = F.aggregate("_c", F.lit(0.0), lambda a, b: a + b)
    mapped = scored.withColumn("_c", out).withColumn("probs", F.when(total > 0, F.transform("_c", lambda x: x / total)).otherwise(F.col("probs")))
    return mapped.drop("_c")


def _up_to(own: Column):
    return lambda x: x <= own


def brier(scored: DataFrame, labels: list) -> DataFrame:
    """(brier): the mean over rows of the summed squares of probability less truth."""
    label = F.array(*[F.lit(x) for x in labels])
    gap = F.transform(F.arrays_zip("probs", label.alias("label")), lambda c: F.pow(c["probs"] - (c["label"] == F.col("y_true")).cast("double"), 2))
    return scored.agg(F.avg(F.aggregate(gap, F.lit(0.0), lambda a, b: a + b)).alias("brier"))


def fit_calibrated(candidate: models.Candidate, rows: DataFrame, k: int = 3, seed: int = 1, buckets: int = BUCKETS) -> tuple[PipelineModel, Isotonic]:
    """The candidate fitted on all rows (id, y, v), and the map from scores of k models on the rows they were not fitted on."""
    dealt = written(splits.folds(rows, "y", "id", k, seed), "folds")
    counts, labels = None, None
    for f in range(k):
        rest, own = dealt.where(F.col("fold") != f).drop("fold"), dealt.where(F.col("fold") == f).drop("fold")
        if own.isEmpty():
            continue
        pred, known = models.predict(models.fit(candidate, rest), own)
        if labels is not None and known != labels:
            raise ValueError("a fold lacks a class; drop rare classes first")
        labels = known
        part = written(score_buckets(pred, known, buckets), "score-buckets")
        counts = part if counts is None else counts.unionByName(part)
    merged = counts.groupBy("label", "bucket").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return models.fit(candidate, rows), isotonic(fit_isotonic(merged), labels, buckets)

"""Next touch by backed-off transitions: shares of what followed the last two, the last one, or anything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit(train: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts (step3, step2, target, c2), (step2, target, c1), (target, c0) of training rows (step2, step3, target)."""
    return (
        train.groupBy("step3", "step2", "target").agg(F.count("*").alias("c2")),
        train.groupBy("step2", "target").agg(F.count("*").alias("c1")),
        train.groupBy("target").agg(F.count("*").alias("c0")),
    )


def score(rows: DataFrame, fitted, alpha: float = 1.0, weight: float = 5.0) -> DataFrame:
    """(id, target, prob) for each row (id, step2, step3) and each known class: each level adds `weight` times the shorter one's share to its counts.

    Shares are worked out once for each different (step3, step2), not for each row; rows then take their list. Spark decides by
    size which counts to broadcast.
    """
    two, one, none = fitted
    k = F.count("*").over(Window.partitionBy())
    base = none.withColumn("p0", (F.col("c0") + alpha) / (F.sum("c0").over(Window.partitionBy()) + alpha * k)).select("target", "p0")
    all1 = one.groupBy("step2").agg(F.sum("c1").alias("n1"))
    all2 = two.groupBy("step3", "step2").agg(F.sum("c2").alias("n2"))
    pairs = rows.select("step3", "step2").distinct()
    grid = pairs.crossJoin(base)  # different pairs of steps, and classes
    grid = grid.join(one, ["step2", "target"], "left").join(all1, "step2", "left").join(two, ["step3", "step2", "target"], "left").join(all2, ["step3", "step2"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    p1 = (zero("c1") + weight * F.col("p0")) / (zero("n1") + weight)
    shares = grid.withColumn("p1", p1).select("step3", "step2", F.struct("target", ((zero("c2") + weight * F.col("p1")) / (zero("n2") + weight)).alias("prob")).alias("s"))
    lists = shares.groupBy("step3", "step2").agg(F.collect_list("s").alias("all"))
    return rows.select("id", "step3", "step2").join(lists, ["step3", "step2"]).select("id", F.inline("all"))


def predictions(scored: DataFrame, truth: DataFrame) -> tuple[DataFrame, list]:
    """(id, y_true, y_pred, probs) and the classes in order."""
    labels = [r[0] for r in scored.select("target").distinct().orderBy("target").collect()]
    rows = scored.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("target", "prob"))), lambda s: s["prob"]).alias("probs"), F.min_by("target", F.struct(-F.col("prob"), F.col("target"))).alias("y_pred"))
    return rows.join(truth, "id").select("id", "y_true", "y_pred", "probs"), labels

"""Splits by class; every draw is a hash of the id, so a split never depends on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from journeyspark.functions.draws import uniform
from journeyspark.functions.order import place_in_class


def rare_classes(df: DataFrame, y: str, least: int = 6, folds: int = 5) -> DataFrame:
    """Class counts with `kept`: at least max(least, folds + 1) rows."""
    return df.groupBy(y).agg(F.count("*").alias("n")).withColumn("kept", F.col("n") >= max(least, folds + 1))


def drop_rare(df: DataFrame, y: str, least: int = 6, folds: int = 5) -> DataFrame:
    keep = rare_classes(df, y, least, folds).where("kept").select(y)
    return df.join(keep, y, "left_semi")


def _ranked(df: DataFrame, y: str, id_: str, seed: int, what: str) -> DataFrame:
    return place_in_class(df, y, uniform(seed, F.col(id_), what), id_)


def holdout(df: DataFrame, y: str, id_: str, share: float = 0.2, seed: int = 1) -> DataFrame:
    """Adds is_test: about `share` of each class, one row at least. A class too small for the share raises it to 1 / its size."""
    smallest = df.groupBy(y).count().agg(F.min("count")).first()[0] or 1
    share = 1.0 / smallest if smallest * share < 1 else share
    test = F.col("_rn") <= F.greatest(F.round(F.col("_n") * share), F.lit(1))
    return _ranked(df, y, id_, seed, "holdout").withColumn("is_test", test).drop("_n", "_rn")


def three_way(df: DataFrame, y: str, id_: str, shares=(0.7, 0.15), seed: int = 1) -> DataFrame:
    """Adds part: train, val or test, by class."""
    a, b = F.round(F.col("_n") * shares[0]), F.round(F.col("_n") * (shares[0] + shares[1]))
    part = F.when(F.col("_rn") <= a, "train").when(F.col("_rn") <= b, "val").otherwise("test")
    return _ranked(df, y, id_, seed, "parts").withColumn("part", part).drop("_n", "_rn")


def folds(df: DataFrame, y: str, id_: str, k: int = 5, seed: int = 1) -> DataFrame:
    """Adds fold (0..k-1), classes dealt out one after the other; k falls to the rarest class's size, 2 at least."""
    sizes = df.groupBy(y).agg(F.count("*").alias("_c"))
    smallest = sizes.agg(F.min("_c")).first()[0] or k
    k = max(2, min(k, smallest))
    start = sizes.withColumn("_off", F.coalesce(F.sum("_c").over(Window.orderBy(y).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(y, "_off")
    return _ranked(df, y, id_, seed, "folds").join(start, y).withColumn("fold", ((F.col("_off") + F.col("_rn") - 1) % k).cast("int")).drop("_n", "_rn", "_off")

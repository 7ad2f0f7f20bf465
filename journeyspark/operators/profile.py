"""Profiles of tables and clusters as result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from journeyspark.functions.quantiles import exact_quantiles


def profile_columns(df: DataFrame, columns, approx: bool = False) -> DataFrame:
    """(column, n, nulls, distinct, min, max, mean, std, p25, p50, p75) of numeric columns.

    Exact: equal values are counted first, before they are shuffled, and distinct counts and quantiles come from the counts.
    approx: one pass with sketches.
    """
    plain = lambda c, x: [F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(x.isNull()).alias("nulls"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")]
    sketch = lambda x: [F.approx_count_distinct(x).alias("distinct"), *[F.percentile_approx(x, p).alias(f"p{int(100 * p)}") for p in QUARTILES]]
    cells = [F.struct(*plain(c, F.col(c).cast("double")), *(sketch(F.col(c).cast("double")) if approx else [])) for c in columns]
    out = df.agg(F.array(*cells).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    if not approx:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.*")
        values = long.where("x is not null").groupBy("column", "x").agg(F.count("*").alias("m"))
        kinds = values.groupBy("column").agg(F.count("*").alias("distinct"))
        at = exact_quantiles(long, ["column"], "x", QUARTILES).groupBy("column").agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"p{int(100 * p)}") for i, p in enumerate(QUARTILES)])
        out = out.join(kinds, "column", "left").join(at, "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    return out.select("column", "n", "nulls", "distinct", "min", "max", "mean", "std", "p25", "p50", "p75")


QUARTILES = (0.25, 0.5, 0.75)


def cluster_describe(df: DataFrame, cluster: str, columns, approx: bool = False) -> DataFrame:
    """(cluster, column, n, mean, std, min, p50, max) for each cluster and column; the median is exact unless approx."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(cluster, F.explode(cells).alias("c")).select(cluster, "c.column", "c.x")
    plain = [F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")]
    out = long.groupBy(cluster, "column").agg(*plain, *([F.percentile_approx("x", 0.5).alias("p50")] if approx else []))
    if not approx:
        middle = exact_quantiles(long, [cluster, "column"], "x", [0.5]).select(F.col(cluster).alias("_k"), F.col("column").alias("_c"), F.col("value").alias("p50"))
        out = out.join(middle, F.col(cluster).eqNullSafe(F.col("_k")) & (F.col("column") == F.col("_c")), "left")
    return out.select(cluster, "column", "n", "mean", "std", "min", "p50", "max")


def cluster_counts(df: DataFrame, cluster: str, column: str) -> DataFrame:
    """(cluster, value, n, percent): how the values of a column are spread in each cluster."""
    n = df.groupBy(cluster, column).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(cluster)))


def named_clusters(df: DataFrame, cluster: str) -> DataFrame:
    """cluster_name: cluster_noise for -1, cluster_k else; write partitioned by it for one folder each."""
    return df.withColumn("cluster_name", F.when(F.col(cluster) == -1, "cluster_noise").otherwise(F.concat(F.lit("cluster_"), F.col(cluster).cast("string"))))


def segment_sizes(df: DataFrame, cluster: str) -> DataFrame:
    return df.where(F.col(cluster) >= 0).groupBy(cluster).agg(F.count("*").alias("n"))

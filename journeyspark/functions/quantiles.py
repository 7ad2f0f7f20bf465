"""Exact quantiles without a sort: numbers become integers of the same order, and each round reads 16 more of their bits.

A round counts the values that share a wanted prefix by their next 16 bits and keeps, for each wanted rank, the
prefix that holds it. After four rounds the prefix is the value. No task holds more than the counts of one prefix (65 536), whatever
the number of different values, and only values under wanted prefixes are read on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written

BITS, ROUNDS = 16, 4
#: So many different values a task may hold.
MOST = 1_000_000


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as longs of the same order; both zeros are one, NaN comes last."""
    b = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return b ^ ((b >> 63) & np.int64((1 << 63) - 1))


def from_bits(b: np.ndarray) -> np.ndarray:
    return (b ^ ((b >> 63) & np.int64((1 << 63) - 1))).view(np.float64)


def _to_bits(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ordered_bits(np.asarray(b.column(1), float)))], names=["k", "b"])


def _to_values(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(from_bits(np.asarray(b.column(2), np.int64)))], names=["k", "rank", "x"])


def _key(by: list[str]):
    """A group's values as one column; without any, all rows are a group."""
    return F.struct(*(by or [F.lit(0).alias("all")])).alias("k")


def order_statistics(df: DataFrame, by: list[str], x: str, ranks: DataFrame) -> DataFrame:
    """(k struct of by, rank, x): the value at each rank (k, rank; from 0) among the non-null values of its group."""
    kind = df.select(_key(by)).schema["k"].dataType.simpleString()
    keyed = df.where(F.col(x).isNotNull()).select(_key(by), F.col(x).cast("double").alias("x"))
    bits = written(keyed.mapInArrow(_to_bits, f"k {kind}, b bigint"), "quantile-bits")
    open_ = ranks.select("k", "rank", F.col("rank").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for i in range(ROUNDS):
        down = 64 - BITS * (i + 1)
        own = bits if i == 0 else bits.withColumn("prefix", F.shiftright("b", down + BITS)).join(open_.select("k", "prefix").distinct(), ["k", "prefix"], "left_semi")
        if i == ROUNDS // 2:
            bits = own = written(own, "quantile-bits")
        counts = own.groupBy("k", F.shiftright("b", down).alias("next")).agg(F.count("*").alias("c"))
        above = F.lit(0).cast("long") if i == 0 else F.shiftright("next", BITS)
        group = Window.partitionBy("k", "prefix")
        before = F.coalesce(F.sum("c").over(group.orderBy("next").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = counts.withColumn("prefix", above).select("k", "prefix", before.alias("at"), "next", F.lit(None).cast("long").alias("rank"))
        # The last start at or before a rank is its prefix's.
        asked = open_.select("k", "prefix", F.col("left").alias("at"), F.lit(None).cast("long").alias("next"), "rank")
        line = group.orderBy("at", F.col("rank").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        found = starts.unionByName(asked).withColumns({"to": F.last("next", ignorenulls=True).over(line), "start": F.last(F.when(F.col("rank").isNull(), F.col("at")), ignorenulls=True).over(line)})
        open_ = written(found.where("rank is not null").select("k", "rank", (F.col("at") - F.col("start")).alias("left"), F.col("to").alias("prefix")), "quantile-ranks")
    return open_.select("k", "rank", "prefix").mapInArrow(_to_values, f"k {kind}, rank bigint, x double")


def exact_quantiles(df: DataFrame, by: list[str], x: str, shares, most: int = MOST) -> DataFrame:
    """(by…, i, share, value): the quantile of x at each share (0 to 1) in each group, between neighbours as straight lines go.

    Nulls take no part; a group without values has no row. NaN is the largest value. Where all groups together have about
    `most` different values or fewer, a task takes a group's counts; beyond, the selection does. The result is the same.
    """
    values = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"))
    kinds = values.groupBy(*by).agg(F.approx_count_distinct("_x").alias("n")).agg(F.sum("n")).first()[0] or 0
    if kinds <= most:
        counts = values.groupBy(*by, "_x").agg(F.count("*").alias("_c"))
        q = counts.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile("_x", F.array(*[F.lit(float(s)) for s in shares]), F.col("_c")).alias("_q")).where("_n > 0")
        return q.select(*by, F.posexplode(F.arrays_zip(F.array(*[F.lit(float(s)) for s in shares]).alias("share"), F.col("_q").alias("value"))).alias("i", "_p")).select(*by, "i", F.col("_p.share").alias("share"), F.col("_p.value").alias("value"))
    return selected_quantiles(df, by, x, shares)


def selected_quantiles(df: DataFrame, by: list[str], x: str, shares) -> DataFrame:
    """`exact_quantiles` by selection, whatever the number of values."""
    n = df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.count("*").alias("n")).where("n > 0").select(_key(by), "n")
    at = F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("i", "share")
    place = F.col("share") * (F.col("n") - 1)
    wanted = n.select("k", "n", at).select("k", "i", "share", F.floor(place).alias("lo"), F.ceil(place).alias("hi"), (place - F.floor(place)).alias("part"))
    wanted = written(wanted, "quantile-wanted")
    ranks = wanted.select("k", F.explode(F.array("lo", "hi")).alias("rank")).distinct()
    got = written(order_statistics(df, by, x, ranks), "quantile-values")
    low, high = (got.select(F.col("k").alias(f"k_{s}"), F.col("rank").alias(f"r_{s}"), F.col("x").alias(f"x_{s}")) for s in ("lo", "hi"))
    out = wanted.join(low, (F.col("k") == F.col("k_lo")) & (F.col("lo") == F.col("r_lo"))).join(high, (F.col("k") == F.col("k_hi")) & (F.col("hi") == F.col("r_hi")))
    value = F.when(F.col("x_lo") == F.col("x_hi"), F.col("x_lo")).otherwise(F.col("x_lo") + (F.col("x_hi") - F.col("x_lo")) * F.col("part"))
    return out.select(*[F.col(f"k.{c}").alias(c) for c in by], "i", "share", value.alias("value"))


def column_quantiles(df: DataFrame, columns, shares, most: int = MOST) -> DataFrame:
    """(column, i, share, value) for several numeric columns at once."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.*")
    return exact_quantiles(long, ["column"], "x", shares, most)

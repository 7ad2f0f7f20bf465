"""Places in an order, without bringing a key's rows together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written


def numbered(df: DataFrame, order: str, name: str = "order") -> DataFrame:
    """df with _at: 0, 1, … by `order` over all rows. Ranges are numbered on their own, and what earlier ranges hold is added."""
    cut = written(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), name)
    held = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    starts = F.broadcast(held.select(F.col("_part").alias("_of"), before.alias("_before")))  # a row per range
    return cut.withColumn("_inside", inside).join(starts, F.col("_part") == F.col("_of")).select(*df.columns, (F.col("_before") + F.col("_inside")).alias("_at"))


def place_in_class(df: DataFrame, key: str | None, draw: Column, tie: str, slices: int = 256) -> DataFrame:
    """df with _rn (1, 2, … by draw, then tie) and _n (rows) among the rows of each key (of all, without one).

    draw is uniform in [0, 1): rows are numbered within one of `slices` equal slices of it, and the rows of the key in earlier
    slices are added, so a key's rows are in as many tasks as there are slices.
    """
    by = [key] if key else []
    cut = df.withColumn("_draw", draw).withColumn("_slice", F.floor(F.col("_draw") * slices).cast("int"))
    per = cut.groupBy(*by, "_slice").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_c").over(w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_slice").alias("_s"), before.alias("_before"), F.sum("_c").over(w).alias("_n"))
    same = F.col("_slice") == F.col("_s")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_draw", tie))
    return cut.withColumn("_in", inside).join(starts, same).select(*df.columns, (F.col("_before") + F.col("_in")).alias("_rn"), "_n")

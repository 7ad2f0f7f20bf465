"""What the corpus operators share: scratch tables, word splitting and model sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from journeyspark.functions.lineage import written

#: A word is a run of anything but ASCII white space (`bytes.split()` cuts at the same six characters).
WORD = r"[^\x20\x09-\x0D]+"


#: A table with a row for each of at most so many marks is broadcast.
MARKS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def renamed(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """docs with its columns as in0, in1, …, so that no working name clashes; their names by the old ones; and the way back."""
    name = {c: f"in{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in name.items()]), name, [F.col(name[c]).alias(c) for c in keep]


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def bounded_sample(docs: DataFrame, marks: DataFrame, each: int, text: str, doc_id: str, seed: str) -> DataFrame:
    """(_id, the marks' columns, _text) of at most `each` documents of every mark _y, the same on every run.

    marks: (_id, _y, any others). Chosen are the ids with the smallest hashes; only ids are sorted, and the chosen ones,
    whose number is bounded, are broadcast to a scan of the texts. An id with several marks takes the least of each
    column, and an id with several texts the one with the least hash, so no id brings more than one row.
    """
    own = marks.where("_id is not null").groupBy("_id").agg(*[F.min(c).alias(c) for c in marks.columns if c != "_id"])
    ids = docs.select(F.col(doc_id).alias("_id")).distinct().join(own, "_id")
    ids = written(ids.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_id"), 11)), "sample-ids")
    # Of a mark with many ids only the lowest hashes are looked at, far more than are asked for, so no task sorts a mark.
    share = (2.0 * each + 1000.0) / F.col("_c")
    low = F.col("_h").cast("double") / float(1 << 53) <= share
    per = written(ids.groupBy("_y").agg(F.count("*").alias("_c")), "sample-marks")
    some = ids.join(F.broadcast(per) if per.count() <= MARKS else per, "_y").where(low)
    first = F.row_number().over(Window.partitionBy("_y").orderBy("_h", "_id"))
    few = some.withColumn("_rank", first).where(F.col("_rank") <= each).drop("_rank", "_h", "_c")
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where("_text is not null").join(F.broadcast(few), "_id")
    return texts.groupBy(*few.columns).agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))


def ranked(df: DataFrame, key: str | None, order: str, name: str) -> DataFrame:
    """df with _at: 0, 1, … by `order` among the rows of each key (of all, without one), whatever a key's share of the rows.

    Rows are cut into ranges of (key, order) and numbered in each; what earlier ranges hold of a key is added. `order`
    must not repeat within a key.
    """
    by = [key] if key else []
    cut = written(df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()), name)
    held = cut.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(order)) - 1
    keep = held.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_of"), before.alias("_before"))
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return cut.withColumn("_inside", inside).join(keep, same).select(*df.columns, (F.col("_before") + F.col("_inside")).alias("_at"))


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def sliced(batches, rows: int = 256):
    """Arrow batches in parts, so that what a worker makes of them at a time is small; a worker that has seen all gives unused memory back."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
    pa.default_memory_pool().release_unused()


def shipped(spark: SparkSession, model):
    """A broadcast of a fitted model, whose class workers need not be able to import; call the result in a task."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: cloudpickle.loads(held.value)

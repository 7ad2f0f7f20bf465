"""Reading and writing tables: CSV with missing markers, directories of tables, exports, manifests, audit logs."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from journeyspark.contracts import MISSING, require


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def blank_missing(df: DataFrame, markers=MISSING) -> DataFrame:
    """Missing markers of string columns become null."""
    return df.select(*[F.when(F.trim(f"`{n}`").isin(*markers), None).otherwise(F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes])


def read_csv(spark: SparkSession, path: str, required=(), markers=MISSING, **options) -> DataFrame:
    """Every column as text, header names without outer spaces, markers as null; absent required columns raise.

    Inference would read the file twice; callers cast what they need.
    """
    df = spark.read.options(**({"header": True, "inferSchema": False} | options)).csv(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    return blank_missing(require(df, *required, what=path), markers)


def load_dataset(spark: SparkSession, paths: dict[str, str], required: dict[str, tuple] | None = None) -> dict[str, DataFrame]:
    """Read several CSV tables; all absent files are reported together."""
    absent = [p for p in paths.values() if not (lambda fs, q: fs.exists(q))(*_fs(spark, p))]
    if absent:
        raise FileNotFoundError("absent: " + ", ".join(absent))
    return {name: read_csv(spark, p, (required or {}).get(name, ())) for name, p in paths.items()}


def read_directory(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A table for each CSV or Parquet entry of a directory, by its name without suffix."""
    fs, p = _fs(spark, path)
    out = {}
    for s in fs.listStatus(p):
        name, full = s.getPath().getName(), s.getPath().toString()
        if name.endswith(".csv"):
            out[name[:-4]] = read_csv(spark, full)
        elif name.endswith(".parquet"):
            out[name[:-8]] = spark.read.parquet(full)
    return out


def dataset_info(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type, rows, non_null): one pass over each table."""
    out = None
    for name, df in tables.items():
        counts = df.agg(F.count("*").alias("rows"), *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(df.columns)])
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"n{i}").alias("non_null")) for i, (c, t) in enumerate(df.dtypes)])
        long = counts.select(F.lit(name).alias("table"), "rows", F.explode(cells).alias("c")).select("table", "c.column", "c.type", "rows", "c.non_null")
        out = long if out is None else out.unionByName(long)
    return out


def samples(tables: dict[str, DataFrame], n: int = 5) -> DataFrame:
    """(table, row): up to n rows of each table, as JSON."""
    parts = [df.limit(n).select(F.lit(name).alias("table"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def export(df: DataFrame, path: str, fmt: str = "csv", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_manifest(spark: SparkSession, manifest: dict, path: str, force: bool = True) -> DataFrame:
    """A manifest of aggregated values as one JSON row, and its (section, key, value) rows. Without force, an old one raises."""
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True, default=str),)], "manifest string").write.mode("overwrite" if force else "error").text(path)
    rows = [(s, str(k), json.dumps(v, default=str)) for s, part in manifest.items() for k, v in (part.items() if isinstance(part, dict) else [("value", part)])]
    return spark.createDataFrame(rows, "section string, key string, value string")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def append_audit(scored: DataFrame, path: str, at=None) -> None:
    """Append scored rows to the audit log, by date."""
    stamped = scored.withColumn("created_at", F.lit(at).cast("timestamp") if at else F.current_timestamp())
    stamped.withColumn("date", F.to_date("created_at")).write.mode("append").partitionBy("date").parquet(path)

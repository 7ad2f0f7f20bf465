"""Whitening of integer vectors by a weighted covariance over the different ones.

Rows with the same vector are one vector with a multiplicity. The covariance is a weighted, centred matrix product
over those, summed task by task; its eigenvectors (a problem of the vectors' length) whiten each different vector
once, and a join gives every row its vector's result. Sums and deviations are exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import renamed, shipped, table, written

COMPONENTS = 4
#: Products of all tasks are added in so many tasks, then in one.
FAN = 16
OUT = ("n", "deviation", "whitened", "explained", "identity_error")


def scaled(vector: str, by: int = 256) -> Column:
    """floor(by * c) of each component c as a long; null where a component is null or not finite. Beyond the range of longs, its ends."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~bad, F.transform(x, lambda c: F.floor(c.cast("double") * by)))


def exact(x: np.ndarray, bound: int) -> np.ndarray:
    """Integers on which sums and products below `bound` are exact: longs, or Python's own."""
    return x if bound < 1 << 62 else x.astype(object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly."""
    most = max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0) * n + max(map(abs, sums), default=0)
    by = exact(x, most)
    return by * n - np.array(sums, by.dtype)


def _rows(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, weights) of a batch."""
    return np.asarray(batch.column(0).flatten()).reshape(len(batch), dim), np.asarray(batch.column(1))


def weighted_sums(groups: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(sum of weights, weighted sum of each component), exact. groups: (vector, weight)."""

    def partial(batches):
        n, sums = 0, np.zeros(dim, object)
        for b in batches:
            x, w = _rows(b, dim)
            most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
            sums = sums + (exact(x, most * int(w.sum())) * w[:, None]).sum(0).astype(object)
            n += int(w.sum())
        at = [-1, *range(dim)]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([f"{int(v)}" for v in (n, *sums)])], names=["at", "s"])

    parts = groups.mapInArrow(partial, "at int, s string")
    got = {r[0]: int(r[1] or 0) for r in parts.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}  # a number for each component
    return got.get(-1, 0), [got.get(i, 0) for i in range(dim)]


def gemm(groups: DataFrame, dim: int, centre) -> np.ndarray:
    """Sum over rows (vector, weight) of weight * c c', where c = centre(vectors): a product in each task, sums of products in two steps."""

    def product(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            for lo in range(0, len(b), 4096):
                x, w = _rows(b.slice(lo, 4096), dim)
                c = centre(x)
                total += (c * w[:, None].astype(float)).T @ c
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(batches):
        total = np.zeros(dim * dim)
        for b in batches:
            for m in b.column(0):
                total += np.frombuffer(m.as_buffer(), float)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = groups.mapInArrow(product, "m binary")
    some = parts.repartition(FAN).mapInArrow(add, "m binary")
    return np.frombuffer(some.coalesce(1).mapInArrow(add, "m binary").first()["m"], float).reshape(dim, dim)


def whiten(df: DataFrame, vector: str = "x", components: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """df's rows with n, deviation (long), whitened, explained (arrays of double, a number for each component) and identity_error (double).

    `vector` is an array of longs. The fit list is each different vector once (weights="one") or as often as it occurs
    ("count"); n is its size. deviation is the exact sum over components of (n * x - sum of x)^2, null where that is
    no long. Component i is the unit eigenvector of the i-th largest eigenvalue of the fit list's covariance
    (divisor n; its largest entry is positive), `whitened` the centred vector along it over the root of its eigenvalue,
    `explained` its share of the trace. identity_error is the largest entry of whitened's covariance minus the identity.

    Rows whose vector is null or holds a null are dropped. Shorter vectors are filled up with zeros. Where an eigenvalue
    is zero to double precision (constant or dependent components), whitened is null, and identity_error covers the others;
    without variance explained and identity_error are null. There are at most as many components as the longest vector has.
    Repeated rows and null ids stay rows of their own. Columns of the five names that come in are replaced, others stay.

    What passes through the driver: the sums and one matrix of the vectors' length squared.
    """
    base, name, back = renamed(df, [c for c in df.columns if c not in OUT])
    rows = base.where(f"{name[vector]} is not null and not exists({name[vector]}, c -> c is null)")
    dim = rows.agg(F.max(F.size(name[vector]))).first()[0] or 0
    x = F.concat(F.col(name[vector]), F.array_repeat(F.lit(0).cast("long"), dim - F.size(name[vector]))) if dim else F.array().cast("array<bigint>")
    rows = written(rows.select(*[name[c] for c in df.columns if c not in OUT], x.alias("_x")), "whiten-rows")
    groups = written(rows.groupBy("_x").agg((F.count("*") if weights == "count" else F.lit(1).cast("long")).alias("_w")), "whiten-vectors")

    n, sums = weighted_sums(groups, dim)
    v = gemm(groups, dim, lambda x: (centred(x, n, sums) / n).astype(float)) / max(n, 1) if dim else np.zeros((0, 0))
    values, vectors = (a[..., ::-1] for a in np.linalg.eigh(v)) if dim else (np.zeros(0), np.zeros((0, 0)))
    k, trace = min(components, dim), float(np.trace(v))
    values, axes = values[:k], vectors[:, :k]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(k)] < 0, -1.0, 1.0) if k else axes
    real = values > dim * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)
    held = shipped(df.sparkSession, (axes / np.sqrt(np.where(real, values, 1.0)), real))

    def project(batches):
        to, on = held()
        for b in batches:
            x, _ = _rows(b, dim)
            y = centred(x, n, sums)
            most = max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0))))
            squares = exact(y, most * most * max(dim, 1))
            far = [int(d) if d < 1 << 63 else None for d in (squares * squares).sum(1).tolist()]
            z = (y / n).astype(float) @ to
            z = pa.ListArray.from_arrays(np.arange(0, z.size + 1, max(k, 1))[: len(b) + 1] if k else np.zeros(len(b) + 1, int), pa.array(z.ravel(), mask=~np.broadcast_to(on, z.shape).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(far, pa.int64()), z], names=["_x", "_w", "_deviation", "_z"])

    done = written(groups.mapInArrow(project, "_x array<bigint>, _w bigint, _deviation bigint, _z array<double>"), "whiten-done")
    on, error = np.flatnonzero(real), None
    if len(on):
        z = done.select(F.array(*[F.col("_z")[int(i)] for i in on]).alias("z"), "_w")
        means = np.array([float(m) for m in z.agg(*[F.sum(F.col("z")[i] * F.col("_w")) / n for i in range(len(on))]).first()])
        error = float(np.abs(gemm(z, len(on), lambda z: z - means) / n - np.eye(len(on))).max())

    share = [float(e) / trace if trace > 0 else None for e in values]
    found = done.select(F.xxhash64("_x").alias("_gh"), F.col("_x").alias("_gx"), "_deviation", "_z")
    rows = rows.withColumn("_h", F.xxhash64("_x")).join(found, (F.col("_h") == F.col("_gh")) & (F.col("_x") == F.col("_gx")))
    explained = F.array(*[F.lit(s).cast("double") for s in share]) if share else F.array().cast("array<double>")
    return rows.select(*back, F.lit(n).cast("long").alias("n"), F.col("_deviation").alias("deviation"), F.col("_z").alias("whitened"), explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op12_embedding_whitening(spark, sf_dir):
    white = whiten(table(spark, sf_dir, "embeddings").select("vec_id", scaled("embedding").alias("x")))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("_i", "_c")
    return white.select("vec_id", "n", "deviation", "identity_error", each).select("vec_id", (F.col("_i") + 1).alias("component"), "n", "deviation", F.col("_c.whitened").alias("whitened"), F.col("_c.explained").alias("explained"), "identity_error")

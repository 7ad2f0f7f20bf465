"""Principal components from co-moments that merge: a task's rows become a count, a mean and centred products, and two of those become one."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Moments of all tasks are merged in so many tasks, then in one.
FAN = 16
#: Rows whose products are taken at a time.
ROWS = 4096


@dataclass
class Components:
    """n rows, their mean, unit axes as columns by falling variance (divisor n - 1; the largest entry of an axis is positive)."""

    n: int
    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray

    @property
    def shares(self) -> np.ndarray:
        total = self.variances.sum()
        return self.variances / total if total > 0 else np.zeros_like(self.variances)


def merged(a: tuple | None, b: tuple | None) -> tuple | None:
    """Moments (n, mean, centred products) of two sets of rows together."""
    if a is None or b is None:
        return a or b
    (na, ma, pa_), (nb, mb, pb) = a, b
    n, gap = na + nb, mb - ma
    return n, ma + gap * (nb / n), pa_ + pb + np.outer(gap, gap) * (na * nb / n)


def _own(x: np.ndarray) -> tuple:
    mean = x.mean(0)
    c = x - mean
    return len(x), mean, c.T @ c


def _row(m: tuple | None):
    if m is not None:
        yield pa.RecordBatch.from_arrays([pa.array([m[0]], pa.int64()), pa.array([m[1].tobytes()], pa.binary()), pa.array([m[2].tobytes()], pa.binary())], names=["n", "mean", "products"])


def _moments(batches):
    got = None
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            part = b.column(0).slice(lo, ROWS)
            got = merged(got, _own(np.asarray(part.flatten(), float).reshape(len(part), -1)))
    yield from _row(got)


def _merge(batches):
    got = None
    for b in batches:
        for n, mean, products in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            mean = np.frombuffer(mean)
            got = merged(got, (n, mean, np.frombuffer(products).reshape(len(mean), len(mean))))
    yield from _row(got)


def co_moments(df: DataFrame, v: str = "v") -> tuple[int, np.ndarray, np.ndarray] | None:
    """(n, mean, centred products) of the rows' vectors, all of one length; None without rows. Rows with a null vector or entry are left out."""
    rows = df.where(f"{v} is not null and not exists({v}, c -> c is null)").select(F.col(v).cast("array<double>").alias("v"))
    kind = "n bigint, mean binary, products binary"
    got = rows.mapInArrow(_moments, kind).repartition(FAN).mapInArrow(_merge, kind).coalesce(1).mapInArrow(_merge, kind).first()
    if got is None:
        return None
    mean = np.frombuffer(got["mean"])
    return got["n"], mean, np.frombuffer(got["products"]).reshape(len(mean), len(mean))


def principal_components(df: DataFrame, k: int | None = None, v: str = "v") -> Components:
    """The first k (all) principal components. The eigenproblem has the vectors' length and is solved directly on the driver."""
    got = co_moments(df, v)
    if got is None:
        raise ValueError("no rows to take components of")
    n, mean, products = got
    variances, axes = np.linalg.eigh(products / max(n - 1, 1))
    variances, axes = np.maximum(variances[::-1], 0.0), axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return Components(n, mean, axes[:, :k], variances if k is None else variances[:k])


def apply_components(df: DataFrame, fitted: Components, v: str = "v") -> DataFrame:
    """(id, p): each row's centred vector along the axes."""
    mean, axes = fitted.mean, fitted.axes

    def placed(batches):
        for b in batches:
            x = np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(mean)))
            p = (x - mean) @ axes
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), p.ravel())], names=["id", "p"])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", F.col(v).cast("array<double>").alias("v")).mapInArrow(placed, f"id {kind}, p array<double>")

"""Imputation, scaling and encoding: fits are single aggregates, transforms are expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from journeyspark.functions.lineage import written
from journeyspark.functions.quantiles import column_quantiles

from .neighbors import meetings, rows_of


def fit_imputer(train: DataFrame, columns, key: str = "user_id") -> DataFrame:
    """What imputation needs of its training rows: (kind, times, v), each different profile with its smallest key and how often it is there; missing cells are null.

    A table like any other: it can be written, read back and applied to new rows. A column without any value raises.
    """
    counts = train.agg(*[F.count(c).alias(c) for c in columns], F.count("*").alias("_n")).first()
    if counts["_n"] and (empty := [c for c in columns if not counts[c]]):
        raise ValueError(f"no value in {', '.join(empty)}")
    return train.groupBy(*columns).agg(F.count("*").alias("times"), F.min(F.col(key).cast("long")).alias("kind")).select("kind", "times", F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))


def impute(df: DataFrame, fitted: DataFrame, columns, k: int = 5, key: str = "user_id", digits: int = 6) -> DataFrame:
    """Missing cells become the mean of the k nearest fitted rows that have the column; no such row: the column's mean.

    Distance: sqrt(p / present * sum of squares) over the coordinates that both rows have. Rows with equal profiles
    count as one donor with a multiplicity, and equal receivers are served once, so work depends on the number of
    different profiles; blocks of them meet in tasks, and only k donors a cell leave a meeting. Ties go to the smaller kind.
    """
    p, names = len(columns), F.array(*[F.lit(c) for c in columns])
    means = fitted.agg(*[(F.sum(F.col("v")[i] * F.col("times")) / F.sum(F.when(F.col("v")[i].isNotNull(), F.col("times")))).alias(f"_mean_{c}") for i, c in enumerate(columns)])
    gaps = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    asks = written(df.where(gaps).groupBy(*columns).agg(F.min(F.col(key).cast("long")).alias("_rid")), "asks")
    filled = lambda v: F.transform(v, lambda x: F.coalesce(x, F.lit(float("nan"))))
    left = rows_of(asks.select("_rid", filled(F.array(*[F.col(c).cast("double") for c in columns])).alias("v")), "_rid", "v")
    right = rows_of(fitted.select("kind", "times", filled(F.col("v")).alias("v")), "kind", "v", weight="times")
    far = meetings(left, right, _donors(k, p), "_rid bigint, c int, _d double, _kind bigint, _times bigint, value double")
    w = Window.partitionBy("_rid", "c").orderBy("_d", "_kind")
    near = far.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)  # k profiles hold k rows at least
    before = F.coalesce(F.sum("_times").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = near.withColumn("_used", F.least(F.col("_times"), F.lit(k) - before)).where("_used > 0")
    value = (F.sum(F.col("value") * F.col("_used")) / F.sum("_used")).alias("value")
    cells = used.groupBy("_rid", F.element_at(names, F.col("c") + 1).alias("column")).agg(value)
    wide = cells.groupBy("_rid").agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"_f_{c}") for c in columns])
    served = asks.join(wide, "_rid", "left")
    same = reduce(lambda a, b: a & b, [F.col(f"b.{c}").eqNullSafe(F.col(f"k.{c}")) for c in columns])
    out = df.alias("b").join(served.alias("k"), same, "left").select("b.*", *[f"k._f_{c}" for c in columns]).crossJoin(F.broadcast(means))  # one row of means
    keep = [c for c in df.columns if c not in columns]
    return out.select(*keep, *[F.round(F.coalesce(c, f"_f_{c}", f"_mean_{c}"), digits).alias(c) for c in columns])


def knn_impute(df: DataFrame, columns, k: int = 5, key: str = "user_id", digits: int = 6) -> DataFrame:
    """`impute` of a table from itself, which is written first, since both read it several times."""
    df = written(df, "with-gaps")
    return impute(df, written(fit_imputer(df, columns, key), "imputer"), columns, k, key, digits)


#: Cells of a matrix of distances that are computed at a time.
CELLS = 1 << 18


def _donors(k: int, p: int):
    """For every missing cell of the left rows the k nearest right rows that have the column.

    Rows with the same gaps go together: one product of their values with the donors' gives all distances. The k-th lowest of the
    lowest distances in a few stretches of donors is as far as the k nearest can be; below it, exact differences decide.
    """

    def kernel(xi, xv, xy, xw, yi, yv, yy, yw):
        hy = ~np.isnan(yv)
        y = np.where(hy, yv, 0.0)
        patterns, which = np.unique(~np.isnan(xv), axis=0, return_inverse=True)
        for g, own in enumerate(patterns):
            mine, present = np.flatnonzero(which.ravel() == g), hy[:, own].sum(1)
            for c in np.flatnonzero(~own):
                some = np.flatnonzero((present > 0) & hy[:, c])
                if not len(some):
                    continue
                times, squares = p / present[some], (y[some][:, own] ** 2).sum(1)
                theirs = (np.concatenate([hy[some][:, own], -2 * y[some][:, own], squares[:, None]], 1) * times[:, None]).T
                step, blocks = max(1, CELLS // len(some)), min(len(some), 16 * k)
                wide = len(some) // blocks
                for lo in range(0, len(mine), step):
                    x = xv[mine[lo : lo + step]][:, own]
                    rough = np.concatenate([x**2, x, np.ones((len(x), 1))], 1) @ theirs
                    slack = 64 * p * np.finfo(float).eps * times.max() * ((x**2).sum(1) + squares.max()) + 1e-300
                    low = rough[:, : blocks * wide].reshape(len(x), blocks, wide).min(2)
                    most = np.partition(low, k - 1, axis=1)[:, k - 1] if blocks >= k else np.full(len(x), np.inf)
                    i, j = np.divmod(np.flatnonzero((rough <= (most + 2 * slack)[:, None]).ravel()), len(some))
                    a, b = mine[lo + i], some[j]
                    both = own & hy[b]
                    exact = np.sqrt(float(p) / both.sum(1) * (np.where(both, xv[a] - y[b], 0.0) ** 2).sum(1))
                    by = np.lexsort((yi[b], exact, a))
                    a, b, exact = a[by], b[by], exact[by]
                    on = np.arange(len(a)) - np.searchsorted(a, a) < k
                    a, b, exact = a[on], b[on], exact[on]
                    yield pa.RecordBatch.from_arrays([pa.array(xi[a]), pa.array(np.full(len(a), c, np.int32)), pa.array(exact), pa.array(yi[b]), pa.array(yw[b]), pa.array(yv[b, c])], names=["_rid", "c", "_d", "_kind", "_times", "value"])

    return kernel


def _quantiles(df: DataFrame, columns, shares, approx: bool = False) -> dict[tuple[str, float], float]:
    """A number for each column and share."""
    if approx:
        row = df.agg(*[F.percentile_approx(c, list(shares)).alias(c) for c in columns]).first()
        return {(c, s): row[c][i] for c in columns if row[c] for i, s in enumerate(shares)}
    return {(r["column"], r["share"]): r["value"] for r in column_quantiles(df, columns, shares).collect()}


def median_impute(df: DataFrame, columns) -> DataFrame:
    return df.fillna({c: m for (c, _), m in _quantiles(df, columns, [0.5]).items()})


def fit_scaler(df: DataFrame, columns, kind: str, approx: bool = False) -> DataFrame:
    """One row of (shift_c, scale_c): robust (median, interquartile range), minmax or standard (population); a scale of 0 counts as 1.

    approx: sketched quantiles. A column without values has neither.
    """
    if kind == "robust":
        q = _quantiles(df, columns, (0.25, 0.5, 0.75), approx)
        cells = [(c, q.get((c, 0.5)), q[c, 0.75] - q[c, 0.25] if (c, 0.5) in q else None) for c in columns]
        made = [(F.lit(mid).cast("double"), F.lit(1.0 if spread == 0 else spread).cast("double")) for _, mid, spread in cells]
        return df.sparkSession.range(1).select(*[e.alias(f"{name}_{c}") for c, (mid, spread) in zip(columns, made, strict=True) for name, e in (("shift", mid), ("scale", spread))])
    aggs = []
    for c in columns:
        lo, spread = {"minmax": lambda c: (F.min(c), F.max(c) - F.min(c)), "standard": lambda c: (F.avg(c), F.stddev_pop(c))}[kind](c)
        aggs += [lo.cast("double").alias(f"shift_{c}"), F.when(spread == 0, 1.0).otherwise(spread).cast("double").alias(f"scale_{c}")]
    return df.agg(*aggs)


def scale(df: DataFrame, fitted: DataFrame, columns) -> DataFrame:
    """Columns shifted and scaled by a fit's one row."""
    out = df.crossJoin(F.broadcast(fitted))  # one row
    return out.select(*[((F.col(c) - F.col(f"shift_{c}")) / F.col(f"scale_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def categories(train: DataFrame, column: str, most: int = 1000) -> list:
    """Values of a column in order, null as -1; more than `most` raise, since each becomes a column."""
    got = [r[0] for r in train.select(F.coalesce(column, F.lit(-1)).alias("c")).distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(got)


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    """A 0/1 column for each known value; unknown values are 0 in all, null is the category -1."""
    c = F.coalesce(column, F.lit(-1))
    return df.withColumns({f"{column}_{int(v)}": (c == F.lit(v)).cast("int") for v in values})


def check_groups(columns, groups: dict[str, list[str]]) -> None:
    """Every column is in exactly one group."""
    listed = [c for g in groups.values() for c in g]
    if sorted(listed) != sorted(columns):
        raise ValueError(f"columns in no group or in two: {sorted(set(columns) ^ set(listed)) or sorted({c for c in listed if listed.count(c) > 1})}")


def feature_matrix(train: DataFrame, df: DataFrame, groups: dict[str, list[str]], layout: str = "scaled") -> tuple[DataFrame, list[str]]:
    """df with `features` (array of double) and the names of its parts: scaler groups (robust, minmax, standard) fitted on train.

    layout: "scaled" imputes medians and scales; "raw+scaled" puts the imputed columns before the scaled ones.
    """
    columns = [c for g in groups.values() for c in g]
    check_groups(columns, groups)
    train, df = _read_often(train, df)
    median = {c: m for (c, _), m in _quantiles(train, columns, [0.5]).items()}
    filled, base = df.fillna(median), train.fillna(median)
    out = filled.withColumns({f"raw_{c}": F.col(c) for c in columns})
    for kind, own in groups.items():
        if own:
            out = scale(out, fit_scaler(base, own, kind), own)
    names = ([f"raw_{c}" for c in columns] if layout == "raw+scaled" else []) + columns
    return out.withColumn("features", F.array(*[F.col(n).cast("double") for n in names])).drop(*[f"raw_{c}" for c in columns]), names


def _read_often(train: DataFrame, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables, train written, since each fit scans it; df with it if it is the same one."""
    table = written(train, "fit-rows")
    return table, table if df is train else df


def correlation_filter(train: DataFrame, columns, most: float = 0.9) -> list[str]:
    """Columns kept when, in order, each that correlates above `most` with one kept before is dropped; one pass over train."""
    pairs = [(a, b) for i, b in enumerate(columns) for a in columns[:i]]
    row = train.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]).first() if pairs else {}
    kept: list[str] = []
    for b in columns:
        if all(abs(row[f"{a}|{b}"] or 0.0) <= most for a in kept):
            kept.append(b)
    return kept


def correlations(df: DataFrame, columns) -> DataFrame:
    """(a, b, r) for each pair of columns."""
    pairs = [(a, b) for i, b in enumerate(columns) for a in columns[:i]]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def static_encoder(train: DataFrame, df: DataFrame, numeric=(), ordinal=(), nominal=(), skewed=(), aggregates=()) -> tuple[DataFrame, list[str]]:
    """df with `static` (array of double) and the names of its entries, in this order: standardised numeric, min-max ordinal,
    one-hot nominal, robust skewed columns and standardised aggregates (nulls 0). All is fitted on train."""
    train, df = _read_often(train, df)
    known = {c: categories(train, c) for c in nominal}
    groups = (("standard", numeric), ("minmax", ordinal), ("robust", skewed))
    for kind, own in groups:
        if own:
            fitted = fit_scaler(train, own, kind)
            df = scale(df.withColumns({f"_{c}": F.col(c) for c in own}), fitted.select(*[F.col(f"{p}_{c}").alias(f"{p}__{c}") for c in own for p in ("shift", "scale")]), [f"_{c}" for c in own])
    for c in nominal:
        df = one_hot(df, c, known[c])
    if aggregates:
        zeroed = lambda d: d.withColumns({f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in aggregates})
        own = [f"_{c}" for c in aggregates]
        df = scale(zeroed(df), fit_scaler(zeroed(train), own, "standard"), own)
    hot = [f"{c}_{int(v)}" for c in nominal for v in known[c]]
    names: list[str] = [*numeric, *ordinal, *hot, *skewed, *aggregates]
    columns = [n if n in hot else f"_{n}" for n in names]
    out = df.withColumn("static", F.array(*[F.col(c).cast("double") for c in columns]))
    return out.drop(*[f"_{c}" for c in (*numeric, *ordinal, *skewed, *aggregates)], *hot), names

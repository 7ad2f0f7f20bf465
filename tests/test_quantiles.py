"""Exact quantiles by selection: against SQL, known permutations and edges."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from journeyspark.functions import quantiles

SHARES = [0, 0.01, 0.25, 0.5, 0.77, 0.999, 1]


def test_bits_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 7e200, np.inf, np.nan])
    b = quantiles.ordered_bits(x)
    assert (np.diff(b) >= 0).all() and b[4] == b[5] and (np.diff(b) > 0).sum() == len(x) - 2
    assert np.array_equal(quantiles.from_bits(b), np.where(x == 0, 0.0, x), equal_nan=True)


@pytest.mark.parametrize("most", [0, 10**6])
def test_groups_by_sql(spark, most):
    r = np.random.default_rng(4)
    rows = [(int(g), float(v)) for g, v in zip(r.integers(0, 4, 3000), np.round(r.standard_cauchy(3000) * 10 ** r.integers(-3, 4, 3000).astype(float), 2), strict=True)] + [(9, -1.5), (None, 2.0), (None, 2.0), (3, None), (5, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {(q.g, q.i): q.value for q in quantiles.exact_quantiles(df, ["g"], "x", SHARES, most).collect()}
    pd_rows = df.toPandas()  # noqa: F841
    want = duckdb.sql(f"select g::INT as g, quantile_cont(x, {SHARES}) as q from pd_rows where x = x group by g").fetchall()
    assert len(got) == len(SHARES) * len(want)
    for g, q in want:
        for i, v in enumerate(q):
            assert got[None if g is None else int(g), i] == pytest.approx(v, rel=1e-12, abs=1e-12)


def test_ten_million_different_values(spark):
    p = 10_000_019  # a prime, so the multiples of anything go through all residues
    df = spark.range(1, p, numPartitions=8).select((((F.col("id") * 2654435) % p) / 7.0 - 5e5).alias("x"))
    got = {q.share: q.value for q in quantiles.exact_quantiles(df, [], "x", SHARES).collect()}
    for s in SHARES:
        at = s * (p - 2)
        lo, hi = (math.floor(at) + 1) / 7.0 - 5e5, (math.ceil(at) + 1) / 7.0 - 5e5
        assert got[s] == pytest.approx(lo + (hi - lo) * (at - math.floor(at)), rel=1e-12)


def test_one_value_for_most_rows_and_edges(spark):
    hot = spark.range(5000).select(F.when(F.col("id") % 10 < 9, 3.25).otherwise(F.col("id").cast("double")).alias("x"))
    assert [q.value for q in quantiles.selected_quantiles(hot, [], "x", [0.0, 0.5, 0.85]).orderBy("i").collect()] == [3.25] * 3
    empty = spark.createDataFrame([], "g int, x double")
    assert quantiles.selected_quantiles(empty, ["g"], "x", [0.5]).count() == quantiles.exact_quantiles(empty, ["g"], "x", [0.5]).count() == 0
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert quantiles.selected_quantiles(odd, [], "x", [0.0]).first().value == 1.0 and math.isnan(quantiles.selected_quantiles(odd, [], "x", [1.0]).first().value)


def test_columns(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (4, 30.0)], "a int, b double")
    got = {(q.column, q.share): q.value for q in quantiles.column_quantiles(df, ["a", "b"], [0.5, 1.0], 0).collect()}
    assert got == {("a", 0.5): 2, ("a", 1.0): 4, ("b", 0.5): 20, ("b", 1.0): 30}

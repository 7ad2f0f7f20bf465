"""Steps over profiles: each condition once, each table read once, work by different rows, and digits that products lose."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from journeyspark.operators import clean, cluster, prepare
from journeyspark.plans import training


def test_the_sparsity_condition_names_each_column_once(spark):
    df = spark.createDataFrame([(1, "1", None, "x"), (2, "1", "2", "3"), (3, None, "-", None), (4, "5", "6", "y")], "k int, a string, b string, c string")
    out = clean.sparsity_filter(clean.coerce_numeric(df, ["a", "b", "c"]), ["a", "b", "c"])
    where = next(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x)
    assert where.count("try_cast(") == 3
    assert sorted(r.k for r in out.collect()) == [2, 4]


def counted(spark, df):
    """df, and how many rows have been made of it."""
    seen = spark.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(each, df.schema), seen


@pytest.mark.parametrize("what", ["matrix", "static", "impute"])
def test_a_table_is_made_once_for_all_fits(spark, what):
    rows = [(i, float(i % 7), float(i % 5) if i % 9 else None, float(i % 3), float(i % 4)) for i in range(60)]
    df, seen = counted(spark, spark.createDataFrame(rows, "user_id bigint, a double, b double, c double, d double").fillna(0.0 if what == "static" else {}))
    if what == "matrix":
        out = prepare.feature_matrix(df, df, {"standard": ["a"], "minmax": ["b"], "robust": ["c", "d"]}, "raw+scaled")[0]
    elif what == "static":
        out = prepare.static_encoder(df, df, ["a"], ["b"], ["c"], ["d"])[0]
    else:
        out = prepare.knn_impute(df, ["a", "b", "c", "d"])
    assert len(out.collect()) == 60 and seen.value == 60


def test_journeys_are_made_once_for_window_and_check(spark):
    log = spark.range(300).select((F.col("id") % 20).alias("user_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.floor(F.col("id") / 20) % 4 + 1).cast("int").alias("touch"), F.lit(1.0).alias("duration"), F.col("id").alias("ord"))
    people = spark.range(25).select(F.col("id").alias("user_id"), F.col("id").alias("ord"), (F.col("id") % 3).cast("string").alias("a"), F.lit("1").alias("b"))
    (log, clicks), (people, profiles) = counted(spark, log), counted(spark, people)
    rows = training.prepare_rows(log, people, ["a", "b"])
    assert rows.count() == 20 and clicks.value == 300 and profiles.value == 25


def test_equal_rows_are_placed_once(spark, monkeypatch):
    sizes, real = [], cluster.knn_join

    def watched(left, right, *rest, **more):
        sizes.append((left.count(), right.count()))
        return real(left, right, *rest, **more)

    monkeypatch.setattr(cluster, "knn_join", watched)
    new = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(90)], "id bigint, v array<double>")
    cores = spark.createDataFrame([(i, [float(i % 2) * 1.6, 0.0], i, i) for i in range(40, 0, -1)], "id bigint, v array<double>, label int, dbscan_label int")
    got = {r.id: (r.label, r.is_noise, round(r.distance, 6)) for r in cluster.assign(new, cores, 0.5).collect()}
    want = [(2, False, 0.0), (-1, True, 0.6), (1, False, 0.4)]
    assert got == {i: want[i % 3] for i in range(90)} and sizes == [(3, 2)]


def test_donors_whose_products_lose_digits(spark):
    """Values far from zero that are near each other: products of them can't tell which is the nearest."""
    r = np.random.default_rng(1)
    near = 1e8 + r.uniform(0, 10, 400)
    rows = [(i, float(x), None if i % 4 == 0 else float(i)) for i, x in enumerate(near)]
    got = {x.user_id: x.b for x in prepare.knn_impute(spark.createDataFrame(rows, "user_id bigint, a double, b double"), ["a", "b"], k=3).where(F.col("user_id") % 4 == 0).collect()}
    donors = [i for i in range(400) if i % 4]
    for i in range(0, 400, 4):
        best = sorted(donors, key=lambda j: (abs(near[i] - near[j]), j))[:3]
        assert got[i] == pytest.approx(np.mean(best), abs=1e-6)

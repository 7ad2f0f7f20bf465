"""Every registered query with SQL, against DuckDB on the smallest tables; the others give rows."""

import math
import os

import duckdb
import pytest

from journeyspark.queries import registry, vectors

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql())))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    ran = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in ran.description]
    assert sorted(names) == cols
    want = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in ran.fetchall()), key=repr)
    assert got and got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_gives_rows(spark, duck, name):
    assert registry.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["compress_runs", "journey_window", "folds", "smote", "knn_impute"])
def test_partitions_do_not_matter(spark, duck, name):
    seen = []
    for n in ("1", "3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, registry.queries()[name](spark, DATA).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] == seen[2]


def test_queries_take_whole_embeddings(spark):
    assert vectors.vecs(spark, DATA).where("size(v) <> 64").count() == 0 and "embedding::DOUBLE[]" in vectors.VECS


@pytest.mark.parametrize(("name", "module", "operator", "given"), [("k_probe", vectors.cluster, "k_probe", 1), ("kmeans_segments", vectors.cluster, "kmeans", 2), ("spectral_segments", vectors.cluster, "spectral", 2), ("forest_search", vectors.search, "random_search", 2), ("eps_selection", vectors.cluster, "eps_candidates", 1)])
def test_operators_own_defaults(spark, monkeypatch, name, module, operator, given):
    seen = []

    def asked(*args, **named):
        seen.append((len(args), named))
        raise StopIteration

    monkeypatch.setattr(module, operator, asked)
    with pytest.raises(StopIteration):
        vectors.Q[name][0](spark, DATA)
    assert seen == [(given, {})]

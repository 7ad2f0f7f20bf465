"""Resampling looks for the neighbours that it needs, once."""

import numpy as np
import pytest

from journeyspark.operators import resample


@pytest.fixture(scope="module")
def classes(spark):
    r = np.random.default_rng(4)
    x, y = r.normal(size=(120, 3)), np.repeat([0, 1, 2], [60, 55, 5])
    return spark.createDataFrame([(i, int(y[i]), v.tolist()) for i, v in enumerate(x)], "id bigint, y int, v array<double>").repartition(4)


@pytest.fixture
def asked(monkeypatch):
    """Rows whose neighbours are looked for, by call."""
    seen, real = [], resample.knn_join

    def watched(left, *rest, **named):
        seen.append(sorted(r.id for r in left.select("id").collect()))
        return real(left, *rest, **named)

    monkeypatch.setattr(resample, "knn_join", watched)
    return seen


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_budget_asks_for_no_neighbours_of_the_largest_class(classes, asked):
    got = {r.id for r in resample.adasyn_budget(classes).collect()}
    assert asked == [list(range(60, 120))] and got == set(range(60, 120))


def test_adasyn_asks_for_neighbours_of_its_bases_once(classes, asked, capsys):
    out = resample.adasyn(classes)
    bases = {r.id for r in resample.adasyn_budget(classes).where("budget > 0").collect()}
    assert asked[1] == sorted(bases) and 0 < len(bases) < 60
    assert "MapInArrow" not in plan(out, capsys)  # neighbours have two readers
    assert out.where("id < 0").count() == resample.adasyn_budget(classes).groupBy().sum("budget").first()[0]


def test_smote_asks_for_neighbours_of_drawn_bases_once(classes, asked, capsys):
    out = resample.smote(classes)
    assert len(asked) == 1 and 0 < len(asked[0]) <= 10  # five draws and at most five rows of the small class
    assert "MapInArrow" not in plan(out, capsys)
    assert {r.y: r["count"] for r in out.groupBy("y").count().collect()} == {0: 60, 1: 60, 2: 60}


def test_links_are_found_once_for_both_ends(classes, capsys):
    assert "MapInArrow" not in plan(resample.drop_tomek(classes), capsys)

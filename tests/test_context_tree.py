"""The context tree: counts, pruning and blending by brute force; planted order; held-out log loss."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from journeyspark.functions.draws import uniform
from journeyspark.operators import journey
from journeyspark.plans import backoff, context_tree
from journeyspark.queries.tables import clicks


def frame(spark, journeys):
    return spark.createDataFrame([(i, j[:-1], j[-1]) for i, j in enumerate(journeys)], "id bigint, seq_touch array<int>, target int")


def brute(journeys, max_len, least, worth, weight):
    counts = defaultdict(Counter)
    for j in journeys:
        for i, x in enumerate(j):
            for l in range(min(i, max_len) + 1):
                counts[tuple(reversed(j[i - l : i]))][x] += 1
    n = {c: sum(v.values()) for c, v in counts.items()}
    live = {c for c in counts if not c or all(n[c[:l]] >= least for l in range(1, len(c) + 1))}
    gain = {c: sum(k * math.log(k / n[c] / (counts[c[:-1]][x] / n[c[:-1]])) for x, k in counts[c].items()) for c in live if c}
    kept = {c[:l] for c in gain if gain[c] >= worth for l in range(1, len(c) + 1)} | {()}
    total, kinds = n[()], len(counts[()])

    def share(c, x):
        return (counts[c][x] + 1.0) / (total + kinds) if not c else (counts[c][x] + weight * share(c[:-1], x)) / (n[c] + weight)

    return {(",".join(map(str, c)), x): (counts[c][x], share(c, x)) for c in kept for x in counts[()]}


def planted(n, seed=0):
    """A touch repeats the one three steps back, four times out of five."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        j = r.integers(1, 5, 3).tolist()
        while len(j) < 30:
            j.append(j[-3] if r.random() < 0.8 else int(r.integers(1, 5)))
        out.append(j)
    return out


@pytest.mark.parametrize(("max_len", "least", "worth"), [(3, 2, 2.0), (4, 5, 0.5), (2, 1, -1e9)])
def test_shares_by_brute_force(spark, max_len, least, worth):
    r = np.random.default_rng(1)
    journeys = [r.integers(1, 4, r.integers(2, 12)).tolist() for _ in range(40)] + planted(5)
    tree = context_tree.fit(frame(spark, journeys), max_len, least, worth)
    got = {(s.context, s.target): (s.c, s.prob) for s in tree.shares.collect()}
    want = brute(journeys, max_len, least, worth, 5.0)
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_planted_order_is_found_and_beats_two_steps(spark):
    train, fresh = planted(60), planted(40, 9)
    tree = context_tree.fit(frame(spark, train))
    depths = {n.depth for n in tree.nodes.collect()}
    assert 3 in depths
    rows = frame(spark, fresh)
    scored = context_tree.score(rows, tree)
    assert all(abs(r.s - 1) < 1e-9 for r in scored.groupBy("id").agg(F.sum("prob").alias("s")).collect())
    mine = context_tree.log_loss(scored, rows.select("id", "target")).first()
    steps = journey.last_two(frame(spark, [j[: i + 1] for j in train for i in range(3, 30)]).withColumnRenamed("id", "user_id")).withColumnRenamed("user_id", "id")
    asked = journey.last_two(rows.withColumnRenamed("id", "user_id")).withColumnRenamed("user_id", "id")
    two = context_tree.log_loss(backoff.score(asked, backoff.fit(steps)), rows.select("id", "target")).first()
    assert mine.n == 40 and mine.log_loss < two.log_loss - 0.2


def test_held_out_users_not_worse_than_two_steps(spark):
    rows = journey.build_examples(journey.build_events(clicks(spark, "/root/testdata/sf0.1"))).withColumnRenamed("user_id", "id")
    mine = uniform(5, F.col("id"), "train") < 0.7
    truth = rows.where(~mine).select("id", "target")
    tree = context_tree.fit(rows.where(mine))
    new = context_tree.log_loss(context_tree.score(rows.where(~mine), tree), truth).first().log_loss
    last = journey.last_two(rows.withColumnRenamed("id", "user_id")).withColumnRenamed("user_id", "id")
    old = context_tree.log_loss(backoff.score(last.where(~mine), backoff.fit(last.where(mine))), truth).first().log_loss
    assert new <= old


def test_edges(spark):
    rows = spark.createDataFrame([(1, [], 3), (2, [3, 3], 3), (3, None, 4)], "id bigint, seq_touch array<int>, target int")
    tree = context_tree.fit(rows.where("seq_touch is not null"), worth=-1e9)
    got = {(r.id, r.target): r.prob for r in context_tree.score(rows.where("seq_touch is not null"), tree).collect()}
    assert set(got) == {(1, 3), (2, 3)} and got[1, 3] == 1
    empty = context_tree.fit(rows.where("false"))
    assert empty.nodes.count() == 0 and context_tree.score(rows.where("id = 1"), empty).count() == 0

"""Parameter search on a validation part, and the choice between feature sets."""

from __future__ import annotations

import itertools
import uuid
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from journeyspark.functions import metrics
from journeyspark.functions.draws import uniform
from journeyspark.functions.lineage import written

from . import models

#: What a trial may draw for a forest; numbers per knob are part of the search's definition.
FOREST_KNOBS = {"numTrees": (20, 40, 60), "maxDepth": (4, 6, 8), "minInstancesPerNode": (1, 2, 5), "subsamplingRate": (0.7, 0.85, 1.0)}


def forest(**params):
    return models.Candidate("random_forest " + " ".join(f"{k}={v}" for k, v in sorted(params.items())), lambda k, n: RandomForestClassifier(seed=1, **params))


def logistic(**params):
    return models.Candidate("logistic " + " ".join(f"{k}={v}" for k, v in sorted(params.items())), lambda k, n: LogisticRegression(family="multinomial", weightCol="weight", **params))


def draw_trials(knobs: dict[str, tuple], trials: int, seed: int = 1) -> list[dict]:
    """Distinct settings in an order that the seed alone decides; all of the grid if it is smaller."""
    import random

    grid = [dict(zip(knobs, values, strict=True)) for values in itertools.product(*knobs.values())]
    random.Random(seed).shuffle(grid)
    return grid[:trials]


#: Fits that are submitted at a time.
THREADS = 4


def side_by_side(spark: SparkSession, work: list, threads: int = THREADS) -> list:
    """Results of functions without arguments, in order, run by so many threads at a time.

    Their jobs carry a tag, and a pool of their own where the session schedules fairly; if one raises, the jobs of the others are cancelled.
    """
    sc, tag = spark.sparkContext, f"trials-{uuid.uuid4().hex}"

    def run(i: int):
        sc.addJobTag(tag)
        sc.setLocalProperty("spark.scheduler.pool", f"trial-{i % threads}")
        try:
            return work[i]()
        finally:
            sc.removeJobTag(tag)
            sc.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, threads)) as pool:
        tasks = [pool.submit(inheritable_thread_target(spark)(run), i) for i in range(len(work))]
        done, _ = wait(tasks, return_when=FIRST_EXCEPTION)
        if any(t.exception() for t in done):
            for t in tasks:
                t.cancel()
            sc.cancelJobsWithTag(tag)
        return [t.result() for t in tasks]


def evaluate(candidates, train: DataFrame, val: DataFrame, threads: int = THREADS) -> list[dict]:
    """One result per candidate, in order: fitted on train, measured on val, side by side. A candidate that can't be fitted is a result too, unless none can."""
    tasks = train.sparkSession.sparkContext.defaultParallelism
    train, val = (written(d.select("id", "y", "v").repartition(tasks), f"trial-{n}") for n, d in (("train", train), ("val", val)))
    errors: list[Exception] = []

    def trial(c):
        try:
            pred, labels = models.predict(models.fit(c, train), val)
            return {"name": c.label, "error": None} | metrics.bundle(written(pred, "predictions"), labels if c.probabilities else None).first().asDict()
        except Exception as e:
            if not models.unfit(e):
                raise
            errors.append(e)
            return {"name": c.label, "error": str(e)[:200], "f1_macro": float("-inf")}

    out = side_by_side(train.sparkSession, [lambda c=c: trial(c) for c in candidates], threads)
    if errors and all(r["error"] for r in out):
        raise ValueError("no candidate could be fitted") from errors[-1]
    return out


def halving(candidates, train: DataFrame, val: DataFrame, shares=(0.25, 1.0), keep: float = 1 / 3, seed: int = 1, least: int = 100, threads: int = THREADS) -> list[dict]:
    """Successive halving: every candidate on a share of the training rows, the best `keep` of them (two at least) on the next; the last share is 1, all rows.

    A share's rows are those of the lowest hash draws, so a larger share holds a smaller one. A share of fewer than `least`
    rows is passed over. Results carry the share they are of; the finalists come first, each group by macro F1.
    """
    if shares[-1] != 1.0:
        raise ValueError("the last round takes all rows")
    n = train.count()
    rounds = [s for s in shares[:-1] if s * n >= least] + [1.0]
    live, out = list(candidates), []
    for s in rounds:
        rows = train if s == 1.0 else train.where(uniform(seed, F.col("id"), "halving") < s)
        got = [r | {"share": s} for r in evaluate(live, rows, val, threads)]
        order = sorted(range(len(got)), key=lambda i, got=got: -got[i]["f1_macro"])
        stay = len(live) if s == 1.0 else min(len(live), max(2, round(len(live) * keep)))
        out = [got[i] for i in order] + out if s == 1.0 else [got[i] for i in order[stay:]] + out
        live = [live[i] for i in order[:stay]]
    return out


def random_search(train: DataFrame, val: DataFrame, trials: int = 12, seed: int = 1, knobs=FOREST_KNOBS, make=forest, shares=(0.25, 1.0)) -> list[dict]:
    """Drawn trials by macro F1 on val, best first: all on a share of the training rows, the better ones on all (shares=(1.0,): all on all)."""
    return halving([make(**p) for p in draw_trials(knobs, trials, seed)], train, val, shares, seed=seed)


def baseline_grid(sets: dict[str, tuple[DataFrame, DataFrame, DataFrame]], candidates) -> list[dict]:
    """One row for each feature set (train, val, test) and candidate: chosen by val, and measured on test for the best of each set."""
    out = []
    for name, (train, val, test) in sets.items():
        rows = [r | {"set": name, "test_f1": None} for r in evaluate(candidates, train, val)]
        best = max(rows, key=lambda r: r["f1_macro"])
        won = next(c for c in candidates if c.label == best["name"])
        pred, labels = models.predict(models.fit(won, train), test)
        best["test_f1"] = metrics.bundle(written(pred, "predictions"), labels if won.probabilities else None).first()["f1_macro"]
        out += rows
    return out


def choose_feature_set(sets: dict[str, tuple[DataFrame, DataFrame, DataFrame]], candidates) -> dict:
    """Of feature sets (train, val, test), the one with the best candidate on val; that one is refitted on train and val and scored on test once."""
    tried = {name: max(evaluate(candidates, tr, va), key=lambda r: r["f1_macro"]) for name, (tr, va, _) in sets.items()}
    name = max(tried, key=lambda n: tried[n]["f1_macro"])
    train, val, test = sets[name]
    best = next(c for c in candidates if c.label == tried[name]["name"])
    pred, labels = models.predict(models.fit(best, train.unionByName(val)), test)
    return {"set": name, "candidate": best.label, "validation": {n: r["f1_macro"] for n, r in tried.items()}, "test": metrics.bundle(written(pred, "predictions"), labels).first().asDict()}

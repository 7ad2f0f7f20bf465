"""k-means for many starts and many k at once: every scan of the rows serves all models that have not settled.

Seeds come by k-means||: a scan draws rows by hash with a chance that grows with their distance from what is chosen, and
the few candidates, weighed by the rows nearest to them, are reduced to k. A round of Lloyd's method assigns each row to its
nearest centre in every model; what leaves a task is a count, a sum and a cost for each centre.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from journeyspark.functions.draws import uniform

#: Rows whose distances are held at a time.
ROWS = 4096
#: Candidates that a seeding scan draws for each wanted centre, on average, and how many such scans there are.
DRAWS, STEPS = 2.0, 2


@dataclass
class Model:
    k: int
    seed: int
    centres: np.ndarray
    cost: float = float("inf")
    settled: bool = False


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows from centres."""
    return np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T, 0.0)


def assignment_sums(rows: DataFrame, centres: list[np.ndarray]) -> DataFrame:
    """(m, label, n, cost, total): for each model and centre the rows nearest to it (ties: the first), their squared distances and their sum.

    Tasks add up their rows, so a group holds one row for each task. Centres travel with the scan.
    """

    def summed(batches):
        got: dict = {}
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                x = _matrix(b.column(0).slice(lo, ROWS))
                for m, c in enumerate(centres):
                    d = squares(x, c)
                    near = d.argmin(1)
                    best = d[np.arange(len(x)), near]
                    hot = (near[:, None] == np.arange(len(c))).astype(float)
                    n, cost, total = got.get(m, (0, 0, 0))
                    got[m] = n + hot.sum(0), cost + best @ hot, total + hot.T @ x
        for m, (n, cost, total) in got.items():
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([m] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(n.astype(np.int64)), pa.array(cost), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["m", "label", "n", "cost", "total"])

    parts = rows.select(F.col("v").cast("array<double>").alias("v")).mapInArrow(summed, "m int, label int, n bigint, cost double, total array<double>")
    lists = F.collect_list("total")
    total = F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), lists[0], lambda a, x: F.zip_with(a, x, lambda u, w: u + w))
    return parts.groupBy("m", "label").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), total.alias("total"))


def _costs(rows: DataFrame, candidates: list[np.ndarray]) -> list[float]:
    got = {r[0]: r[1] for r in assignment_sums(rows, candidates).groupBy("m").agg(F.sum("cost")).collect()}  # a number for each model
    return [got.get(m, 0.0) for m in range(len(candidates))]


def reduced(x: np.ndarray, w: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the weighted candidates, each next one drawn by weight times squared distance from those before (k-means++)."""
    r = np.random.default_rng(seed)
    got = [int(r.choice(len(x), p=w / w.sum()))]
    near = squares(x, x[got]).min(1)
    while len(got) < min(k, len(x)):
        p = w * near
        if p.sum() <= 0:
            break
        got.append(int(r.choice(len(x), p=p / p.sum())))
        near = np.minimum(near, squares(x, x[got[-1:]]).min(1))
    return x[got]


def seeded(rows: DataFrame, wanted: list[tuple[int, int]]) -> list[np.ndarray]:
    """First centres for each (k, seed). Draws are hashes of ids, so they don't depend on partitioning."""
    seeds = sorted({s for _, s in wanted})
    draw = lambda step: F.array(*[uniform(s, F.col("id"), f"start-{step}") for s in seeds])
    first = rows.agg(*[F.min_by(F.col("v").cast("array<double>"), F.struct(draw(0)[i], F.col("id"))).alias(f"s{i}") for i in range(len(seeds))]).first()
    if first["s0"] is None:
        raise ValueError("no rows to cluster")
    have = [np.array([first[f"s{seeds.index(s)}"]]) for _, s in wanted]
    for step in range(1, STEPS + 1):
        costs, held = _costs(rows, have), list(have)

        def drawn(batches, costs=costs, held=held):
            for b in batches:
                x, u = _matrix(b.column(0)), _matrix(b.column(1))
                for m, (k, s) in enumerate(wanted):
                    if costs[m] > 0:
                        on = u[:, seeds.index(s)] < DRAWS * k * squares(x, held[m]).min(1) / costs[m]
                        yield pa.RecordBatch.from_arrays([pa.array([m] * int(on.sum()), pa.int32()), b.column(0).filter(pa.array(on))], names=["m", "v"])

        some = rows.select(F.col("v").cast("array<double>").alias("v"), draw(step).alias("u")).mapInArrow(drawn, "m int, v array<double>").orderBy("m", "v").collect()  # about DRAWS * k rows a model
        for m in range(len(wanted)):
            more = [r["v"] for r in some if r["m"] == m]
            have[m] = np.vstack([have[m], *([np.array(more)] if more else [])])
    weights = {(r["m"], r["label"]): r["n"] for r in assignment_sums(rows, have).select("m", "label", "n").collect()}
    return [reduced(x, np.array([weights.get((m, i), 0) for i in range(len(x))], float), k, s) for m, (x, (k, s)) in enumerate(zip(have, wanted, strict=True))]


def fit_many(rows: DataFrame, wanted: list[tuple[int, int]], rounds: int = 20, tol: float = 1e-4) -> list[Model]:
    """A model for each (k, seed), from rows (id, v) that are cheap to scan again. A model has settled when no centre moves by more than tol."""
    models = [Model(k, s, c) for (k, s), c in zip(wanted, seeded(rows, wanted), strict=True)]
    for turn in range(rounds + 1):
        live = [m for m in models if not m.settled]
        if not live:
            break
        got = assignment_sums(rows, [m.centres for m in live]).collect()  # a row for each centre
        for i, m in enumerate(live):
            own = {r["label"]: r for r in got if r["m"] == i}
            m.cost = sum(r["cost"] for r in own.values())
            moved = np.array([np.array(own[j]["total"]) / own[j]["n"] if j in own and own[j]["n"] else c for j, c in enumerate(m.centres)])
            m.settled = turn == rounds or bool((((moved - m.centres) ** 2).sum(1) <= tol * tol).all())
            if not m.settled:
                m.centres = moved
    return models


def best_of(models: list[Model]) -> dict[int, Model]:
    """The model of least cost for each k, the earlier of equal ones."""
    out: dict[int, Model] = {}
    for m in models:
        if m.k not in out or m.cost < out[m.k].cost:
            out[m.k] = m
    return out


def labelled(rows: DataFrame, models: list[Model]) -> DataFrame:
    """(id, labels): the nearest centre of each model."""
    centres = [m.centres for m in models]

    def placed(batches):
        for b in batches:
            x = _matrix(b.column(1)) if b.num_rows else np.zeros((0, centres[0].shape[1]))
            near = np.stack([squares(x, c).argmin(1) for c in centres], 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, near.size + 1, len(centres), dtype=np.int32), near.ravel())], names=["id", "labels"])

    return rows.select(F.col("id").cast("long"), F.col("v").cast("array<double>").alias("v")).mapInArrow(placed, "id bigint, labels array<int>")

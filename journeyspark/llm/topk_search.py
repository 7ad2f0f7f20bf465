"""Exact top-k search by inner product with dual cover trees.

Queries and data are indexed by the same net: centres in farthest-first order, of which the data take a finer
and the queries a coarser prefix. Each group becomes blocks, and each block a cover tree: a node has a centre,
a covering radius and children whose centres are a net of its points. A pair of nodes is pruned when even the
best possible product, from the centres and covering radii, is below the worst kth score of the query node.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shipped, table, written

LEAF, FANOUT = 256, 8


class CoverTree:
    """points: rows in tree order, keys: their keys; nodes: (start, end, centre row, radius, largest norm, children)."""

    def __init__(self, points: np.ndarray, keys: np.ndarray):
        order, nodes = np.arange(len(points)), []

        def grow(lo: int, hi: int, centre: int) -> int:
            at = len(nodes)
            own = order[lo:hi]
            d = np.sqrt(((points[own] - points[centre]) ** 2).sum(1))
            nodes.append([lo, hi, centre, float(d.max()), []])
            if hi - lo <= LEAF or d.max() == 0:
                order[lo:hi] = own[np.argsort(keys[own], kind="stable")]
                return at
            net, near, who = [centre], d, np.zeros(len(own), int)
            while len(net) < FANOUT and near.max() > nodes[at][3] / 2:
                net.append(own[int(near.argmax())])
                d = np.sqrt(((points[own] - points[net[-1]]) ** 2).sum(1))
                who[d < near] = len(net) - 1
                near = np.minimum(near, d)
            if len(net) == 1 or (who == 0).all():
                return at
            by = np.argsort(who, kind="stable")
            order[lo:hi] = own[by]
            edges = np.searchsorted(who[by], np.arange(len(net) + 1))
            nodes[at][4] = [grow(lo + int(a), lo + int(b), c) for a, b, c in zip(edges, edges[1:], net, strict=False) if b > a]
            return at

        if len(points):
            grow(0, len(points), 0)
        place = np.empty(len(points), int)
        place[order] = np.arange(len(points))
        self.points, self.keys = points[order], keys[order]
        self.nodes = [(lo, hi, int(place[c]), r, kids) for lo, hi, c, r, kids in nodes]
        self.norms = np.sqrt((self.points**2).sum(1))

    def packed(self) -> bytes:
        return pickle.dumps(vars(self))

    @classmethod
    def unpacked(cls, raw: bytes) -> "CoverTree":
        tree = cls.__new__(cls)
        vars(tree).update(pickle.loads(raw))
        return tree


def most(q: CoverTree, a: int, d: CoverTree, b: int) -> float:
    """No product of a point under q's node a with one under d's node b is above this."""
    qc, qr, dc, dr = q.nodes[a][2], q.nodes[a][3], d.nodes[b][2], d.nodes[b][3]
    top = float(q.points[qc] @ d.points[dc]) + qr * d.norms[dc] + dr * q.norms[qc] + qr * dr
    return top + 1e-6 * (abs(top) + 1.0)


def dual_search(q: CoverTree, d: CoverTree, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries, k) scores and keys of the best points of d that reach each query's floor; -inf and the highest key where there are fewer."""
    n, none = len(q.points), np.iinfo(np.int64).max
    best, keys = np.full((n, k), -np.inf), np.full((n, k), none)
    kth = floor.copy()
    todo = [(most(q, 0, d, 0), 0, 0)] if n and len(d.points) else []
    while todo:
        bound, a, b = todo.pop()
        lo, hi, _, _, kids_a = q.nodes[a]
        if bound < kth[lo:hi].min():
            continue
        start, end, _, _, kids_b = d.nodes[b]
        if kids_a and (not kids_b or hi - lo >= end - start):
            todo += sorted((most(q, c, d, b), c, b) for c in kids_a)
        elif kids_b:
            todo += sorted((most(q, a, d, c), a, c) for c in kids_b)
        else:
            for cut in range(start, end, 4 * LEAF):  # a node of equal points may be large
                stop = min(end, cut + 4 * LEAF)
                s = q.points[lo:hi] @ d.points[cut:stop].T
                good = s >= kth[lo:hi, None]
                on, cols = np.flatnonzero(good.any(1)), np.flatnonzero(good.any(0))  # few, once the kth scores are high
                if not len(on):
                    continue
                rows = lo + on
                part = np.where(good, s, -np.inf)[np.ix_(on, cols)]
                all_s = np.concatenate([best[rows], part], axis=1)
                all_k = np.concatenate([keys[rows], np.broadcast_to(d.keys[cut + cols], part.shape)], axis=1)
                by = np.argsort(all_k, axis=1, kind="stable")
                by = np.take_along_axis(by, np.argsort(-np.take_along_axis(all_s, by, 1), axis=1, kind="stable")[:, :k], 1)
                best[rows], keys[rows] = np.take_along_axis(all_s, by, 1), np.take_along_axis(all_k, by, 1)
                kth[rows] = np.maximum(kth[rows], best[rows, -1])
    return best, keys


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """n points of x, each the farthest from those before it: every prefix is a net."""
    if not len(x):
        return x
    got, near = [0], np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(got) < n and near.max() > 0:
        got.append(int(near.argmax()))
        near = np.minimum(near, np.sqrt(((x - x[got[-1]]) ** 2).sum(1)))
    return x[got]


def _blocks(vectors: DataFrame, centres: np.ndarray, dim: int, rows: int) -> DataFrame:
    """(block, n, head, tree): cover trees over groups of at most about `rows` vectors that share a nearest centre."""
    held = shipped(vectors.sparkSession, centres)

    def near(batches):
        c = held()
        for b in batches:
            x = _matrix(b.column(1), dim)
            who = ((c**2).sum(1) - 2 * x @ c.T).argmin(1) if len(c) else np.zeros(len(x), int)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(who.astype(np.int32))], names=["key", "v", "c"])

    placed = written(vectors.select("key", "v").mapInArrow(near, "key bigint, v array<bigint>, c int"), "topk-groups")
    sizes = placed.groupBy("c").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    block = F.concat_ws("-", "c", F.pmod(F.xxhash64("key"), F.col("parts")))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = CoverTree(_matrix(pa.array(pdf["v"], pa.list_(pa.int64())), dim), pdf["key"].to_numpy(np.int64))
        centre, radius = tree.points[tree.nodes[0][2]], tree.nodes[0][3]
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "n": [len(pdf)], "centre": [centre.tolist()], "radius": [radius], "tree": [tree.packed()]})

    keyed = placed.join(F.broadcast(sizes), "c").select(block.alias("block"), "key", "v")  # a row for each centre
    return written(keyed.groupBy("block").applyInPandas(plant, "block string, n long, centre array<double>, radius double, tree binary"), "topk-trees")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers as doubles (products stay exact below 2^53), shorter ones filled up with zeros."""
    sizes, out = np.asarray(column.value_lengths(), np.int64), np.zeros((len(column), dim))
    out[np.arange(dim) < sizes[:, None]] = np.asarray(column.flatten())
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "v", sample: int = 4000, block_rows: int = 2048, max_centres: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` marks, the k highest inner products with all other rows.

    `vector` is an array of integers; ties go to the smaller vec_id. Rows with a null id, a null vector or a null
    component take no part. Vectors of different lengths are compared over the shorter length. Repeated ids are
    separate candidates, but none is a candidate of a query with its id. Fewer than k others: all of them.
    Products beyond 2^53 are rounded.

    Equal vectors are searched once: of each, the k + 1 smallest ids are enough for every exact answer, so a
    vector that a third of the rows share costs no more than another. Only the centres (at most `max_centres`,
    from a hash sample of `sample` vectors) and one row per block pass through the driver or a broadcast.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = written(rows.where("id is not null and v is not null and not exists(v, x -> x is null)"), "topk-rows")
    some = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    groups = written(rows.select("v", "id").withColumn("r", some).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("key", F.col("ids")[0]), "topk-vectors")
    asked = rows.where("asks").select("v", F.col("id").alias("query_id"))
    asking = groups.join(asked.select("v").distinct(), "v", "left_semi").select("key", "v")

    shape = groups.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = shape["n"], max(1, shape["dim"] or 1)
    few = groups.orderBy(F.xxhash64("v"), "key").limit(sample).select("v").toArrow()["v"].combine_chunks()
    centres = farthest_first(_matrix(few, dim), max(1, min(max_centres, n // block_rows)))
    n_asking = asking.count()
    data = _blocks(groups, centres, dim, block_rows)
    asks = _blocks(asking, centres[: max(1, min(len(centres), n_asking // block_rows))], dim, block_rows)

    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    heads = asks.select(F.col("block").alias("qb"), F.col("centre").alias("qc"), F.col("radius").alias("qr")).crossJoin(data.select(F.col("block").alias("db"), F.col("centre").alias("dc"), F.col("radius").alias("dr")))
    bound = dot("qc", "dc") + F.col("qr") * F.sqrt(dot("dc", "dc")) + F.col("dr") * F.sqrt(dot("qc", "qc")) + F.col("qr") * F.col("dr")
    pairs = written(heads.select("qb", "db", (bound + F.abs(bound) * 1e-6 + 1.0).alias("bound"), F.row_number().over(Window.partitionBy("qb").orderBy(bound.desc(), "db")).alias("turn")), "topk-pairs")

    def searched(some: DataFrame, floors: DataFrame | None) -> DataFrame:
        rows = some.join(asks.select(F.col("block").alias("qb"), F.col("tree").alias("qt")), "qb").join(data.select(F.col("block").alias("db"), F.col("tree").alias("dt")), "db")
        rows = rows.join(floors, "qb") if floors is not None else rows.withColumn("floors", F.expr("cast(null as array<struct<key:bigint,kth:double>>)"))

        def work(batches):
            for b in batches:
                for qt, dt, floor in zip(b["qt"], b["dt"], b["floors"], strict=True):
                    q, d = CoverTree.unpacked(qt.as_py()), CoverTree.unpacked(dt.as_py())
                    least = np.full(len(q.points), -np.inf)
                    if floor.is_valid:
                        known = {x["key"]: x["kth"] for x in floor.as_py()}
                        least = np.array([known.get(key, -np.inf) for key in q.keys.tolist()])
                    s, keys = dual_search(q, d, k + 1, least)
                    i, j = np.nonzero(s > -np.inf)
                    yield pa.RecordBatch.from_arrays([pa.array(q.keys[i]), pa.array(keys[i, j]), pa.array(s[i, j])], names=["qkey", "dkey", "score"])

        few = rows.select("qt", "dt", "floors").repartition(F.xxhash64("qb", "db"))
        return few.mapInArrow(work, "qkey bigint, dkey bigint, score double")

    first = written(searched(pairs.where("turn = 1"), None), "topk-first")
    kth = first.groupBy("qkey").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k + 1)
    members = asks.select("block", "tree").mapInArrow(_members, "qb string, key bigint")
    floors = members.join(kth, F.col("key") == F.col("qkey"), "left").groupBy("qb").agg(F.collect_list(F.struct("key", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))).alias("floors"), F.min(F.coalesce("kth", F.lit(float("-inf")))).alias("worst"))
    floors = written(floors, "topk-floors")
    rest = pairs.where("turn > 1").join(floors.select("qb", "worst"), "qb").where(F.col("bound") >= F.col("worst")).drop("worst")
    found = first.unionByName(searched(rest, floors.select("qb", "floors")))

    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "dkey")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    hits = found.join(groups.select(F.col("key").alias("dkey"), "ids"), "dkey").select("qkey", "score", F.explode("ids").alias("vec_id"))
    near = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    lists = written(hits.withColumn("r", F.row_number().over(near)).groupBy("qkey", "score", "vec_id", "r").agg(F.lit(1).alias("_")).drop("_"), "topk-hits")
    by_query = asked.join(groups.select("v", "key", "ids"), "v").select("query_id", F.col("key").alias("qkey"))
    mine = by_query.join(lists, "qkey").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", F.col("score").cast("long"))


def _members(batches):
    for b in batches:
        for block, blob in zip(b["block"].to_pylist(), b["tree"], strict=True):
            keys = CoverTree.unpacked(blob.as_py()).keys
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(keys), pa.string()), pa.array(keys)], names=["qb", "key"])


def quantized(vector: str) -> Column:
    """floor(64 x) of each component, as a long; null where a component is null or not finite."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~bad, F.transform(x, lambda c: F.floor(c.cast("double") * 64).cast("long")))


def op5_topk_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantized("embedding").alias("v"))
    return top_k(rows, F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

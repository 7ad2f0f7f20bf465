"""Resampling of training rows: SMOTE, ADASYN, Tomek links. Draws are hashes; rows carry (id, y, v)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from journeyspark.functions.draws import uniform
from journeyspark.functions.lineage import written
from journeyspark.functions.order import numbered, place_in_class

from .neighbors import knn_join


def class_needs(df: DataFrame, y: str = "y") -> DataFrame:
    """(y, n, majority, need): rows that each class lacks to the largest one; classes of one row get none."""
    n = df.groupBy(y).agg(F.count("*").alias("n"))
    return n.withColumn("majority", F.max("n").over(Window.partitionBy())).withColumn("need", F.when(F.col("n") >= 2, F.col("majority") - F.col("n")).otherwise(0))


def _synthesize(draws: DataFrame, rows: DataFrame, near: DataFrame, seed: int, y: str) -> DataFrame:
    """draws: (y, base, key, at): a row for each new point, with the text its draws depend on and its number. The base moves towards one of its neighbours; ids are -1, -2, …"""
    count = near.groupBy("id").agg(F.count("*").alias("have"))
    picked = draws.join(count, draws["base"] == count["id"]).drop("id").withColumn("rank", (F.floor(uniform(seed, F.col("key"), "neighbour") * F.col("have")) + 1).cast("int"))
    picked = picked.join(near.select(F.col("id").alias("base"), "rank", "neighbour"), ["base", "rank"])
    a = rows.select(F.col("id").alias("base"), F.col("v").alias("va"))
    b = rows.select(F.col("id").alias("neighbour"), F.col("v").alias("vb"))
    moved = picked.join(a, "base").join(b, "neighbour").withColumn("g", uniform(seed, F.col("key"), "gap"))
    v = F.zip_with("va", F.zip_with("va", "vb", lambda x, z: (z - x)), lambda x, step: F.struct(x.alias("x"), step.alias("s")))
    return moved.select((-F.col("at") - 1).cast("long").alias("id"), y, F.transform(v, lambda p: p["x"] + F.col("g") * p["s"]).alias("v"), "base", "neighbour")


def _counted(draws: DataFrame, y: str, *more: str) -> DataFrame:
    """draws with key and at: their number in the order of label and `more`, so no two new points share an id, whatever labels and ids are."""
    keyed = draws.withColumn("key", F.concat_ws("-", y, *more)).withColumn("_turn", F.struct(y, *more))
    return numbered(keyed, "_turn", "draws").drop("_turn").withColumnRenamed("_at", "at")


def smote(df: DataFrame, k: int = 5, seed: int = 1, y: str = "y") -> DataFrame:
    """Original rows, and new ones (negative ids) for each class below the largest: a base drawn with replacement, towards one of its k nearest of the class. Labels may be of any type that has an order."""
    rows = df.select(F.col("id").cast("long"), y, F.col("v").cast("array<double>").alias("v"))
    need = class_needs(rows, y)
    slots = need.where("need > 0").select(y, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("need") - 1)).alias("s"))
    draws = _counted(slots, y, "s").withColumn("_rn", (F.floor(uniform(seed, F.col("key"), "base") * F.col("n")) + 1).cast("long"))
    short = rows.join(need.where("need > 0").select(y), y, "left_semi")
    placed = place_in_class(short.select(y, F.col("id").alias("base")), y, uniform(seed, F.col("base"), "turn"), "base")
    draws = written(draws.join(placed.select(y, "base", "_rn"), [y, "_rn"]).select(y, "base", "key", "at"), "draws")
    drawn = written(short.join(draws.select(F.col("base").alias("id")).distinct(), "id", "left_semi"), "drawn")
    near = written(knn_join(drawn, short, k, within=y), "near-drawn")
    return rows.unionByName(_synthesize(draws, rows, near, seed, y).select("id", y, "v"))


def tomek_links(df: DataFrame, rule: str = "either", y: str = "y") -> DataFrame:
    """(a, b): each row and its nearest row of another class, where that is at least as near as the nearest of the own class.

    rule "either": from one end's view or the other's; "mutual": the ends are each other's nearest of all rows.
    """
    rows = df.select("id", y, "v")
    cross = written(knn_join(rows, rows, 1, other=y), "nearest-other").select(F.col("id").alias("a"), F.col("neighbour").alias("b"), F.col("distance").alias("d"))
    same = written(knn_join(rows, rows, 1, within=y), "nearest-own").select("id", F.col("distance").alias("own"))
    both = cross.join(same.select(F.col("id").alias("a"), F.col("own").alias("oa")), "a", "left").join(same.select(F.col("id").alias("b"), F.col("own").alias("ob")), "b", "left")
    inf = F.lit(float("inf"))
    near_a, near_b = F.col("d") <= F.coalesce("oa", inf), F.col("d") <= F.coalesce("ob", inf)
    if rule == "either":
        return both.where(near_a | near_b).select("a", "b")
    back = cross.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return both.where(near_a & near_b).select("a", "b").join(back, ["a", "b"], "left_semi")


def drop_tomek(df: DataFrame, rule: str = "either", y: str = "y") -> DataFrame:
    links = tomek_links(df, rule, y)
    return df.join(links.select(F.col("a").alias("id")).union(links.select("b")).distinct(), "id", "left_anti")


def adasyn_budget(df: DataFrame, k: int = 5, y: str = "y") -> DataFrame:
    """(id, y, difficulty, budget): for rows below the largest class, how many new points they get.

    Difficulty: the share of the largest class (the first of equal ones) among the k nearest rows, itself included.
    A class's need is split by difficulty and rounded down; without difficulty it is split evenly.
    """
    need = written(class_needs(df, y), "class-needs")
    top = need.orderBy(F.desc("n"), y).limit(1).select(F.col(y).alias("top"))
    short = written(df.select("id", y, "v").join(need.where("need > 0").select(y), y, "left_semi"), "short")  # no others get new points
    near = knn_join(short, df, k, with_self=True).join(df.select(F.col("id").alias("neighbour"), F.col(y).alias("ny")), "neighbour").crossJoin(F.broadcast(top))  # one row
    hard = near.groupBy("id").agg(F.avg((F.col("ny") == F.col("top")).cast("double")).alias("difficulty"))
    rows = short.select("id", y).join(hard, "id").join(need.where("need > 0"), y)
    totals = rows.groupBy(y).agg(F.sum("difficulty").alias("total"), F.count("*").alias("rows"))
    share = F.when(F.col("total") > 0, F.col("difficulty") / F.col("total")).otherwise(1.0 / F.col("rows"))
    return rows.join(totals, y).select("id", y, "difficulty", F.floor(share * F.col("need") + 1e-9).cast("long").alias("budget"))


def adasyn(df: DataFrame, k: int = 5, seed: int = 1, y: str = "y") -> DataFrame:
    """Original rows, and new ones (negative ids) around the rows of smaller classes that the largest class surrounds, by `adasyn_budget`."""
    rows = df.select(F.col("id").cast("long"), y, F.col("v").cast("array<double>").alias("v"))
    budget = written(adasyn_budget(rows, k, y).where("budget > 0"), "budget")
    draws = budget.select(y, F.col("id").alias("base"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("budget") - 1)).alias("i"))
    short = rows.join(budget.select(y).distinct(), y, "left_semi")
    bases = written(rows.join(budget.select("id"), "id", "left_semi"), "bases")
    near = written(knn_join(bases, short, k, within=y), "near-bases")
    return rows.unionByName(_synthesize(_counted(draws, y, "base", "i"), rows, near, seed, y).select("id", y, "v"))


def smote_tomek(df: DataFrame, k: int = 5, seed: int = 1, y: str = "y", warn_above: float = 0.5) -> tuple[DataFrame, float, bool]:
    """SMOTE and then Tomek removal; the share of rows removed, and whether it is above the warning level."""
    grown = written(smote(df, k, seed, y), "grown")  # read several times below
    kept = written(drop_tomek(grown, y=y), "kept")
    n, m = grown.count(), kept.count()
    removed = 1 - m / n if n else 0.0
    return kept, removed, removed > warn_above


def resampler(kind: str | None, **options) -> Callable[[DataFrame], DataFrame]:
    """A function of training rows; nothing is resampled at prediction."""
    table = {None: lambda d: d, "none": lambda d: d, "smote": lambda d: smote(d, **options), "adasyn": lambda d: adasyn(d, **options), "smote_tomek": lambda d: smote_tomek(d, **options)[0]}
    return table[kind]

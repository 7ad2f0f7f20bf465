"""Next touch from the journey before it, whatever its length: a variable-order context tree.

A context is a run of past touches, newest first. Occurrences are counted once by their longest context; levels of the tree
are grouped from those counts, each kept only below contexts that are frequent enough. A context stays if what follows it
differs from what follows the shorter one, or if a longer one that stays needs it. Probabilities blend along the path: each level
adds a weight's worth of the shorter context's shares to its own counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from journeyspark.functions.lineage import written


@dataclass
class ContextTree:
    """nodes: (depth, context, n, gain); shares: (depth, context, target, c, prob) for every kept context and known target."""

    nodes: DataFrame
    shares: DataFrame
    max_len: int


def past_of(seq: Column, max_len: int) -> Column:
    """The newest `max_len` entries of a sequence, newest first."""
    return F.reverse(F.when(F.size(seq) > max_len, F.slice(seq, -max_len, max_len)).otherwise(seq))


def name_of(past: Column, depth: int) -> Column:
    """The context of so many past touches as text; '' for none."""
    return F.array_join(F.slice(past, 1, depth).cast("array<string>"), ",")


def occurrences(journeys: DataFrame, max_len: int, seq: str = "seq_touch", target: str | None = "target") -> DataFrame:
    """(past, next, c): how often each touch follows each run of up to max_len touches, at every place of every journey."""
    whole = F.concat(F.col(seq), F.array(target)) if target else F.col(seq)
    at = lambda x, i: F.struct(F.reverse(F.slice("_w", F.greatest(i - max_len, F.lit(0)) + 1, F.least(i, F.lit(max_len)))).alias("past"), x.alias("next"))
    steps = journeys.select(whole.alias("_w")).select(F.explode(F.transform("_w", at)).alias("s"))
    return steps.where("s.next is not null").groupBy("s.past", "s.next").agg(F.count("*").alias("c"))


def fit(journeys: DataFrame, max_len: int = 5, least: int = 2, worth: float | None = None, weight: float = 5.0, alpha: float = 1.0, seq: str = "seq_touch", target: str | None = "target") -> ContextTree:
    """A tree of contexts of up to max_len touches from training journeys (seq, target).

    least: a context is looked at from so many occurrences on. worth: a context stays from a gain on of so many nats of
    log likelihood over the shorter one (or below a longer one that stays); without it, as the Bayesian information criterion
    asks of its free shares, (targets - 1) / 2 * ln(occurrences). weight, alpha: of the blend and of the root.
    """
    all_ = written(occurrences(journeys, max_len, seq, target), "context-counts")
    levels: list[DataFrame] = []
    for depth in range(max_len + 1):
        own = all_.where(F.size("past") >= depth)
        if depth:  # only below frequent contexts
            wide = levels[-1].select(F.col("context").alias("parent")).distinct()
            own = own.withColumn("parent", name_of(F.col("past"), depth - 1)).join(wide, "parent", "left_semi")
        counts = own.groupBy(name_of(F.col("past"), depth).alias("context"), (name_of(F.col("past"), depth - 1) if depth else F.lit(None).cast("string")).alias("parent"), F.col("next").alias("target")).agg(F.sum("c").alias("c"))
        counts = counts.withColumn("n", F.sum("c").over(Window.partitionBy("context")))
        levels.append(written(counts if depth == 0 else counts.where(F.col("n") >= least), f"contexts-{depth}"))

    if worth is None:
        told = levels[0].agg(F.count("*").alias("k"), F.sum("c").alias("n")).first()
        worth = (told["k"] - 1) / 2 * math.log(told["n"] or 1)
    gains, kept = [], [None] * (max_len + 1)
    for depth in range(1, max_len + 1):
        above = levels[depth - 1].select(F.col("context").alias("p"), F.col("target").alias("t"), (F.col("c") / F.col("n")).alias("share"))
        each = levels[depth].join(above, (F.col("parent") == F.col("p")) & (F.col("target") == F.col("t")))
        gain = F.sum(F.col("c") * F.log(F.col("c") / F.col("n") / F.col("share")))
        gains.append(written(each.groupBy("context", "parent").agg(F.max("n").alias("n"), gain.alias("gain")), f"gains-{depth}"))
    for depth in range(max_len, 0, -1):
        stays = F.col("gain") >= worth
        if depth < max_len:
            needed = kept[depth + 1].select(F.col("parent").alias("needed")).distinct()
            own = gains[depth - 1].join(needed, F.col("context") == F.col("needed"), "left").where(stays | F.col("needed").isNotNull()).drop("needed")
        else:
            own = gains[depth - 1].where(stays)
        kept[depth] = written(own, f"kept-{depth}")

    k, every = F.count("*").over(Window.partitionBy()), F.sum("c").over(Window.partitionBy())  # a row for each target
    shares = levels[0].select(F.lit(0).alias("depth"), F.lit("").alias("context"), "target", "c", ((F.col("c") + alpha) / (every + alpha * k)).alias("prob"))
    parts = [written(shares, "shares-0")]
    nodes = [levels[0].groupBy().agg(F.sum("c").alias("n")).where("n is not null").select(F.lit(0).alias("depth"), F.lit("").alias("context"), "n", F.lit(None).cast("double").alias("gain"))]
    for depth in range(1, max_len + 1):
        above = parts[-1].select(F.col("context").alias("parent"), "target", F.col("prob").alias("shorter"))
        own = kept[depth].join(above, "parent").join(levels[depth].select("context", "target", "c"), ["context", "target"], "left")
        prob = (F.coalesce("c", F.lit(0)) + weight * F.col("shorter")) / (F.col("n") + weight)
        parts.append(written(own.select(F.lit(depth).alias("depth"), "context", "target", F.coalesce("c", F.lit(0)).alias("c"), prob.alias("prob")), f"shares-{depth}"))
        nodes.append(kept[depth].select(F.lit(depth).alias("depth"), "context", "n", "gain"))
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    return ContextTree(written(union(nodes), "context-nodes"), written(union(parts), "context-shares"), max_len)


def contexts_of(rows: DataFrame, tree: ContextTree, seq: str = "seq_touch") -> DataFrame:
    """(past, context, depth): the longest kept context of each different past of rows."""
    pasts = rows.select(past_of(F.col(seq), tree.max_len).alias("past")).distinct()
    each = pasts.select("past", F.explode(F.sequence(F.lit(0), F.size("past"))).alias("depth"))
    named = each.withColumn("context", F.array_join(F.transform(F.slice("past", F.lit(1), F.col("depth")), lambda x: x.cast("string")), ","))
    return named.join(tree.nodes.select("depth", "context"), ["depth", "context"]).groupBy("past").agg(F.max_by("context", "depth").alias("context"), F.max("depth").alias("depth"))


def score(rows: DataFrame, tree: ContextTree, id_: str = "id", seq: str = "seq_touch") -> DataFrame:
    """(id, target, prob): the shares of each row's longest kept context, for every known target."""
    found = contexts_of(rows, tree, seq)
    lists = tree.shares.groupBy("depth", "context").agg(F.collect_list(F.struct("target", "prob")).alias("all"))
    own = found.join(lists, ["depth", "context"]).select("past", "all")
    keyed = rows.select(F.col(id_).alias("id"), past_of(F.col(seq), tree.max_len).alias("past"))
    return keyed.join(own, "past").select("id", F.inline("all"))


def log_loss(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """(n, log_loss): mean of -ln of the share given to what came; truth is (id, target). Targets that no share covers count as the least double."""
    got = truth.join(scored.select("id", "target", "prob"), ["id", "target"], "left")
    return got.agg(F.count("*").alias("n"), F.avg(-F.log(F.coalesce("prob", F.lit(2.3e-308)))).alias("log_loss"))

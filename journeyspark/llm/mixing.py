"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks: ranges of the hash of its documents, of about `block_words` words. A source's
target turns into an exact quota of blocks: whole passes over the source, and the first blocks of one more, of
which the last is filled by first fit. A binary tree over the output shards splits the vector of quotas: each
node draws its left child's share from a multivariate hypergeometric distribution, so every shard gets a random
composition and all quotas come out exactly. Each shard then takes the next blocks of each source in that
source's permuted order (so shards are disjoint), and orders its documents by a hash of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ranked, renamed, table, written

#: A source has at most this many blocks; those of larger sources grow.
MOST_BLOCKS = 1 << 20
#: So many shards of a group are drawn at a time.
STRIDE = 64


def n_words(text: Column) -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle(at: Column, *weights: float) -> Column:
    """The weight of a source by its place in the order of sources: the given ones in turn."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))


def with_targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """sources (_n words, _w weight) with _target: their words in all, shared by weight; none is above `most` times its size, the excess goes to the others by weight.

    A source is closed at its limit when its share reaches it. Closing sources raises the others' share, so the closed
    ones are always those below one rising share, and each round is one sum over the sources.
    """
    limit, full = F.col("_n") * most, lambda share: F.col("_w") * share > F.col("_n") * most
    open_ = F.col("_n") > 0
    first = sources.agg(F.sum("_n").alias("total"), F.sum(F.when(open_, F.col("_w"))).alias("w")).first()
    total, share, closed = float(first["total"] or 0), float(first["total"] or 0) / (first["w"] or 1.0), 0
    while True:
        got = sources.where(open_).agg(F.count_if(full(share)).alias("closed"), F.sum(F.when(full(share), limit)).alias("held"), F.sum(F.when(~full(share), F.col("_w"))).alias("w")).first()
        if got["closed"] == closed or not got["w"]:
            break
        closed, share = got["closed"], (total - got["held"]) / got["w"]
    return sources.withColumn("_target", F.when(~open_, 0.0).when(full(share), limit).otherwise(F.col("_w") * share).cast("double"))


def split_path(quotas: np.ndarray, totals: np.ndarray, group: int, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A leaf of the splitting tree: for each source of a group, its first block (in permuted order) and its number of blocks.

    Any task finds the same draw at a node, since the node alone seeds it; a leaf needs log2(shards) draws. A node first
    shares its blocks between the groups of sources, whose blocks are `totals`, and then within the group: the same
    distribution as one draw over all sources.
    """
    all_ = int(totals.sum())
    at = lambda k: all_ * k // shards  # noqa: E731  blocks that shards 0..k-1 hold together
    first, have, rest, lo, hi = np.zeros(len(quotas), np.int64), quotas.astype(np.int64), totals.astype(np.int64), 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        groups = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(rest, at(mid) - at(lo), method="marginals")
        left = np.random.default_rng([seed, lo, hi, group + 1]).multivariate_hypergeometric(have, int(groups[group]), method="marginals")
        if shard < mid:
            have, rest, hi = left, groups, mid
        else:
            first, have, rest, lo = first + left, have - left, rest - groups, mid
    return first, have


def mix(docs: DataFrame, weights=lambda at: cycle(at, 5, 2, 1), shard_words: int = 4_000_000, least_shards: int = 8, block_words: int = 65_536, seed: int = 1, text: str = "text", source: str = "source", doc_id: str = "doc_id", most: float = 3.0, group: int = 4096) -> DataFrame:
    """Every document with its places in the mix.

    weights: from a column with the sources' places (0, 1, … by code point, null last) to their weights. Adds `size`
    (words), `source_size`, `target` (words) and `places`: an array of (copy, shard), one for each time that the mix takes
    the document; empty if it doesn't. Columns of these names that come in are replaced, all others stay.
    `mixed_documents()` turns places into rows.

    Shards hold about `shard_words` words each, so their number grows with the documents. Sources may be of any number:
    they are a table, and the tree draws for `group` of them at a time; one number per group passes through the driver.

    Null texts have size 0 and are taken like others, at no cost. Rows that are equal in id, text and source are
    taken or left together. An empty table gives an empty result. Reruns agree, whatever the partitioning.
    """
    spark = docs.sparkSession
    base, name, back = renamed(docs, [c for c in docs.columns if c not in ("size", "source_size", "target", "places")])
    identity, words = F.xxhash64(F.lit(seed), F.col(name[doc_id]), F.xxhash64(F.col(name[text]))), n_words(F.col(name[text]))
    slim = written(base.select(F.col(name[source]).alias("_source"), identity.alias("_h"), words.alias("_size")), "mix-sizes")

    per = slim.groupBy(F.col("_source").alias("_name")).agg(F.sum("_size").alias("_n")).withColumn("_order", F.struct(F.col("_name").isNull(), "_name"))
    per = written(ranked(per, None, "_order", "mix-order").select(F.col("_at").alias("_k"), "_name", "_n", weights(F.col("_at")).alias("_w")), "mix-sources")
    # A source without words is taken once, for nothing.
    passes = F.when(F.col("_n") > 0, F.floor(F.col("_target") / F.col("_n"))).otherwise(1)
    dims = with_targets(per, most).withColumn("_passes", passes.cast("int")).withColumn("_rest", F.when(F.col("_n") > 0, F.col("_target") - F.col("_passes") * F.col("_n")).otherwise(0.0))
    dims = written(dims.withColumn("_blocks", F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("_n") / block_words))).cast("long")).drop("_w"), "mix-targets")

    def placed(df: DataFrame) -> DataFrame:
        """With the source's numbers and the block: the top 52 bits of the hash, scaled to the source's blocks."""
        share = F.shiftrightunsigned("_h", 12).cast("double") / F.lit(float(1 << 52))
        return df.join(dims, df["_source"].eqNullSafe(dims["_name"]), "left").withColumn("_block", F.floor(share * F.col("_blocks")).cast("long"))

    # Blocks of the last, partial pass: all before the boundary block, and in that one what fits.
    blocks = written(placed(slim).groupBy("_k", "_block").agg(F.sum("_size").alias("_words"), F.first("_passes").alias("_passes"), F.first("_rest").alias("_rest")), "mix-blocks")
    before = F.sum("_words").over(Window.partitionBy("_k").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("_room", F.col("_rest") - F.coalesce(before, F.lit(0)))
    edge = written(blocks.where((F.col("_room") > 0) & (F.col("_room") < F.col("_words"))).select(F.col("_k").alias("_ek"), F.col("_block").alias("_edge"), F.col("_room").alias("_eroom")), "mix-edges")

    def first_fit(pdf: pd.DataFrame) -> pd.DataFrame:
        room, take = float(pdf["_eroom"].iloc[0]), []
        pdf = pdf.sort_values("_h", kind="stable")
        for size in pdf["_size"].tolist():
            take.append(size <= room)
            room -= size if size <= room else 0
        return pdf.loc[take, ["_k", "_h"]]

    here = placed(slim)
    units = here.join(edge, (here["_k"] == edge["_ek"]) & (here["_block"] == edge["_edge"])).groupBy("_k", "_h").agg(F.sum("_size").alias("_size"), F.first("_eroom").alias("_eroom"))
    fits = written(units.groupBy("_k").applyInPandas(first_fit, "_k bigint, _h bigint"), "mix-fits").select(F.col("_k").alias("_fk"), F.col("_h").alias("_fh"), F.lit(True).alias("_fit"))

    # One row for each block that the mix takes, in each source's permuted order.
    drawn = blocks.withColumn("_copies", F.col("_passes") + F.when(F.col("_room") > 0, 1).otherwise(0)).where("_copies > 0")
    drawn = drawn.select("_k", "_block", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"))
    order = Window.partitionBy("_k").orderBy(F.xxhash64(F.lit(seed), "_k", "_block", "_copy"), "_block", "_copy")
    drawn = drawn.withColumn("_at", F.row_number().over(order).cast("long") - 1)
    drawn = written(drawn, "mix-blocks-taken")
    quotas = drawn.groupBy("_k").agg(F.count("*").alias("n")).groupBy(F.floor(F.col("_k") / group).alias("_g")).agg(F.sort_array(F.collect_list(F.struct("_k", "n"))).alias("own"), F.sum("n").alias("n"))
    quotas = written(quotas, "mix-quotas")
    groups = quotas.select("_g", "n").orderBy("_g").collect()
    totals, place = np.array([r["n"] for r in groups], np.int64), {r["_g"]: i for i, r in enumerate(groups)}
    shards = max(least_shards, -(-int(per.agg(F.sum("_n")).first()[0] or 0) // shard_words))

    def leaves(batches):
        for pdf in batches:
            for g, own, lo in zip(pdf["_g"], pdf["own"], pdf["lo"], strict=True):
                k, n = (np.array([r[c] for r in own], np.int64) for c in ("_k", "n"))
                for j in range(lo, min(lo + STRIDE, shards)):
                    first, count = split_path(n, totals, place[g], shards, j, seed)
                    on = np.flatnonzero(count)
                    yield pd.DataFrame({"_k": k[on], "_shard": np.int32(j), "_first": first[on], "_count": count[on]})

    ranges = quotas.select("_g", "own", F.explode(F.sequence(F.lit(0), F.lit(shards - 1), F.lit(STRIDE))).alias("lo"))
    leaf = ranges.repartition(F.col("_g"), F.col("lo")).mapInPandas(leaves, "_k bigint, _shard int, _first bigint, _count bigint")
    seats = leaf.select("_k", "_shard", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_count") - 1)).alias("_at"))
    plan = drawn.join(seats, ["_k", "_at"]).groupBy("_k", "_block").agg(F.sort_array(F.collect_list(F.struct(F.col("_copy").alias("copy"), F.col("_shard").alias("shard")))).alias("_seats"))
    plan = written(plan, "mix-plan").select(F.col("_k").alias("_pk"), F.col("_block").alias("_pblock"), "_seats")

    full = placed(base.withColumns({"_source": F.col(name[source]), "_h": identity, "size": words}))
    full = full.join(edge, full["_k"] == edge["_ek"], "left")
    full = full.join(fits, (full["_k"] == fits["_fk"]) & (full["_h"] == fits["_fh"]), "left").join(plan, (F.col("_k") == plan["_pk"]) & (F.col("_block") == plan["_pblock"]), "left")
    partly = (F.col("_block") == F.col("_edge")) & F.col("_fit").isNull()
    seats_of = F.coalesce("_seats", F.array().cast("array<struct<copy:int,shard:int>>"))
    places = F.filter(seats_of, lambda s: ~F.coalesce(partly & (s["copy"] == F.col("_passes")), F.lit(False)))
    return full.select(*back, "size", F.col("_n").alias("source_size"), F.col("_target").alias("target"), places.alias("places", metadata={"shards": shards}))


def mixed_documents(mixed: DataFrame, keep: list[str], seed: int = 1, most_tasks: int = 20_000) -> DataFrame:
    """A row for each time that the mix takes a document: its columns, shard and copy, dealt out and shuffled by shard.

    A task has one shard, or few; only beyond `most_tasks` shards, more.
    """
    shards = mixed.schema["places"].metadata.get("shards", 1)
    base, name, back = renamed(mixed, keep)
    rows = base.select(*[name[c] for c in keep], F.explode(name["places"]).alias("_p")).select(*[name[c] for c in keep], F.col("_p.shard").alias("_shard"), F.col("_p.copy").alias("_copy"))
    dealt = rows.repartition(min(shards, most_tasks), "_shard").sortWithinPartitions("_shard", F.xxhash64(F.lit(seed), *[name[c] for c in keep], "_copy"))
    return dealt.select(*back, "_shard", "_copy")


def op1_mixing(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("places")).alias("taken"))

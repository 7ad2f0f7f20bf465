"""Prefix trie of conversations, with totals over every subtree by parallel tree contraction.

A node is a sequence of turns; its key is the exclusive or of fingerprints of (place, turn), so the keys of all
prefixes of a conversation come from one running aggregate, which also goes over ranges of a very long conversation.
Totals come by contraction: each round first compresses every chain of nodes with one child into its lower end
(pointers double, so a chain takes as many steps as the logarithm of its length), then rakes all leaves into
their parents. What is left has less than half the nodes, whatever the tree's depth. Then the rounds are gone through
backwards, and each node of a chain gets its total from that of the chain's lower end.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, table, written
from .mixing import n_words

#: So many ids of one node are joined to a text at a time.
SLICE = 10_000
#: More doublings or rounds than these mean that the links go in a circle.
MOST_ROUNDS = 100


def subtree_sums(tree: DataFrame, node: str, parent: str, values: list[str]) -> DataFrame:
    """(node, values…): the sum of each value over each node's subtree, the node included.

    tree: a row for each node, with its parent's (null: a root); any number of roots. Values are numbers without nulls.
    Links that go in a circle or nodes without a row are an error or get no total.
    """
    k = range(len(values))
    own, edge = [f"a{i}" for i in k], [f"e{i}" for i in k]
    zero = [(F.col(v) - F.col(v)).alias(e) for v, e in zip(values, edge, strict=True)]
    # edge: the sum over nodes that were contracted between a node and its parent.
    live = written(tree.select(F.col(node).alias("id"), F.col(parent).alias("up"), *[F.col(v).alias(a) for v, a in zip(values, own, strict=True)], *zero), "trie-live")
    raked, chains = [], []
    for _ in range(MOST_ROUNDS):
        if live.isEmpty():
            break
        kids = live.where("up is not null").groupBy(F.col("up").alias("of")).agg(F.count("*").alias("kids"), F.min("id").alias("only"), *[F.sum(e).alias(f"k{e}") for e in edge])
        state = written(live.join(kids, F.col("id") == F.col("of"), "left").drop("of"), "trie-state")

        unary = state.where("kids = 1")
        jumps = written(unary.select(F.col("id").alias("u"), F.col("only").alias("to"), *[(F.col(a) + F.col(f"k{e}")).alias(f"s{i}") for i, (a, e) in enumerate(zip(own, edge, strict=True))], F.lit(True).alias("open")), "trie-chains")
        left = jumps.count()
        for _ in range(MOST_ROUNDS):
            if not left:
                break
            after = jumps.select(F.col("u").alias("u2"), F.col("to").alias("to2"), *[F.col(f"s{i}").alias(f"t{i}") for i in k], F.col("open").alias("open2"))
            on = F.col("u2").isNotNull()
            step = jumps.where("open").join(after, F.col("to") == F.col("u2"), "left").select("u", F.when(on, F.col("to2")).otherwise(F.col("to")).alias("to"), *[F.when(on, F.col(f"s{i}") + F.col(f"t{i}")).otherwise(F.col(f"s{i}")).alias(f"s{i}") for i in k], (on & F.col("open2")).alias("open"))
            jumps = written(step.unionByName(jumps.where("not open")), "trie-chains")
            left = jumps.where("open").count()
        else:
            raise ValueError("links go in a circle")
        chains.append(jumps.select("u", "to", *[f"s{i}" for i in k]))

        # The lower end of a chain takes the place of its top, with what lies between on its edge.
        tops = unary.join(unary.select(F.col("id").alias("above")), F.col("up") == F.col("above"), "left_anti").select(F.col("id").alias("top"), F.col("up").alias("new_up"), *[F.col(e).alias(f"n{e}") for e in edge])
        ends = tops.join(jumps, F.col("top") == F.col("u")).select("to", "new_up", *[(F.col(f"ne{i}") + F.col(f"s{i}")).alias(f"ne{i}") for i in k])
        moved = F.col("to").isNotNull()
        linked = state.where("kids is null or kids > 1").join(ends, F.col("id") == F.col("to"), "left")
        linked = written(linked.select("id", F.when(moved, F.col("new_up")).otherwise(F.col("up")).alias("up"), *own, *[F.when(moved, F.col(f"n{e}")).otherwise(F.col(e)).alias(e) for e in edge], F.col("kids").isNull().alias("leaf")), "trie-linked")

        leaves = linked.where("leaf")
        raked.append(leaves.select("id", *own))
        gain = leaves.where("up is not null").groupBy(F.col("up").alias("of")).agg(*[F.sum(F.col(a) + F.col(e)).alias(f"g{i}") for i, (a, e) in enumerate(zip(own, edge, strict=True))])
        more = linked.where("not leaf").join(gain, F.col("id") == F.col("of"), "left")
        live = written(more.select("id", "up", *[(F.col(a) + F.coalesce(f"g{i}", F.lit(0))).alias(a) for i, a in enumerate(own)], *edge), "trie-live")
    else:
        raise ValueError("links go in a circle")

    if not raked:
        return tree.select(F.col(node), *values)
    known = raked[0]
    for part in raked[1:]:
        known = known.unionByName(part)
    for part in reversed(chains):
        found = part.join(known.select("id", *own), F.col("to") == F.col("id")).select(F.col("u").alias("id"), *[(F.col(f"s{i}") + F.col(a)).alias(a) for i, a in enumerate(own)])
        known = known.unionByName(written(found, "trie-totals"))
    return known.select(F.col("id").alias(node), *[F.col(a).alias(v) for a, v in zip(own, values, strict=True)])


def turns_of(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, print, words): a row for each turn, at 0, 1, … by turn (null first), with a digest of role and text and the text's words.

    Null roles and texts are empty. Turns of one number go by their digest, so equal ones may change places. Rows
    without a conversation are left out.
    """
    who, said = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digest = F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said).cast("binary"))
    slim = df.where(F.col(f"`{conv_id}`").isNotNull()).select(F.col(f"`{conv_id}`").cast("long").alias("conv"), F.struct(F.col(f"`{turn}`").alias("t"), digest.alias("h")).alias("order"), digest.alias("print"), n_words(said).alias("words"))
    return ranked(slim, "conv", "order", "trie-turns").select("conv", F.col("_at").cast("long").alias("at"), "print", "words")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations, their turns): conversation c starts with the first h turns of c - c % every, then goes on with its own after the first h.

    h is the unsigned crc32 of c's digits, modulo `most`. A conversation that is left without turns stays one.
    """
    turns = written(turns, "trie-numbered")
    own = turns.groupBy("conv").agg((F.max("at") + 1).alias("n"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = own.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    bases = own.where(f"conv % {every} = 0").select(F.col("conv").alias("b"), F.least(F.col("n"), F.lit(most)).alias("bn"))
    convs = written(convs.join(bases, F.col("base") == F.col("b"), "left").select("conv", "h", "base", F.least(F.col("h"), F.coalesce("bn", F.lit(0))).alias("taken")), "trie-convs")
    first = turns.where(f"conv % {every} = 0 and at < {most}").select(F.col("conv").alias("b"), "at", "print", "words")
    heads = convs.join(first, (F.col("base") == F.col("b")) & (F.col("at") < F.col("h"))).select("conv", "at", "print", "words")
    rest = turns.join(convs.select(F.col("conv").alias("c"), "h", "taken"), F.col("conv") == F.col("c")).where("at >= h")
    return convs.select("conv"), heads.unionByName(rest.select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "print", "words"))


def _prefix_keys(turns: DataFrame) -> DataFrame:
    """turns with depth (from 1), k0, k1: the key of the prefix that ends here, and p0, p1: that of the one before."""
    digest = F.md5(F.concat(F.col("at").cast("string"), F.lit(":"), F.col("print")).cast("binary"))
    half = lambda lo: F.conv(F.substring(digest, lo, 16), 16, -10).cast("long")
    cut = turns.select("conv", "at", "words", half(1).alias("f0"), half(17).alias("f1")).repartitionByRange("conv", "at").withColumn("part", F.spark_partition_id())
    cut = written(cut, "trie-prints")
    held = cut.groupBy("conv", "part").agg(F.bit_xor("f0").alias("x0"), F.bit_xor("f1").alias("x1"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("conv").alias("c"), F.col("part").alias("of"), *[F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(x) for x in ("x0", "x1")])
    inside = Window.partitionBy("conv", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumns({"i0": F.bit_xor("f0").over(inside), "i1": F.bit_xor("f1").over(inside)})
    keyed = cut.join(held, (F.col("conv") == F.col("c")) & (F.col("part") == F.col("of")))
    key = [F.col(f"i{j}").bitwiseXOR(F.col(f"x{j}")) for j in (0, 1)]
    return keyed.select("conv", (F.col("at") + 1).alias("depth"), "words", *[key[j].alias(f"k{j}") for j in (0, 1)], *[key[j].bitwiseXOR(F.col(f"f{j}")).alias(f"p{j}") for j in (0, 1)])


NODE = ["depth", "k0", "k1"]


def id_digests(ends: DataFrame, by: list[str], conv: str = "conv") -> DataFrame:
    """(by…, digest): the lower-case SHA-256 of the decimal ids of each group, ascending and comma-joined.

    Ids are sorted in ranges and joined a slice at a time; the hash, which can't be split, then reads a group's slices in order.
    """
    cut = written(ends.repartitionByRange(*by, conv).withColumn("part", F.spark_partition_id()), "trie-ends")
    place = F.row_number().over(Window.partitionBy(*by, "part").orderBy(conv)) - 1
    parts = cut.withColumn("slice", F.floor(place / SLICE)).groupBy(*by, "part", "slice").agg(F.array_join(F.transform(F.sort_array(F.collect_list(conv)), lambda c: c.cast("string")), ",").alias("ids"))
    parts = parts.repartition(*by).sortWithinPartitions(*by, "part", "slice").select(F.struct(*by).alias("of"), "ids")

    def hashed(batches):
        last, h = None, None
        for b in batches:
            done, digests = [], []
            for of, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if last is not None and of == last:
                    h.update(b",")
                else:
                    if last is not None:
                        done.append(last)
                        digests.append(h.hexdigest())
                    last, h = of, hashlib.sha256()
                h.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done, b.schema.field(0).type), pa.array(digests, pa.string())], names=["of", "digest"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], b.schema.field(0).type), pa.array([h.hexdigest()])], names=["of", "digest"])

    out = parts.mapInArrow(hashed, f"of {parts.schema['of'].dataType.simpleString()}, digest string")
    return out.select(*[F.col(f"of.{c}").alias(c) for c in by], "digest")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node of the trie.

    convs: (conv), each conversation once; turns: (conv, at, print, words), at without gaps from 0. Conversations
    without turns are members of the root alone. A node's conv_id is its smallest member; with its depth that tells it. saved_tokens
    counts, over the subtree, the words of each node's last turn once for each member but the first. No conversations: no nodes.
    """
    members = written(_prefix_keys(turns), "trie-members")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k0"), F.lit(0).cast("long").alias("k1"), "conv", "n_convs", F.lit(None).cast("long").alias("p0"), F.lit(None).cast("long").alias("p1"), F.lit(0).cast("long").alias("words"))
    nodes = members.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("p0").alias("p0"), F.max("p1").alias("p1"), F.max("words").alias("words"))
    nodes = written(nodes.unionByName(root), "trie-nodes")

    last = members.groupBy("conv").agg(F.max_by(F.struct(*NODE), "depth").alias("n")).select(F.col("conv").alias("c"), "n")
    ends = convs.join(last, F.col("conv") == F.col("c"), "left").select("conv", *[F.coalesce(F.col(f"n.{c}"), F.lit(0)).alias(c) for c in NODE])
    digests = id_digests(ends, NODE).select(*[F.col(c).alias(f"d_{c}") for c in NODE], "digest")

    above = nodes.select(F.col("depth").alias("pd"), F.col("k0").alias("q0"), F.col("k1").alias("q1"), F.col("conv").alias("parent"))
    linked = nodes.join(above, (F.col("depth") - 1 == F.col("pd")) & (F.col("p0") == F.col("q0")) & (F.col("p1") == F.col("q1")), "left")
    name = lambda conv, depth: F.when(conv.isNotNull(), F.concat_ws(":", depth.cast("string"), conv.cast("string")))
    linked = linked.join(digests, (F.col("depth") == F.col("d_depth")) & (F.col("k0") == F.col("d_k0")) & (F.col("k1") == F.col("d_k1")), "left")
    linked = written(linked.select("conv", "depth", "parent", "n_convs", "words", name(F.col("conv"), F.col("depth")).alias("id"), name(F.col("parent"), F.col("pd")).alias("up"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("digest")), "trie-tree")

    children = linked.where("up is not null").groupBy(F.col("up").alias("of")).agg(F.count("*").alias("n_children"))
    tree = written(linked.join(children, F.col("id") == F.col("of"), "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": F.col("n_children").isNull().cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}), "trie-nodes-linked")
    sums = subtree_sums(tree, "id", "up", ["n_leaves", "saved"]).select(F.col("id").alias("of_id"), F.col("n_leaves").alias("leaves"), F.col("saved").alias("saved_tokens"))
    out = tree.join(sums, F.col("id") == F.col("of_id"))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), "saved_tokens", F.col("digest").alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie(*rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


ORACLE_SQL = r"""
WITH RECURSIVE bits(b, v, k) AS (
  SELECT b::BIGINT, b::BIGINT, 0 FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
               {'r': coalesce(role, ''), 't': coalesce(text, '')} AS turn FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 20 AS base,
                 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                                 lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1])), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM own), crc),
seqs AS (SELECT c, (SELECT coalesce(list(turn ORDER BY pos), []) FROM own b WHERE b.c = convs.base AND b.pos < convs.h)
                || (SELECT coalesce(list(turn ORDER BY pos), []) FROM own o WHERE o.c = convs.c AND o.pos >= convs.h) AS s FROM convs),
members AS (SELECT c, d, s[1:d] AS k, len(s) = d AS ends FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM seqs)),
nodes AS (SELECT d, k, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS ids,
                 (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].t, '[^\x20\x09-\x0D]+')) END AS saved FROM members GROUP BY d, k),
kids AS (SELECT k[1:d - 1] AS pk, d - 1 AS pd, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT n.*, coalesce(kids.n, 0) AS kids FROM nodes n LEFT JOIN kids ON kids.pd = n.d AND kids.pk = n.k),
sums AS (SELECT d, k, sum(leaf)::BIGINT AS leaves, sum(saved)::BIGINT AS saved
         FROM (SELECT j AS d, k[1:j] AS k, (kids = 0)::INT AS leaf, saved FROM (SELECT *, unnest(range(d + 1)) AS j FROM full_)) GROUP BY d, k)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, p.c AS parent_conv_id, f.n::BIGINT AS n_convs, f.kids::BIGINT AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, sha256(f.ids) AS ends_sha256
FROM full_ f JOIN sums s ON s.d = f.d AND s.k = f.k LEFT JOIN nodes p ON p.d = f.d - 1 AND p.k = f.k[1:f.d - 1]
"""

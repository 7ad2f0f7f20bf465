"""N-gram Jaccard join by count-vector R-trees.

A document is its set of word shingles. A pair at the threshold must share a shingle among the first few of
both sets, in any one order of all shingles; documents are dealt into groups by such shingles (rare ones come
first in the order). In each group the shingles are hashed into classes (more for larger sets), a document becomes
the point of its counts per class, and an R-tree packs the points: the sum of the coordinate minima of two
points, or of the upper corners of two boxes, bounds the overlap. What survives is verified on the sets.

Links only matter for the classes they form: documents with equal sets are one node, and a pair that is already
connected inside its group is not verified again, so large groups of copies cost little more than small ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, mix64, shipped, sliced, table, written

LEAF, FANOUT = 32, 16


def shingles(text: str | None, k: int) -> np.ndarray:
    """64-bit hashes of the distinct k-word shingles of the whole text, A-Z lower-cased, in ascending order.

    With fewer than k words the whole sequence is one shingle; without words there is none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower() knows A-Z only
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(h))
    out = h[: len(h) - width + 1] + np.uint64(width)
    for i in range(1, width):
        out = mix64(out) * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i]
    return np.unique(mix64(out).view(np.int64))


def need(a, b, percent: int):
    """The least overlap of sets of a and b elements that links them: percent of the union."""
    return -(-percent * (a + b) // (100 + percent))


def n_classes(n: int) -> int:
    """Classes for a set of n shingles: a power of two of about n / 8, so counts tell unrelated sets of any size apart."""
    return 1 << min(12, max(6, (max(1, n) // 8).bit_length()))


def counts(s: np.ndarray, classes: int) -> np.ndarray:
    """How many shingles of a set are in each class of hashes. With half the classes, each half's counts add up."""
    return np.bincount(s & (classes - 1), minlength=classes)


def folded(point: np.ndarray, classes: int) -> np.ndarray:
    return point.reshape(-1, classes).sum(0, dtype=np.int64)


def packed(point: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the first byte tells how many."""
    width = 1 if point.max(initial=0) < 1 << 8 else 2 if point.max() < 1 << 16 else 4
    return bytes([width]) + point.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def hopeful_of(points: list[np.ndarray], percent: int, labels: np.ndarray | None = None) -> np.ndarray:
    """Which points have a possible partner (of another label, if given). Sets that can link have as many classes, or one twice the other's."""
    sizes, out = np.array([len(p) for p in points]), np.zeros(len(points), bool)
    for level in np.unique(sizes).tolist():
        at = np.flatnonzero((sizes == level) | (sizes == 2 * level))
        if len(at) > 1:
            out[at] |= CountTree(np.stack([folded(points[i], level) for i in at])).hopeful(percent, None if labels is None else labels[at])
    return out


class CountTree:
    """An R-tree, packed by size and then by one coordinate, over points whose coordinates add up to the sets' sizes."""

    def __init__(self, points: np.ndarray):
        points, n = points.astype(np.int32), points.sum(1, dtype=np.int64)
        slab = max(LEAF, int(math.sqrt(len(n) / LEAF)) * LEAF)
        by_size = np.argsort(n, kind="stable")
        wide = int(points.var(0).argmax()) if len(n) else 0
        self.order = np.concatenate([np.zeros(0, int), *(c[np.argsort(points[c, wide], kind="stable")] for c in (by_size[i : i + slab] for i in range(0, len(n), slab)))]).astype(int)
        self.points, self.n = points[self.order], n[self.order]
        self.leaves = self._boxes(np.arange(0, len(n), LEAF), self.points, self.n, self.n)
        self.inner = self._boxes(np.arange(0, len(self.leaves[0]), FANOUT), *self.leaves)

    @staticmethod
    def _boxes(starts: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray):
        """Of each run of rows from starts: the upper corner, the smallest and the largest set."""
        if not len(starts):
            return high[:0], least[:0], most[:0]
        return np.maximum.reduceat(high, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)

    def _reach(self, boxes, corner, low: int, top: int, percent: int) -> np.ndarray:
        """Which boxes may hold a partner of a box with this upper corner and these sizes."""
        high, least, most = boxes
        fits = (100 * most >= percent * low) & (100 * top >= percent * least)
        on = np.flatnonzero(fits)
        return on[np.minimum(high[on], corner).sum(1) >= need(low, least[on], percent)]

    def partners(self, leaf: int, percent: int, skip=lambda lo, hi, a, b: False):
        """Pairs (i, j) of rows in tree order, i in the leaf and j in it or a later one, that the bounds allow: two arrays for each leaf met."""
        high, least, most = (x[leaf] for x in self.leaves)
        lo, hi = leaf * LEAF, min(len(self.n), (leaf + 1) * LEAF)
        for node in self._reach(self.inner, high, least, most, percent):
            if (node + 1) * FANOUT <= leaf:
                continue
            part = slice(node * FANOUT, (node + 1) * FANOUT)
            for other in node * FANOUT + self._reach(tuple(x[part] for x in self.leaves), high, least, most, percent):
                a, b = other * LEAF, min(len(self.n), (other + 1) * LEAF)
                if other < leaf or skip(lo, hi, a, b):
                    continue
                both = np.minimum(self.points[lo:hi, None, :], self.points[None, a:b, :]).sum(2)
                ok = both >= need(self.n[lo:hi, None], self.n[None, a:b], percent)
                i, j = np.nonzero(ok)
                i, j = i + lo, j + a
                yield i[i < j], j[i < j]

    def hopeful(self, percent: int, labels: np.ndarray | None = None) -> np.ndarray:
        """Which points have a partner (of another label) that the bounds allow."""
        on = np.zeros(len(self.n), bool)
        for leaf in range(len(self.leaves[0])):
            for i, j in self.partners(leaf, percent, lambda lo, hi, a, b: on[lo:hi].all() and on[a:b].all()):
                if labels is not None:
                    apart = labels[self.order[i]] != labels[self.order[j]]
                    i, j = i[apart], j[apart]
                on[i] = on[j] = True
        out = np.zeros(len(on), bool)
        out[self.order] = on
        return out

    def classes_of(self, sets: list[np.ndarray], percent: int) -> np.ndarray:
        """For each set the index of the first set of its class, linked pair by linked pair."""
        up = list(range(len(sets)))

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        order = self.order.tolist()
        for leaf in range(len(self.leaves[0])):
            for i, j in (p for ij in self.partners(leaf, percent) for p in zip(*map(np.ndarray.tolist, ij), strict=True)):
                a, b = root(order[i]), root(order[j])
                if a != b:
                    x, y = sets[order[i]], sets[order[j]]
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    if int((y[at] == x).sum()) >= need(len(x), len(y), percent):
                        up[max(a, b)] = min(a, b)
        return np.array([root(i) for i in range(len(sets))], int)


def frequent_shingles(docs: DataFrame, k: int, text: str, doc_id: str, sample: int, least: int = 3, most: int = 500_000) -> np.ndarray:
    """Shingles found in `least` or more of `sample` documents: they come last in the order.

    The order decides how many documents meet in a group, never which pairs are found, so a sample does.
    """
    ids = docs.select(F.col(doc_id).alias("_id"), F.lit(0).alias("_y"))
    few = bounded_sample(docs, ids, sample, text, doc_id, "order")

    def each(batches):
        for b in batches:
            for t in b["_text"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, k))], names=["s"])

    often = few.mapInArrow(each, "s bigint").groupBy("s").count().where(F.col("count") >= least).orderBy(F.desc("count"), "s").limit(most)
    return np.sort(np.asarray(often.select("s").toArrow()["s"], np.int64))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reachable over the edges (a, b), for every node with an edge.

    Smallest labels spread along edges, and each label then jumps to its label's label, until nothing changes;
    every round is written, so lineage stays short.
    """
    edges = edges.where("a <> b")
    edges = written(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        spread = labels.join(near, "node", "left").select("node", F.least("component", "seen").alias("mid"), F.col("component").alias("old"))
        up = labels.select(F.col("node").alias("mid"), F.col("component").alias("higher"))
        new = written(spread.join(up, "mid", "left").select("node", F.least("mid", "higher").alias("component"), "old"), "labels")
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels


def _groups(batches, *values: str):
    """((hub, tile), hubs, nodes, values) of each group of two rows or more, from batches sorted by hub and tile."""
    key, held = None, []

    def out():
        hubs, nodes = (pa.concat_arrays([b[c] for b in held]) for c in ("hub", "node"))
        columns = [[v for b in held for v in _values(b[c])] for c in values]
        return key, hubs, nodes, list(zip(*columns, strict=True)) if len(columns) > 1 else columns[0]

    for b in batches:
        hub, tile = b["hub"].to_numpy(zero_copy_only=False), b["tile"].to_numpy()
        edges = np.flatnonzero((hub[1:] != hub[:-1]) | (tile[1:] != tile[:-1])) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
            if lo == hi:
                continue
            if (hub[lo], tile[lo]) != key:
                if sum(x.num_rows for x in held) > 1:
                    yield out()
                key, held = (hub[lo], tile[lo]), []
            held.append(b.slice(lo, hi - lo))
    if sum(x.num_rows for x in held) > 1:
        yield out()


def _values(column: pa.Array) -> list:
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, offsets = np.asarray(column.values, np.int64), np.asarray(column.offsets)
    return [flat[a:b] for a, b in zip(offsets, offsets[1:])]


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", order_sample: int = 4000, group_points: int = 2_000_000, group_values: int = 4_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: its set's size, and the smallest id that links lead to, itself included.

    Two documents link when their shared shingles are at least `percent` of the union. Null, empty and blank texts
    have no shingle, link with nothing and are their own component, as do documents with a null id (component null).
    Rows that repeat an id are one document with several texts: it links by any of them, and each row is returned.

    Members of a group first meet as sizes, then as points, and only those to which the bounds leave a partner bring
    their sets: each to one of its groups, and again to groups that still hold several classes. Groups of more than
    `group_points` coordinates, or `group_values` shingles, are cut into tiles, and every two tiles meet in a task of
    their own, so no task holds more than twice that, however many documents share a shingle. `percent` is above 50.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    hot = shipped(spark, frequent_shingles(docs, k, text, doc_id, order_sample))

    def sketch(batches):
        last = hot()
        for b in sliced(batches):
            n, prints, firsts, points = [], [], [], []
            for t in b["t"].to_pylist():
                s = shingles(t, k)
                n.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                points.append(packed(counts(s, n_classes(len(s)))))
                if len(last):
                    at = np.searchsorted(last, s)
                    at[at == len(last)] = 0
                    often = last[at] == s
                    s = np.concatenate([s[~often], s[often]])
                firsts.append(s[: len(s) - -(-percent * len(s) // 100) + 1])
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(points, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))], names=["id", "n", "fp", "point", "firsts"])

    kind = base.schema["id"].dataType.simpleString()
    rows = written(base.mapInArrow(sketch, f"id {kind}, n bigint, fp binary, point binary, firsts array<bigint>"), "sketches")
    nodes = written(rows.where("n > 0 and id is not null").groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    chosen = rows.where("n > 0").join(nodes, "fp").where(F.col("id") == F.col("node"))
    own = written(chosen.select("node", "n", "point"), "own")

    # Shingles are the bulk: they aren't written again, and one shuffle of them serves the grouping and the join.
    keys = chosen.select("node", F.explode("firsts").alias("s")).repartition("s")
    shared = keys.groupBy("s").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select("s", "hub")
    members = written(keys.join(shared, "s").select("hub", "node").distinct(), "members")

    def dealt(rows: DataFrame, weight, most: int) -> DataFrame:
        """With the tile: 0 in groups of a weight up to `most`; beyond, one row for each pair of tiles that its own is in."""
        sizes = rows.groupBy("hub").agg(F.ceil(F.sum(weight) / most).cast("int").alias("tiles"))
        mine = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
        meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.least(mine, j).cast("long") * F.col("tiles") + F.greatest(mine, j))
        big = rows.join(sizes.where("tiles > 1"), "hub").select("hub", "node", F.explode(meets).alias("tile"))
        return rows.join(sizes.where("tiles > 1"), "hub", "left_anti").select("hub", "node", F.lit(0).cast("long").alias("tile")).unionByName(big)

    def by_group(df: DataFrame) -> DataFrame:
        return df.repartition(F.col("hub"), F.col("tile")).sortWithinPartitions("hub", "tile")

    def bounded(batches):
        for _, hubs, nodes, rows in _groups(batches, "point", "c"):
            labels = np.unique(np.array([c for _, c in rows]), return_inverse=True)[1]
            on = pa.array(hopeful_of([unpacked(p) for p, _ in rows], percent, labels))
            yield pa.RecordBatch.from_arrays([hubs.filter(on), nodes.filter(on)], names=["hub", "node"])

    def hopeful(groups: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of groups to which the points leave a partner of another label."""
        ready = dealt(groups.join(sizes, "node"), F.greatest(F.col("n") / 4, F.lit(64)), group_points).join(labels, "node").join(own.select("node", "point"), "node")
        return written(by_group(ready).mapInArrow(bounded, f"hub {kind}, node {kind}").distinct(), "close")

    # Partners are of about the same size: in the same or a neighbouring band of sizes. Only such members bring their points.
    sizes = own.groupBy("node").agg(F.max("n").alias("n"))
    banded = members.join(sizes, "node").withColumn("band", F.floor(F.log("n") / math.log(100 / percent) + 1e-9) if percent < 100 else F.col("n"))
    per_band = banded.groupBy("hub", "band").agg(F.count("*").alias("m"))
    around = per_band.select("hub", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "m").groupBy("hub", "band").agg(F.sum("m").alias("m")).where("m > 1")
    near = written(banded.join(around.select("hub", "band"), ["hub", "band"], "left_semi").select("hub", "node"), "near")
    close = hopeful(near, own.select("node", F.col("node").alias("c")).distinct())

    def full(batches):
        for part in sliced(batches):
            yield pa.RecordBatch.from_arrays([part["id"], pa.array([shingles(t, k) for t in part["t"].to_pylist()], pa.list_(pa.int64()))], names=["node", "set"])

    asked = written(close.select(F.col("node").alias("id")).distinct(), "asked")
    sets = base.join(asked, "id", "left_semi").mapInArrow(full, f"node {kind}, set array<bigint>").where(F.size("set") > 0)

    def linked(batches):
        for _, _, nodes, sets in _groups(batches, "set"):
            at = np.argsort(np.array(nodes.to_pylist()), kind="stable").tolist()
            nodes, sets = nodes.take(pa.array(at)), [np.asarray(sets[i], np.int64) for i in at]
            wide = min(n_classes(max(map(len, sets))), n_classes(8 * (8_000_000 // len(sets)) // 2))  # bounds the points' memory
            first = CountTree(np.stack([counts(s, wide) for s in sets])).classes_of(sets, percent)
            on = np.flatnonzero(first != np.arange(len(first)))
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(on)), nodes.take(pa.array(first[on]))], names=["a", "b"])

    def links(groups: DataFrame) -> DataFrame:
        rows = by_group(dealt(groups.join(sizes, "node"), F.col("n"), group_values).join(sets, "node"))
        return written(rows.mapInArrow(linked, f"a {kind}, b {kind}"), "links")

    # Each document brings its set to one of its groups; then all do to the groups that this hasn't seen whole and that
    # still hold several classes.
    own_group = close.groupBy("node").agg(F.min("hub").alias("chosen"))
    some = links(own_group.withColumnRenamed("chosen", "hub"))
    texts = rows.where("n > 0 and id is not null").select("id", "fp")
    several = texts.groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("id")
    own_nodes = texts.join(several, "id").join(nodes, "fp").select("id", "node").distinct()
    bound = own_nodes.join(own_nodes.groupBy("id").agg(F.min("node").alias("a")), "id").where("a <> node").select("a", F.col("node").alias("b"))
    some = written(some.unionByName(bound), "links")  # the texts of one id are one document
    found = components(some)
    known = close.join(own_group, "node").join(found, "node", "left").select("hub", F.coalesce("component", "node").alias("c"), (F.col("chosen") == F.col("hub")).alias("seen"))
    open_ = known.groupBy("hub").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.min("seen").alias("whole")).where("least <> most and not whole").select("hub")
    classes = asked.select(F.col("id").alias("node")).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("c"))
    rest = hopeful(close.join(open_, "hub", "left_semi"), classes)
    found = components(some.unionByName(links(rest)))
    placed = rows.select("id", "n", "fp").join(nodes, "fp", "left").join(found, nodes["node"] == found["node"], "left")
    by_row = placed.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce(found["component"], nodes["node"], "id")).alias("component_id"))
    return by_row


def op10_jaccard_join(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"), k=3, percent=90)

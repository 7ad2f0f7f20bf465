"""Line dedup by pairwise alignment.

Documents that overlap are found by the hashes of the lines they share: of runs of lines that just reach enough words,
a long line alone being one. A rare run pairs each document that
holds it with every earlier one; a run that more documents hold pairs each with the first of them, and while it
stands with the next, until it goes or no earlier holder is left. Lines of one document alone match nothing, so
holders that are equal but for such lines align alike, and only the first of them is tried. The lines of
each pair are aligned by patience diff: lines that occur once in both are matched along the longest common
subsequence, matches grow over equal neighbours, and the gaps between are aligned the same way. Common blocks of
enough words are deleted from the later document, so the first document with a line always keeps it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, ranked, renamed, sliced, table, written


def patience_blocks(a: list, b: list) -> list[tuple[int, int, int]]:
    """Common blocks (start in a, start in b, length) of the alignment, in order."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {a[i]: i for i in range(a0, a1) if once_a[a[i]] == 1}
        both = [(at[b[j]], j) for j in range(b0, b1) if once_b[b[j]] == 1 and b[j] in at]
        anchors = _increasing(both)
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            pairs += anchors
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    blocks: list[list[int]] = []
    for i, j in sorted(pairs):
        if blocks and (i, j) == (blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]):
            blocks[-1][2] += 1
        else:
            blocks.append([i, j, 1])
    return [tuple(x) for x in blocks]


def _increasing(both: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises on both sides (they come in the order of the second), by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for n, (i, _) in enumerate(both):
        p = bisect_left(tops, i)
        tops[p : p + 1], piles[p : p + 1] = [i], [n]
        back.append(piles[p - 1] if p else -1)
    out, n = [], piles[-1] if piles else -1
    while n >= 0:
        out.append(both[n])
        n = back[n]
    return out[::-1]


def cues(lines: np.ndarray, sizes: np.ndarray, shared: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What pairs a document: hash, start and end (exclusive) of runs of shared lines that just reach `min_words` words.

    One run goes forward from each line and one back from each, so every line of a common block with that many words
    is in a run that lies in the block. Equal hashes of other runs only add pairs.
    """
    n, total = len(lines), np.concatenate([[0], np.cumsum(sizes)])
    other = np.concatenate([[0], np.cumsum(~shared)])
    at = np.arange(n)
    ahead = np.maximum(np.searchsorted(total, total[:-1] + min_words), at + 1)
    back = np.minimum(np.searchsorted(total, total[1:] - min_words, "right") - 1, at)
    lo, hi = np.concatenate([at, back]), np.concatenate([ahead, at + 1])
    on = (lo >= 0) & (hi <= n)
    lo, hi = np.unique(np.stack([lo[on], hi[on]]), axis=1)
    on = other[lo] == other[hi]
    lo, hi = lo[on], hi[on]
    power, inverse = (np.cumprod(np.full(n + 1, x, np.uint64)) for x in (ODD, pow(ODD, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines.view(np.uint64) * power[:n])])
    return ((sums[hi] - sums[lo]) * inverse[lo]).view(np.int64), lo, hi


ODD = 0x9E3779B97F4A7C15


def frame_of(lines: np.ndarray, shared: np.ndarray) -> bytes:
    """A fingerprint of the shared lines in order, with a mark where others lie between: equal ones align alike with any other document."""
    runs = np.split(np.where(shared, lines, 0), np.flatnonzero(shared[1:] != shared[:-1]) + 1)
    flags = np.split(shared, np.flatnonzero(shared[1:] != shared[:-1]) + 1)
    return xxhash.xxh3_128_digest(b"".join(b"\1" + len(r).to_bytes(8, "little") + r.tobytes() if f[0] else b"\0" for r, f in zip(runs, flags, strict=True)))


def dedup_lines(docs: DataFrame, min_words: int = 8, rare: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every document with its text less the aligned common blocks, and n_lines, n_removed (long: lines, lines deleted).

    Earlier means a smaller id. A block goes if it has at least `min_words` words, in one line or in
    several. Equal texts align as one block, so all but the first of them lose all
    lines (their text becomes empty) if they have that many words. Documents with a null id or text, empty texts and
    rows that repeat both id and text of another stay as they are. All other columns stay; incoming n_lines and
    n_removed are replaced. An empty table gives an empty result.

    Only hashes of lines are shuffled, and once the texts with their deletions. A line that more than `rare` frames
    hold adds a pair per holder at first, so one in a third of all documents stays linear in them; later rounds, each
    over more holders than the last, only have the lines that still stand.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    base, name, _ = renamed(docs, keep)
    text_in, id_in = name[text], name[doc_id]
    lines = F.split(F.col(text_in), "\n", -1)
    hashed = F.transform(lines, lambda x: F.xxhash64(x))
    sizes = F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD)))
    rows = base.where(F.col(id_in).isNotNull() & (F.col(text_in) != "")).select(F.col(id_in).alias("id"), F.xxhash64(text_in, F.length(text_in)).alias("th"), hashed.alias("hashes"), sizes.alias("sizes"))
    rows = written(rows, "lines")

    # Of equal texts the first stays and the others lose all lines. Texts are looked up by hash and id, so copies of one spread.
    firsts = written(rows.groupBy("th").agg(F.min("id").alias("id")), "texts")
    words = F.aggregate("sizes", F.lit(0), lambda s, x: s + x)
    slim = rows.select("id", "th", words.alias("words")).where(F.col("words") >= min_words)
    copies = slim.join(firsts, ["th", "id"], "left_anti").select("id", "th", F.lit(None).cast("array<boolean>").alias("gone")).distinct()
    single = written(rows.join(firsts, ["th", "id"]).select("id", "th", "hashes", "sizes").dropDuplicates(["id", "th"]), "distinct-texts")

    kind = rows.schema["id"].dataType.simpleString()
    held = written(single.select("id", "th", F.explode(F.array_distinct("hashes")).alias("h")), "held-lines")
    shared = written(held.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared-lines")
    mine = held.join(shared, "h").groupBy("id", "th").agg(F.collect_list("h").alias("shared"))

    def framed(batches):
        for batch in sliced(batches):
            out = []
            for x, n, own in zip(batch["hashes"].to_pylist(), batch["sizes"].to_pylist(), batch["shared"].to_pylist(), strict=True):
                x, on = np.array(x, np.int64), set(own)
                both = np.fromiter((h in on for h in x.tolist()), bool, len(x))
                h, lo, hi = cues(x, np.array(n), both, min_words)
                out.append((frame_of(x, both), [{"h": p, "lo": q, "hi": r} for p, q, r in zip(h.tolist(), lo.tolist(), hi.tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["th"], pa.array([f for f, _ in out], pa.binary()), pa.array([c for _, c in out], cue)], names=["id", "th", "frame", "cues"])

    cue = pa.list_(pa.struct([("h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))
    frames = written(single.join(mine, ["id", "th"]).select("id", "th", "hashes", "sizes", "shared").mapInArrow(framed, f"id {kind}, th bigint, frame binary, cues array<struct<h:bigint,lo:int,hi:int>>").where(F.size("cues") > 0), "frames")

    # Of each cue the holders in order, one for each frame: the first of its documents.
    leads = frames.groupBy("frame").agg(F.min("id").alias("id"))
    places = written(frames.select("id", "th", F.inline("cues")), "cues")
    many = written(places.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("h"), "common-cues")
    holds = frames.join(leads, ["frame", "id"]).select("id", F.inline("cues")).select("h", "id").distinct().join(many, "h")
    ranks = written(ranked(holds, "h", "id", "holds").select("h", F.col("id").alias("early"), F.col("_at").cast("int").alias("rank")), "holders")
    totals = written(ranks.groupBy("h").agg(F.count("*").cast("int").alias("n"), F.min("early").alias("first")), "cue-holders")
    stands = written(places.join(totals, "h").where("id > first").drop("first"), "standing")

    early = single.select(F.col("id").alias("early"), F.col("hashes").alias("a"))
    late = single.select(F.col("id").alias("late"), "th", F.col("hashes").alias("b"), "sizes")

    def aligned(batches):
        for batch in sliced(batches):
            out = []
            for x, y, n in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["sizes"].to_pylist(), strict=True):
                gone = np.zeros(len(y), bool)
                for _, j, k in patience_blocks(x, y):
                    if sum(n[j : j + k]) >= min_words:
                        gone[j : j + k] = True
                out.append(gone.tolist() if gone.any() else None)
            yield pa.RecordBatch.from_arrays([batch["late"], batch["th"], pa.array(out, pa.list_(pa.bool_()))], names=["id", "th", "gone"])

    # Round by round: the next holders of what still stands. Cues of few holders have all of them in the first round.
    # What goes is a flag for each line of a text, so that looking lines up costs no search.
    lo, hi, tried, marks = 0, 1, None, None
    while True:
        upto = F.when(F.col("n") <= rare, F.col("n")).otherwise(F.lit(hi)) if lo == 0 else F.least("n", F.lit(hi))
        turns = written(stands.select("h", F.col("id").alias("late"), "n").distinct().select("h", "late", F.explode(F.sequence(F.lit(lo), upto - 1)).alias("rank")), "turns")
        pairs = turns.join(ranks, ["h", "rank"]).where("early < late").select("early", "late").distinct()
        pairs = written(pairs.join(tried, ["early", "late"], "left_anti") if tried else pairs, "pairs")
        ready = pairs.join(late, "late").join(early, "early").select("late", "th", "a", "b", "sizes")
        each = ready.mapInArrow(aligned, f"id {kind}, th bigint, gone array<boolean>").where("gone is not null")
        each = each.unionByName(marks) if marks else each
        marks = written(each.select("id", "th", F.posexplode("gone").alias("line", "on")).where("on").select("id", "th", "line").distinct().groupBy("id", "th").agg(F.collect_list("line").alias("at")), "aligned-lines")
        marks = written(marks.mapInArrow(_flags, f"id {kind}, th bigint, gone array<boolean>"), "aligned")
        tried = tried.unionByName(pairs) if tried else pairs
        more = stands.where(F.col("n") > (F.greatest(F.lit(rare), F.lit(hi)) if lo == 0 else F.lit(hi))).join(marks, ["id", "th"], "left")
        kept = F.col("gone").isNull() | (F.size("gone") < F.col("hi")) | F.exists(F.slice("gone", F.col("lo") + 1, F.col("hi") - F.col("lo")), lambda x: ~x)
        stands = written(more.where(kept).drop("gone"), "standing")
        if stands.isEmpty():
            break
        lo, hi = hi, 8 * hi
    marks = marks.withColumn("all", F.lit(False)).unionByName(copies.withColumn("all", F.lit(True)))
    marks = written(marks, "deletions").select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("gone").alias("_gone"), F.col("all").alias("_all"))

    joined = base.withColumn("_key", F.xxhash64(text_in, F.length(text_in))).join(marks, (F.col(id_in) == F.col("_id")) & (F.col("_key") == F.col("_th")), "left")
    stays = F.filter(F.arrays_zip(lines.alias("l"), F.col("_gone").alias("g")), lambda x: x["l"].isNotNull() & ~F.coalesce(x["g"], F.lit(False)))
    left = F.when(F.col("_all"), "").otherwise(F.array_join(F.transform(stays, lambda x: x["l"]), "\n"))
    removed = F.when(F.col("_all"), F.size(lines)).otherwise(F.coalesce(F.size(F.filter("_gone", lambda x: x)), F.lit(0)))
    return joined.select(
        *[(F.when(F.col("_all").isNull(), F.col(text_in)).otherwise(left) if c == text else F.col(name[c])).alias(c) for c in keep],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("_all").isNull(), 0).otherwise(removed).cast("long").alias("n_removed"),
    )


def _flags(batches):
    """From the numbers of the lines that go, a flag for each line up to the last of them."""
    for batch in sliced(batches):
        out = []
        for at in batch["at"].to_pylist():
            gone = np.zeros(max(at) + 1, bool)
            gone[at] = True
            out.append(gone.tolist())
        yield pa.RecordBatch.from_arrays([batch["id"], batch["th"], pa.array(out, pa.list_(pa.bool_()))], names=["id", "th", "gone"])


def op8_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text")

"""Best-fit packing of tokenized documents into sequences of a fixed length, by best-two-fit.

A bin is filled greedily (the largest unpacked piece that fits, again and again); then its smallest piece gives
way to the two unpacked pieces that fill the gap and its own place most tightly. Pieces of one length are
interchangeable, so the packing is made on the number of pieces of each length (at most `limit` numbers, whatever
the corpus), and a bin is made as often as its decisions stay the same. The plan that comes out is a table of
runs: these ranks of this length go to those bins at that offset. Pieces are then numbered within their
length and placed by the plan, all in tasks.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, shipped, table, written

LIMIT = 2048
#: Ranks of a length take so many bits in the key of a run.
RANK_BITS = 40


class Ids:
    """Token ids as the tokenizer file gives them, special tokens of the text included.

    Texts of letters whose classes have never changed go through the faster reader of the same vocabulary; others, and
    those with very long runs with or without white space, through the tokenizer itself. Both give the same ids.
    """

    PLAIN = re.compile(r"[^\x00-\x1b\x20-ɏ‐-‧€]|\s{500}|\S{500}")

    def __init__(self, tokenizer: str, ranks: dict[bytes, int], pattern: str, special: dict[str, int]):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.exact, self.special = Tokenizer.from_str(tokenizer), set(special)
        self.fast = Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.PLAIN.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special=self.special).astype(np.uint32, copy=False)


def read_tokenizer(path: str, ranks_path: str, pattern: str) -> tuple:
    """What Ids is made of, read on the driver: the tokenizer file, the same vocabulary as ranks, its special tokens."""
    import base64
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return text, ranks, pattern, {t["content"]: t["id"] for t in json.loads(text)["added_tokens"]}


_IDS: dict[str, Ids] = {}


def ids_of(held) -> Ids:
    """One reader for all tasks of a worker."""
    made = held()
    if made[0] not in _IDS:
        _IDS.clear()
        _IDS[made[0]] = Ids(*made)
    return _IDS[made[0]]


def default_tokenizer() -> tuple:
    import public_tokenizers

    return read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones of `limit`, the first takes the rest."""
    first = n % limit or min(n, limit)
    return [(0, first), *((at, limit) for at in range(first, n, limit))]


def token_pieces(docs: DataFrame, tokenizer: tuple | None = None, limit: int = LIMIT, end: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, piece int, start, length, ids_crc32 long[, ids array<int>]): the pieces of each row's whole text.

    A document is its token ids and then the id `end`, so null and empty texts are one piece of one token. Only
    documents of more than `limit` tokens are cut: into pieces of `limit`, of which the first may be shorter. Repeated
    rows and null ids are documents of their own; other columns, whatever their names, are left out. ids_crc32 is of
    the piece's ids as little-endian unsigned 32-bit numbers.
    """
    held = shipped(docs.sparkSession, tokenizer or default_tokenizer())
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def pieces(batches):
        reader = ids_of(held)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                rows, cols, ids = [], [], []
                for i, t in enumerate(part.column(1)):
                    own = np.append(reader.of(t.as_py()), end).astype("<u4")
                    for k, (start, size) in enumerate(cut(len(own), limit)):
                        rows.append(i)
                        cols.append((k, start, size, zlib.crc32(own[start : start + size].tobytes())))
                        ids += [own[start : start + size].astype(np.int32)] * with_ids
                k, start, size, crc = zip(*cols, strict=True)
                out = [part.column(0).take(pa.array(rows)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names)

    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return src.mapInArrow(pieces, schema)


class BestTwoFit:
    """Bins from the number of pieces of each length; `left` is what no bin has taken."""

    def __init__(self, counts: dict[int, int], limit: int):
        self.limit, self.left = limit, {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.left)

    def fill(self) -> tuple[dict[int, int], dict[int, int]]:
        """(pieces of the next bin by length, the most of each length that a decision asked for)."""
        gap, used, asked = self.limit, {}, {}
        at = len(self.lengths)
        while (at := bisect_right(self.lengths, gap, 0, at) - 1) >= 0:
            n = self.lengths[at]
            used[n] = asked[n] = min(self.left[n], gap // n)
            gap -= n * used[n]
        if gap and len(used) and sum(used.values()) > 1 and (pair := self.best_two(gap, used)):
            least = min(used)
            used[least] -= 1
            for n in pair:
                used[n] = used.get(n, 0) + 1
                asked[n] = max(asked.get(n, 0), used[n])
        return {n: k for n, k in used.items() if k}, asked

    def best_two(self, gap: int, used: dict[int, int]) -> tuple[int, int] | None:
        """The two unpacked lengths of the largest sum that fit in place of the smallest one and leave less of the gap."""
        least = min(used)
        room = gap + least
        free = np.array([n for n in self.lengths[: bisect_right(self.lengths, room - 1)] if self.left[n] > used.get(n, 0)])
        if not len(free):
            return None
        other = np.searchsorted(free, room - free, "right") - 1
        alone = (other == np.arange(len(free))) & np.array([self.left[n] - used.get(n, 0) < 2 for n in free.tolist()])
        other = other - alone
        total = np.where(other >= 0, free + free[other], 0)
        best = int(total.argmax())
        return (int(free[best]), int(free[other[best]])) if total[best] > least else None

    def bins(self):
        """(pieces of a bin by length, how often), until all is packed. Counts only fall, so a bin is the same again while none is short."""
        while self.lengths:
            used, asked = self.fill()
            times = min((self.left[n] - asked[n]) // k + 1 for n, k in used.items())
            for n, k in used.items():
                self.left[n] -= k * times
                if not self.left[n]:
                    self.lengths.remove(n)
            yield used, times


def packing_plan(counts: dict[int, int], limit: int = LIMIT) -> np.ndarray:
    """Rows (length, first rank, pieces in a bin, first bin, offset in the bin): the next ranks of a length are in the next row of it.

    Its size goes by `limit` alone: a length is short of what a bin asks for no oftener than a bin holds of it.
    """
    rows, taken, at = [], dict.fromkeys(counts, 0), 0
    for used, times in BestTwoFit(counts, limit).bins():
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            rows.append((n, taken[n], k, at, offset))
            taken[n] += k * times
            offset += n * k
        at += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, limit: int = LIMIT, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """Add sequence_id and offset (long) to pieces of 1 to `limit` tokens: each sequence is gapless from 0 and at most `limit` long.

    `order` names columns that tell pieces of one length apart; rows equal in them may change places. Incoming columns
    named sequence_id or offset are replaced. Pieces of other lengths (null, 0, above the limit) are an error.
    """
    rows = written(pieces.select(*[F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")]), "pack-pieces")
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(f"`{length}`").cast("long")).count().where(f"`{length}` between 1 and {limit}").collect()}  # a row for each length
    if bad := rows.count() - sum(counts.values()):
        raise ValueError(f"{bad} pieces have no length from 1 to {limit}")
    held = shipped(rows.sparkSession, packing_plan(counts, limit))
    work = rows.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)]).alias("row"), F.col(f"`{length}`").cast("long").alias("length"), F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)]).alias("order"))
    numbered = ranked(work, "length", "order", "pack-ranks").select("row", "length", F.col("_at").alias("rank"))

    def place(batches):
        plan = held()
        key = (plan[:, 0] << RANK_BITS) + plan[:, 1]
        for b in batches:
            n, rank = b.column(1).to_numpy(), b.column(2).to_numpy()
            run = plan[np.searchsorted(key, (n << RANK_BITS) + rank, "right") - 1]
            bin_at, turn = np.divmod(rank - run[:, 1], run[:, 2])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(run[:, 3] + bin_at), pa.array(run[:, 4] + turn * n)], names=["row", "sequence_id", "offset"])

    placed = numbered.mapInArrow(place, f"row {work.schema['row'].dataType.simpleString()}, sequence_id bigint, offset bigint")
    return placed.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(rows.columns)], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens int, ids array<int>): the packed sequences themselves, from pieces with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda p: p["ids"]))
    return packed.groupBy("sequence_id").agg(ids.alias("ids")).select("sequence_id", F.size("ids").alias("n_tokens"), "ids")


def op11_best_fit_packing(spark, sf_dir):
    pieces = token_pieces(table(spark, sf_dir, "documents"), with_ids=False)
    return pack(pieces)

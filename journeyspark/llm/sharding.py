"""Sharding by extendible hashing.

A directory is indexed by the leading bits of each document's hash. A bucket that exceeds the byte limit splits
on the next bit; all others keep their depth, so several directory entries may name one bucket. Documents of
which one alone exceeds the limit end in a bucket of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import renamed, table, written

#: Bits of the hash: the first half from the md5 of the id, the others from the text, which part rows that share an id.
BITS, ID_BITS = 60, 30


def hash_bits(key: Column, text: Column) -> Column:
    first = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")
    rest = F.shiftrightunsigned(F.xxhash64(text), 64 - (BITS - ID_BITS))
    return F.shiftleft(F.shiftright(first, BITS - ID_BITS), BITS - ID_BITS).bitwiseOR(rest)


def shard(docs: DataFrame, limit: int = 1 << 20, text: str = "text", doc_id: str = "doc_id", step: int = 8) -> DataFrame:
    """Add shard (string: the bucket's hash prefix in bits, empty for the only bucket), shard_depth (its length),
    n_bytes (of the text in UTF-8; null: 0) and shard_bytes (long) to every document; incoming columns of these names are replaced.

    Each round looks `step` bits further, at the documents of oversized buckets only: it sums their bytes by
    prefix (pre-aggregated where they are read) and finds for each prefix the least depth that fits. Rows with a repeated or null id
    part by their texts; only rows equal in both share all bits, and a bucket of one such row, however often it is
    there, is final. An empty table gives an empty result. Rounds work on (hash, bytes) alone; documents meet the
    buckets found in one join.
    """
    base, name, back = renamed(docs, [c for c in docs.columns if c not in ("n_bytes", "shard", "shard_depth", "shard_bytes")])
    size = F.coalesce(F.octet_length(name[text]), F.lit(0)).cast("long")
    bits = hash_bits(F.col(name[doc_id]), F.col(name[text]))
    slim = base.select(bits.alias("_h"), size.alias("_b")).groupBy("_h").agg(F.sum("_b").alias("_b"))
    open_ = written(slim, "shard-keys")
    found, depth = None, 0
    while True:
        deeper = min(BITS, depth + step)
        cell = F.shiftright("_h", BITS - deeper).alias("_cell")
        cells = open_.groupBy(cell).agg(F.sum("_b").alias("_b"), F.count("*").alias("_keys"))
        ways = cells.select("_cell", "_b", "_keys", F.explode(F.sequence(F.lit(depth), F.lit(deeper))).alias("_d"))
        ways = ways.withColumn("_prefix", F.expr(f"_cell >> ({deeper} - _d)"))
        sums = ways.groupBy("_d", "_prefix").agg(F.sum("_b").alias("_b"), F.sum("_keys").alias("_keys"))
        fit = sums.where((F.col("_b") <= limit) | (F.col("_keys") == 1) | (F.col("_d") == BITS))
        least = ways.select("_cell", "_d", "_prefix").join(fit, ["_d", "_prefix"]).groupBy("_cell").agg(F.min(F.struct("_d", "_prefix", "_b")).alias("s"))
        entries = least.select("_cell", "s._d", "s._prefix", F.col("s._b").alias("shard_bytes"))
        looked = written(open_.withColumn("_cell", cell).join(entries, "_cell", "left"), "shard-directory")
        here = looked.where("_d is not null").select(F.col("_h").alias("_key"), "_d", "_prefix", "shard_bytes")
        found = here if found is None else found.unionByName(here)
        left = looked.where("_d is null").select("_h", "_b")
        if deeper == BITS or left.isEmpty():
            break
        open_, depth = left, deeper
    keyed = base.withColumns({"n_bytes": size, "_h": bits})
    out = keyed.join(found, F.col("_h") == F.col("_key"), "left")
    prefix = F.when(F.col("_d") == 0, "").otherwise(F.expr("lpad(conv(_prefix, 10, 2), _d, '0')"))
    return out.select(*back, "n_bytes", prefix.alias("shard"), F.col("_d").cast("int").alias("shard_depth"), "shard_bytes")


def op2_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "shard", "shard_depth", "shard_bytes")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT g.depth, d.h >> (60 - g.depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(DISTINCT h) AS ids
      FROM d, (SELECT unnest(range(0, 31)) AS depth) g GROUP BY 1, 2)
SELECT doc_id, n_bytes,
       CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(prefix), depth) END AS shard,
       depth::INTEGER AS shard_depth, shard_bytes
FROM (SELECT d.*, s.depth, s.prefix, s.shard_bytes, row_number() OVER (PARTITION BY d.doc_id, d.h ORDER BY s.depth) AS rn
      FROM d JOIN s ON d.h >> (60 - s.depth) = s.prefix WHERE s.shard_bytes <= 1048576 OR s.ids = 1) WHERE rn = 1
"""

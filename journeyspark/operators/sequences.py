"""Sequence encoding: vocabulary, padding, channel scaling, variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from journeyspark.contracts import TOUCH_CODES
from journeyspark.functions.quantiles import exact_quantiles

PAD, UNKNOWN = 0, len(TOUCH_CODES) + 1


def encode(seq) -> Column:
    """Touch codes to 1.. by position in the code list; unknown codes to the last index."""
    index = F.create_map(*[x for i, c in enumerate(TOUCH_CODES, 1) for x in (F.lit(c), F.lit(i))])
    return F.transform(seq, lambda x: F.coalesce(F.try_element_at(index, x), F.lit(UNKNOWN)))


def decode(seq) -> Column:
    """Back to codes; padding and unknown give -1."""
    codes = F.array(*[F.lit(c) for c in TOUCH_CODES])
    return F.transform(seq, lambda i: F.when((i > PAD) & (i < UNKNOWN), F.element_at(codes, F.greatest(i, F.lit(1)))).otherwise(F.lit(-1)))


def pad(seq, length: int, zero=0) -> Column:
    """The newest `length` entries, then zeros to that length."""
    c = F.col(seq) if isinstance(seq, str) else seq
    kept = F.when(F.size(c) > length, F.slice(c, -length, length)).otherwise(c)
    return F.concat(kept, F.array_repeat(F.lit(zero), F.greatest(F.lit(length) - F.size(c), F.lit(0))))


def padded(examples: DataFrame, length: int) -> DataFrame:
    return examples.select("user_id", pad(encode("seq_touch"), length).alias("ids"), F.least(F.size("seq_touch"), F.lit(length)).alias("length"))


def max_len(train: DataFrame, min_len: int = 3, share: float = 0.95, approx: bool = False) -> DataFrame:
    """The whole part of the percentile of input lengths (exact unless approx), min_len - 1 at least."""
    n = F.size("seq_touch")
    at = train.agg(F.percentile_approx(n, share).alias("value")) if approx else exact_quantiles(train.select(n.alias("n")), [], "n", [share])
    return at.agg(F.greatest(F.floor(F.max("value")), F.lit(min_len - 1)).cast("long").alias("max_len"))


def channel_stats(train: DataFrame, channels=("seq_duration_log", "seq_gap_log")) -> DataFrame:
    """(channel, mean, std): over the events of training rows; a std of 0 counts as 1."""
    out = None
    for c in channels:
        x = train.select(F.explode(c).alias("x")).agg(F.lit(c).alias("channel"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
        x = x.withColumn("std", F.when(F.coalesce("std", F.lit(0.0)) == 0, 1.0).otherwise(F.col("std")))
        out = x if out is None else out.unionByName(x)
    return out


def scale_channels(examples: DataFrame, stats: DataFrame) -> DataFrame:
    """Scale each channel by its statistics (a row per channel); the binary channels pass as they are."""
    for r in stats.collect():
        examples = examples.withColumn(r["channel"], F.transform(r["channel"], _shift(r["mean"], r["std"])))
    return examples


def _shift(mean: float, std: float):
    return lambda x: (x - mean) / std


def touches_only(examples: DataFrame) -> DataFrame:
    """The variant without channels: zeros of the same length."""
    zeros = lambda c: F.transform(c, lambda x: F.lit(0.0))
    return examples.withColumns({c: zeros(c) for c in ("seq_duration_log", "seq_gap_log", "seq_device", "seq_pown", "seq_pany")})

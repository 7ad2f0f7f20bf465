"""Uniform draws that depend on ids and seeds alone, and equal DuckDB's bit for bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, key: Column, what: str = "") -> Column:
    """A number in [0, 1) from the md5 of seed, key and purpose."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(what), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def uniform_sql(seed: int, key: str, what: str = "") -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{what}', ({key})::VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"

"""Deterministic synthetic profiles and journeys: every draw is a hash, so partitioning never matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from journeyspark.contracts import TOUCH_CODES
from journeyspark.functions.draws import uniform


def profiles(spark: SparkSession, n: int, seed: int = 4242, missing: float = 0.06, overlap: float = 0.0) -> DataFrame:
    """n profiles in three segments, with '--' in five of the columns, and ord, their place in the file.

    overlap: the share of rows that look like another segment's, as a demo panel has them.
    """
    u = lambda what: uniform(seed, F.col("i"), what)
    pick = lambda what, lo, hi: (F.lit(lo) + F.floor(u(what) * (hi - lo + 1))).cast("int")
    gap = lambda what, value: F.when(u(what + "-gap") < missing, "--").otherwise(value.cast("string"))
    seg = (F.col("i") + F.when(u("stray") < overlap, 1).otherwise(0)) % 3
    age = F.when(seg == 0, pick("age", 60, 85)).when(seg == 1, pick("age", 35, 55)).otherwise(pick("age", 18, 32))
    stage = F.when(seg == 0, pick("stage", 2, 4)).when(seg == 1, pick("stage", 5, 7)).otherwise(pick("stage", 1, 3))
    kids = F.when(seg == 1, pick("kids", 1, 3)).otherwise(F.lit(0))
    return spark.range(n).select(F.col("id").alias("i")).select(
        (F.col("i") + 100_000).alias("UserID"), pick("gender", 1, 2).cast("string").alias("GenderID"), gap("age", age).alias("Age"),
        pick("region", 1, 5).cast("string").alias("SPSS_Regio5"), (kids + pick("adults", 1, 2)).cast("string").alias("BAS_huishoudgrootte"),
        gap("job", pick("job", 1, 9)).alias("BAS_werkzaamheid_resp"), kids.cast("string").alias("afg_kinderen_huishouden"),
        gap("income", pick("income", 1, 8)).alias("BAS_bruto_jaarinkomen"), gap("class", pick("class", 1, 5)).alias("AFG_sk2015"),
        gap("school", pick("school", 1, 8)).alias("BAS_voltooide_opleiding8_resp"), stage.cast("string").alias("SPSS_Lifestage"), F.col("i").alias("ord"),
    )


def journeys(spark: SparkSession, n: int, seed: int = 4242, repeat: float = 0.45, first: str = "2016-05-01 08:00:00") -> DataFrame:
    """8 to 20 events for each of n users; a touch repeats the one before it with probability `repeat`."""
    u = lambda what: uniform(seed, F.concat_ws("-", "i", "e"), what)
    events = spark.range(n).select(F.col("id").alias("i")).withColumn("e", F.explode(F.sequence(F.lit(1), (F.lit(8) + F.floor(uniform(seed, F.col("i"), "events") * 13)).cast("int"))))
    codes = F.array(*[F.lit(c) for c in TOUCH_CODES])
    w = Window.partitionBy("i").orderBy("e")
    new = (F.col("e") == 1) | (u("repeat") >= repeat)
    run = F.sum(new.cast("int")).over(w)
    touch = F.element_at(codes, (F.floor(uniform(seed, F.concat_ws("-", "i", "run"), "touch") * len(TOUCH_CODES)) + 1).cast("int"))
    minutes = F.sum((F.lit(3) + F.floor(u("gap") * 597)).cast("long")).over(w)
    return events.withColumn("run", run).select(
        (F.col("i") + 100_000).alias("UserID"), F.lit(first).cast("timestamp").alias("base"), minutes.alias("m"), touch.cast("int").alias("type_touch"),
        (1 + F.floor(u("duration") * 1799)).cast("double").alias("Duration"), F.when(u("device") < 0.4, "MOBILE").otherwise("FIXED").alias("DEVICE_TYPE"),
        (u("own") < 0.02).cast("int").alias("purchase_own"), (u("any") < 0.05).cast("int").alias("purchase_any"), "e",
    ).select("UserID", F.timestamp_seconds(F.unix_timestamp("base") + F.col("m") * 60).alias("TIMESPSS"), "type_touch", "Duration", "DEVICE_TYPE", "purchase_own", "purchase_any", (F.col("UserID") * 1000 + F.col("e")).alias("ord"))

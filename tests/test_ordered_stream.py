"""Journeys from a stream that is out of order: the batch's windows, and a state that empties."""

import pytest
from pyspark.sql import functions as F

from journeyspark.functions.draws import uniform
from journeyspark.operators import journey
from journeyspark.sources import synthetic
from journeyspark.streaming import ordered

pytest.importorskip("google.protobuf")


def fed(spark, parts, tmp_path, name, **named):
    """Rows of the last output for each user, and the store's rows after the last batch; parts are given one after the other."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}-in" / f"p={i:03d}"))
    files = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / f"{name}-in"))
    q = ordered.ordered_journey_stream(files, **named).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    q.processAllAvailable()
    told = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    last = spark.table(name).groupBy("user_id").agg(F.max_by(F.struct("step1", "step2", "step3"), F.struct("ts", "runs")).alias("s")).select("user_id", "s.*")
    return {tuple(r) for r in last.collect()}, told


def log(spark, n):
    return synthetic.journeys(spark, n).select(F.col("UserID").cast("long").alias("user_id"), F.col("TIMESPSS").alias("ts"), F.col("type_touch").cast("int").alias("touch"), F.col("Duration").alias("duration"), F.col("ord").cast("long").alias("ord"))


def later(spark, day, user=-1):
    """A row of another user, far on, that moves the watermark."""
    return spark.sql(f"select {user}L as user_id, timestamp'2100-01-01' + make_interval(0, 0, 0, {day}) as ts, 1 as touch, 1.0D as duration, 0L as ord")


def test_shuffled_rows_give_the_batch_windows(spark, tmp_path):
    clicks = log(spark, 12)
    # Every row is delayed by up to 50 minutes of event time, so neighbours swap places and files overlap.
    arrives = F.unix_micros("ts") + F.floor(uniform(3, F.col("ord"), "delay") * 50 * 60_000_000)
    rows = clicks.select("*", F.ntile(6).over(__import__("pyspark").sql.Window.orderBy(arrives, "ord")).alias("part"))
    parts = [rows.where(F.col("part") == i).drop("part").orderBy(uniform(4, F.col("ord"), "mixed")) for i in range(1, 7)]
    got, held = fed(spark, [*parts, later(spark, 0), later(spark, 1, -2)], tmp_path, "shuffled")
    want = {tuple(r) for r in journey.journey_window(journey.compress(clicks)).collect()}
    assert len(want) > 8 and got == want


def test_equal_times_and_idle_users(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", 1, 1), (1, "2024-01-01 10:00:00", 2, 2), (1, "2024-01-01 10:05:00", 4, 3), (1, "2024-01-01 10:05:00", 4, 4), (2, "2024-01-01 10:00:00", 1, 5), (2, "2024-01-01 10:01:00", 1, 6)]
    clicks = spark.createDataFrame(rows, "user_id long, ts string, touch int, ord long").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "touch", F.lit(1.0).alias("duration"), "ord")
    got, held = fed(spark, [clicks.orderBy(F.desc("ord")), later(spark, 0), later(spark, 400, -2), later(spark, 401, -3)], tmp_path, "idle", idle_ms=86_400_000)
    assert got == {tuple(r) for r in journey.journey_window(journey.compress(clicks)).collect()} and len(got) == 1
    # Users 1, 2 and -1 are idle beyond a day by now; what is left belongs to the last two rows.
    few, held_few = fed(spark, [later(spark, 400, -2), later(spark, 401, -3)], tmp_path, "few", idle_ms=86_400_000)
    assert held == held_few and not few

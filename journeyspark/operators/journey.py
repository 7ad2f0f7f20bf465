"""Journeys: runs of equal touches, windows of the newest three, examples, sessions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from journeyspark.contracts import require
from journeyspark.functions.lineage import written

SESSION_GAP_S = 1800


def _by_user(user: str, *order) -> Window:
    return Window.partitionBy(user).orderBy(*order)


def runs(df: DataFrame, key: str = "user_id", order=("ts", "ord"), value: str = "touch") -> DataFrame:
    """Adds run: 1 at the first row of each key, one more wherever the value changes (gaps and islands)."""
    w = _by_user(key, *order)
    new = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def compress(clicks: DataFrame) -> DataFrame:
    """One row for each run: its first row's values, and its earliest time."""
    first = lambda c: F.min_by(c, F.struct("ts", "ord")).alias(c)
    return runs(clicks).groupBy("user_id", "run").agg(F.min("ts").alias("ts"), first("touch"), first("duration"), first("ord"))


def build_events(clicks: DataFrame) -> DataFrame:
    """One row for each run with durations summed, any mobile row, the highest purchase flags, and log durations and gaps."""
    first = lambda c: F.min_by(c, F.struct("ts", "ord")).alias(c)
    ev = runs(clicks).groupBy("user_id", "run").agg(
        F.min("ts").alias("ts"), F.sum("duration").alias("duration"), first("touch"), F.min("ord").alias("ord"),
        F.max((F.col("device") == "MOBILE").cast("int")).alias("device_mobile"), F.max("purchase_own").alias("purchase_own"), F.max("purchase_any").alias("purchase_any"),
    )
    return event_gaps(ev)


def event_gaps(events: DataFrame) -> DataFrame:
    """Hours since the event before (0 for the first, never negative), and log1p of gap and duration."""
    before = F.lag("ts").over(_by_user("user_id", "ts", "ord"))
    gap = F.coalesce(F.greatest((F.unix_micros("ts") - F.unix_micros(before)) / 3.6e9, F.lit(0.0)), F.lit(0.0))
    return events.withColumn("gap_h", gap).withColumns({"gap_log": F.log1p("gap_h"), "duration_log": F.log1p("duration")})


def legacy_compress(clicks: DataFrame, carried=("purchase_id", "device")) -> DataFrame:
    """Runs with the first value that is there of each carried column, durations summed, the highest purchase flags."""
    at = F.struct("ts", "ord")
    some = [F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in carried]
    return runs(clicks).groupBy("user_id", "run", "touch").agg(F.min("ts").alias("ts"), F.sum("duration").alias("duration"), F.max("purchase_own").alias("purchase_own"), F.max("purchase_any").alias("purchase_any"), *some)


def journey_window(events: DataFrame, steps: int = 3) -> DataFrame:
    """The newest touches of each user, step1 the newest; users with fewer are left out. Among equal times the earlier row is the newer."""
    rn = F.row_number().over(_by_user("user_id", F.desc("ts"), F.asc("ord")))
    newest = events.withColumn("_rn", rn).where(F.col("_rn") <= steps)
    wide = newest.groupBy("user_id").agg(*[F.max(F.when(F.col("_rn") == i, F.col("touch"))).alias(f"step{i}") for i in range(1, steps + 1)])
    return wide.where(" and ".join(f"step{i} is not null" for i in range(1, steps + 1)))


def window_mismatches(window: DataFrame, events: DataFrame, steps: int = 3) -> DataFrame:
    """Rows of the window that a second construction, from sorted arrays, doesn't confirm."""
    at = F.struct(F.unix_micros("ts").alias("t"), (-F.col("ord")).alias("o"), "touch")
    last = events.groupBy("user_id").agg(F.slice(F.sort_array(F.collect_list(at), False), 1, steps).alias("_last"))
    both = window.join(last, "user_id", "left")
    agree = [F.coalesce(F.try_element_at("_last", F.lit(i))["touch"] == F.col(f"step{i}"), F.lit(False)) for i in range(1, steps + 1)]
    ok = agree[0]
    for a in agree[1:]:
        ok = ok & a
    return both.where(~ok).select(*window.columns)


def verify_window(window: DataFrame, events: DataFrame) -> None:
    bad = window_mismatches(window, events).limit(1).collect()
    if bad:
        raise ValueError(f"the window's order is wrong, for example for {bad[0]}")


def positions(events: DataFrame, min_len: int = 3) -> DataFrame:
    """Events of users with min_len or more, numbered from the newest (rn 1: the target) and counted (n)."""
    w = Window.partitionBy("user_id")
    return events.withColumn("n", F.count("*").over(w)).where(F.col("n") >= min_len).withColumn("rn", F.row_number().over(w.orderBy(F.desc("ts"), F.asc("ord"))))


def _sequence(c: str) -> Column:
    return F.transform(F.array_sort("_seq"), lambda x: x[c])


def build_examples(events: DataFrame, min_len: int = 3) -> DataFrame:
    """Per user: target (the last touch) and the arrays of all events before it, oldest first."""
    pos = positions(events, min_len)
    row = F.struct((-F.col("rn")).alias("k"), "touch", "duration_log", "gap_log", "device_mobile", "purchase_own", "purchase_any")
    ex = pos.groupBy("user_id").agg(F.max(F.when(F.col("rn") == 1, F.col("touch"))).alias("target"), F.max(F.when(F.col("rn") == 2, F.col("ts"))).alias("last_ts"), F.collect_list(F.when(F.col("rn") > 1, row)).alias("_seq"))
    names = {"touch": "seq_touch", "duration_log": "seq_duration_log", "gap_log": "seq_gap_log", "device_mobile": "seq_device", "purchase_own": "seq_pown", "purchase_any": "seq_pany"}
    return ex.select("user_id", "target", "last_ts", *[_sequence(c).alias(n) for c, n in names.items()])


def session_breaks() -> Column:
    """1 where more than the session gap lies before an event; to be summed per user, plus 1."""
    before = F.lag("ts").over(_by_user("user_id", "ts", "ord"))
    return F.coalesce(((F.unix_micros("ts") - F.unix_micros(before)) > SESSION_GAP_S * 1_000_000).cast("int"), F.lit(0))


def sessions(events: DataFrame) -> DataFrame:
    return events.withColumn("_b", session_breaks()).groupBy("user_id").agg((F.sum("_b") + 1).cast("long").alias("n_sessions"))


def journey_aggregates(events: DataFrame, min_len: int = 3) -> DataFrame:
    """The sixteen aggregates of each user's input events (all but the last)."""
    pos = positions(events.withColumn("_b", session_breaks()), min_len).where("rn > 1")
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 8.64e10
    last = lambda e: F.min_by(e, "rn")
    dow = last(F.weekday("ts"))
    return pos.groupBy("user_id").agg(
        F.count("*").alias("seq_len"), F.count_distinct("touch").alias("n_unique_touch"),
        F.sum("duration").alias("duration_total"), F.avg("duration").alias("duration_mean"), F.max("duration").alias("duration_max"),
        F.avg("gap_h").alias("gap_mean_h"), F.coalesce(F.stddev_samp("gap_h"), F.lit(0.0)).alias("gap_std_h"),
        span.alias("span_days"), (F.count("*") / F.greatest(span, F.lit(1.0))).alias("events_per_day"),
        (F.sum("_b") + 1).cast("long").alias("n_sessions"), F.sum("purchase_own").cast("long").alias("purchase_own_n"), F.sum("purchase_any").cast("long").alias("purchase_any_n"),
        F.avg("device_mobile").alias("mobile_share"), last(F.hour("ts")).alias("last_hour"), dow.alias("last_dow"), (dow >= 5).cast("int").alias("last_is_weekend"),
    )


def last_two(examples: DataFrame) -> DataFrame:
    """step2: the newest input touch, step3: the one before; 0 where there is none."""
    at = lambda i: F.coalesce(F.try_element_at("seq_touch", F.lit(i)), F.lit(0))
    return examples.select("user_id", "target", at(-1).alias("step2"), at(-2).alias("step3"))


def assemble(clicks: DataFrame, profiles: DataFrame, check: bool = False) -> DataFrame:
    """Runs, the newest three and the profile of every user who has both. check: the window is confirmed by a second construction, over all users, or ValueError."""
    require(clicks, "user_id", "ts", "touch", "duration", "ord", what="the click log")
    require(profiles, "user_id", what="the profiles")
    runs_ = compress(clicks.join(profiles.select("user_id"), "user_id", "left_semi"))
    if check:
        runs_ = written(runs_, "runs")  # read by both constructions and the result
    window = journey_window(runs_)
    if check:
        verify_window(window, runs_)
    return window.join(profiles, "user_id")


def assemble_report(clicks: DataFrame, profiles: DataFrame) -> DataFrame:
    """(stage, n) of `assemble`: users with clicks, those without a profile (dropped), those with too few runs (dropped), and rows that come out."""
    users = clicks.groupBy("user_id").agg(F.count("*").alias("clicks"))
    known = users.join(profiles.select("user_id").distinct().withColumn("known", F.lit(True)), "user_id", "left")
    windows = journey_window(compress(clicks)).select("user_id").withColumn("window", F.lit(True))
    has, sees = F.col("known").isNotNull(), F.col("window").isNotNull()
    row = known.join(windows, "user_id", "left").agg(
        F.count("*").alias("users"), F.count_if(~has).alias("without_profile"), F.count_if(has & ~sees).alias("too_few_runs"), F.count_if(has & sees).alias("rows"),
    )
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("n")) for c in ("users", "without_profile", "too_few_runs", "rows")])).alias("s")).select("s.*")


def with_profiles(examples: DataFrame, profiles: DataFrame) -> DataFrame:
    """Examples and the profile of their user; users without one are dropped."""
    return examples.join(profiles, "user_id")


def dropped_examples(examples: DataFrame, profiles: DataFrame) -> DataFrame:
    """(dropped, targets): how many examples `with_profiles` drops, and of how many different targets."""
    return examples.join(profiles.select("user_id"), "user_id", "left_anti").agg(F.count("*").alias("dropped"), F.count_distinct("target").alias("targets"))

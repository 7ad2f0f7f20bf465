"""Queries over the click log."""

from __future__ import annotations

from pyspark.sql import functions as F

from journeyspark.contracts import TOUCH_CODES
from journeyspark.functions.draws import uniform, uniform_sql
from journeyspark.operators import clean, journey, sequences

from .tables import CLICKS, EVENTS, NUMBERED, POSITIONS, RUNS, clicks, table

Q: dict = {}
_us = lambda c: F.unix_micros(c)
_r = lambda c, n=6: F.round(c, n).alias(c)


def q(sql: str | None = None):
    return lambda f: Q.setdefault(f.__name__, (f, sql))[0]


@q(f"WITH {RUNS} SELECT user_id, run, epoch_us(ts) AS ts_us, touch, duration FROM runs")
def compress_runs(s, d):
    return journey.compress(clicks(s, d)).select("user_id", "run", _us("ts").alias("ts_us"), "touch", "duration")


@q(f"WITH {EVENTS} SELECT user_id, run, epoch_us(ts) AS ts_us, touch, round(duration, 4) AS duration, device_mobile, purchase_own, purchase_any FROM ev")
def build_events(s, d):
    return journey.build_events(clicks(s, d)).select("user_id", "run", _us("ts").alias("ts_us"), "touch", F.round("duration", 4).alias("duration"), "device_mobile", "purchase_own", "purchase_any")


@q(f"""WITH {NUMBERED} SELECT user_id, run, touch, epoch_us(min(ts)) AS ts_us, round(sum(duration), 4) AS duration, max(purchase_own) AS purchase_own, max(purchase_any) AS purchase_any,
 arg_min(purchase_id, (ts, ord)) FILTER (purchase_id IS NOT NULL) AS purchase_id, arg_min(device, (ts, ord)) AS device FROM numbered GROUP BY user_id, run, touch""")
def legacy_compress(s, d):
    out = journey.legacy_compress(clicks(s, d))
    return out.select("user_id", "run", "touch", _us("ts").alias("ts_us"), F.round("duration", 4).alias("duration"), "purchase_own", "purchase_any", "purchase_id", "device")


@q(f"WITH {EVENTS} SELECT user_id, run, round(gap_h, 6) AS gap_h, round(gap_log, 6) AS gap_log, round(duration_log, 6) AS duration_log FROM ev")
def event_gaps(s, d):
    return journey.build_events(clicks(s, d)).select("user_id", "run", _r("gap_h"), _r("gap_log"), _r("duration_log"))


WINDOW = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, ord) AS rn FROM runs),
win AS (SELECT user_id, max(touch) FILTER (rn = 1) AS step1, max(touch) FILTER (rn = 2) AS step2, max(touch) FILTER (rn = 3) AS step3 FROM ranked WHERE rn <= 3 GROUP BY user_id HAVING count(*) = 3)"""


@q(f"WITH {RUNS}{WINDOW} SELECT * FROM win")
def journey_window(s, d):
    return journey.journey_window(journey.compress(clicks(s, d)))


@q("""WITH r AS (SELECT o_custkey AS user_id, o_orderpriority AS touch, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
SELECT user_id, max(touch) FILTER (rn = 1) AS step1, max(touch) FILTER (rn = 2) AS step2, max(touch) FILTER (rn = 3) AS step3 FROM r WHERE rn <= 3 GROUP BY user_id HAVING count(*) = 3""")
def order_window(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("touch"))
    return journey.journey_window(o)


@q(f"WITH {RUNS}{WINDOW} SELECT count(*) AS n_window, count(*) FILTER (user_id % 3 = 0 AND step1 <> step2) AS n_bad FROM win")
def window_check(s, d):
    """The second construction finds the rows whose newest steps were swapped, and no others."""
    runs = journey.compress(clicks(s, d))
    win = journey.journey_window(runs)
    swap = F.col("user_id") % 3 == 0
    wrong = win.select("user_id", F.when(swap, F.col("step2")).otherwise(F.col("step1")).alias("step1"), F.when(swap, F.col("step1")).otherwise(F.col("step2")).alias("step2"), "step3")
    return wrong.agg(F.count("*").alias("n_window")).crossJoin(journey.window_mismatches(wrong, runs).agg(F.count("*").alias("n_bad")))


@q(f"""WITH {POSITIONS} SELECT user_id, max(touch) FILTER (rn = 1) AS target, array_to_string(list(touch ORDER BY rn DESC) FILTER (rn > 1), ',') AS seq_touch,
 array_to_string(list(device_mobile ORDER BY rn DESC) FILTER (rn > 1), ',') AS seq_device, array_to_string(list(purchase_own ORDER BY rn DESC) FILTER (rn > 1), ',') AS seq_pown,
 array_to_string(list(purchase_any ORDER BY rn DESC) FILTER (rn > 1), ',') AS seq_pany, round(sum(duration_log) FILTER (rn > 1), 4) AS duration_log, round(sum(gap_log) FILTER (rn > 1), 4) AS gap_log FROM pos GROUP BY user_id""")
def journey_examples(s, d):
    ex = journey.build_examples(journey.build_events(clicks(s, d)))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4)
    return ex.select("user_id", "target", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("seq_touch", "seq_device", "seq_pown", "seq_pany")], total("seq_duration_log").alias("duration_log"), total("seq_gap_log").alias("gap_log"))


@q(f"""WITH {POSITIONS}, i AS (SELECT * FROM pos WHERE rn > 1) SELECT user_id, count(*) AS seq_len, count(DISTINCT touch) AS n_unique_touch, round(sum(duration), 4) AS duration_total, round(avg(duration) + 1e-9, 4) AS duration_mean,
 round(max(duration), 4) AS duration_max, round(avg(gap_h), 4) AS gap_mean_h, round(coalesce(stddev_samp(gap_h), 0), 4) AS gap_std_h, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 8.64e10, 4) AS span_days,
 round(count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 8.64e10, 1.0), 4) AS events_per_day, (sum(brk) + 1)::BIGINT AS n_sessions, sum(purchase_own)::BIGINT AS purchase_own_n, sum(purchase_any)::BIGINT AS purchase_any_n,
 round(avg(device_mobile), 6) AS mobile_share, hour(arg_min(ts, rn))::INT AS last_hour, (isodow(arg_min(ts, rn)) - 1)::INT AS last_dow, (isodow(arg_min(ts, rn)) >= 6)::INT AS last_is_weekend FROM i GROUP BY user_id""")
def journey_aggregates(s, d):
    a = journey.journey_aggregates(journey.build_events(clicks(s, d)))
    four = ("duration_total", "duration_mean", "duration_max", "gap_mean_h", "gap_std_h", "span_days", "events_per_day")
    a = a.withColumn("duration_mean", F.col("duration_mean") + 1e-9)  # sums of hundredths may end on a half
    return a.select(*[_r(c, 4) if c in four else _r(c) if c == "mobile_share" else c for c in a.columns])


@q(f"WITH {POSITIONS} SELECT user_id, (sum(brk) + 1)::BIGINT AS n_sessions FROM counted GROUP BY user_id")
def sessions(s, d):
    return journey.sessions(journey.build_events(clicks(s, d)))


@q(f"WITH {POSITIONS} SELECT user_id, max(touch) FILTER (rn = 1) AS target, coalesce(max(touch) FILTER (rn = 2), 0) AS step2, coalesce(max(touch) FILTER (rn = 3), 0) AS step3 FROM pos GROUP BY user_id")
def last_two(s, d):
    return journey.last_two(journey.build_examples(journey.build_events(clicks(s, d))))


_INDEX = "list_position([" + ", ".join(map(str, TOUCH_CODES)) + "], touch)"


@q(f"WITH {POSITIONS} SELECT user_id, array_to_string(list({_INDEX} ORDER BY rn DESC) FILTER (rn > 1), ',') AS ids, array_to_string(list(touch ORDER BY rn DESC) FILTER (rn > 1), ',') AS codes FROM pos GROUP BY user_id")
def vocab_encode(s, d):
    ex = journey.build_examples(journey.build_events(clicks(s, d))).withColumn("ids", sequences.encode("seq_touch"))
    return ex.select("user_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.array_join(sequences.decode("ids").cast("array<string>"), ",").alias("codes"))


@q(f"""WITH {POSITIONS}, e AS (SELECT user_id, list({_INDEX} ORDER BY rn DESC) FILTER (rn > 1 AND rn <= 41) AS x, count(*) - 1 AS n FROM pos GROUP BY user_id)
SELECT user_id, array_to_string(list_resize(x, 40, 0), ',') AS ids, least(n, 40)::INT AS length FROM e""")
def pad_sequences(s, d):
    return sequences.padded(journey.build_examples(journey.build_events(clicks(s, d))), 40).select("user_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "length")


_u = lambda: uniform(11, F.col("user_id"), "split")
_USQL = uniform_sql(11, "user_id", "split")


@q(f"WITH {POSITIONS}, e AS (SELECT user_id, count(*) - 1 AS n FROM pos GROUP BY user_id HAVING {_USQL} < 0.7) SELECT greatest(floor(quantile_cont(n, 0.95)), 2)::BIGINT AS max_len FROM e")
def max_len_p95(s, d):
    return sequences.max_len(journey.build_examples(journey.build_events(clicks(s, d))).where(_u() < 0.7))


@q(f"""WITH {POSITIONS}, t AS (SELECT * FROM pos WHERE rn > 1 AND {_USQL} < 0.7)
SELECT 'seq_duration_log' AS channel, round(avg(duration_log), 6) AS mean, round(stddev_pop(duration_log), 6) AS std FROM t UNION ALL SELECT 'seq_gap_log', round(avg(gap_log), 6), round(stddev_pop(gap_log), 6) FROM t""")
def channel_stats(s, d):
    return sequences.channel_stats(journey.build_examples(journey.build_events(clicks(s, d))).where(_u() < 0.7)).select("channel", _r("mean"), _r("std"))


@q(f"""WITH {POSITIONS}, m AS (SELECT avg(duration_log) AS mu, stddev_pop(duration_log) AS sd FROM pos WHERE rn > 1 AND {_USQL} < 0.7)
SELECT user_id, round(sum((duration_log - mu) / sd), 4) AS scaled_duration, round(sum(device_mobile), 4)::DOUBLE AS device FROM pos, m WHERE rn > 1 GROUP BY user_id""")
def scaled_channels(s, d):
    ex = journey.build_examples(journey.build_events(clicks(s, d)))
    out = sequences.scale_channels(ex, sequences.channel_stats(ex.where(_u() < 0.7)))
    total = lambda c: F.round(F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 4)
    return out.select("user_id", total("seq_duration_log").alias("scaled_duration"), total("seq_device").alias("device"))


@q(f"WITH {POSITIONS} SELECT user_id, (count(*) - 1)::INT AS n, 0.0::DOUBLE AS channel_sum FROM pos GROUP BY user_id")
def touches_only(s, d):
    ex = sequences.touches_only(journey.build_examples(journey.build_events(clicks(s, d))))
    return ex.select("user_id", F.size("seq_touch").alias("n"), F.aggregate("seq_gap_log", F.lit(0.0), lambda a, x: a + x).alias("channel_sum"))


@q(f"WITH {CLICKS} SELECT 'raw' AS stage, count(*) AS n_rows FROM events UNION ALL SELECT 'clean', count(*) FROM clicks UNION ALL (WITH {RUNS} SELECT 'runs', count(*) FROM runs) UNION ALL (WITH {RUNS}{WINDOW} SELECT 'window', count(*) FROM win)")
def stage_report(s, d):
    c = clicks(s, d)
    r = journey.compress(c)
    return clean.stage_report({"raw": table(s, d, "events"), "clean": c, "runs": r, "window": journey.journey_window(r)})


_KNOWN = "known AS (SELECT c_custkey AS user_id, c_nationkey AS nation FROM customer WHERE c_custkey % 4 <> 0)"


def _known(s, d):
    return table(s, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("nation"))


@q(f"WITH {POSITIONS}, {_KNOWN}, ex AS (SELECT user_id, max(touch) FILTER (rn = 1) AS target, count(*) - 1 AS inputs FROM pos GROUP BY user_id) SELECT user_id, target, inputs::INT AS inputs, nation FROM ex JOIN known USING (user_id)")
def examples_profiles(s, d):
    ex = journey.with_profiles(journey.build_examples(journey.build_events(clicks(s, d))), _known(s, d))
    return ex.select("user_id", "target", F.size("seq_touch").alias("inputs"), "nation")


@q(f"WITH {POSITIONS}, {_KNOWN}, ex AS (SELECT user_id, max(touch) FILTER (rn = 1) AS target FROM pos GROUP BY user_id) SELECT count(*) AS dropped, count(DISTINCT target) AS targets FROM ex WHERE user_id NOT IN (SELECT user_id FROM known)")
def dropped_examples(s, d):
    return journey.dropped_examples(journey.build_examples(journey.build_events(clicks(s, d))), _known(s, d))


@q(f"""WITH {RUNS}{WINDOW}, {_KNOWN}, u AS (SELECT user_id, user_id IN (SELECT user_id FROM known) AS has, user_id IN (SELECT user_id FROM win) AS sees FROM (SELECT DISTINCT user_id FROM clicks))
SELECT unnest(['users', 'without_profile', 'too_few_runs', 'rows']) AS stage, unnest([count(*), count(*) FILTER (NOT has), count(*) FILTER (has AND NOT sees), count(*) FILTER (has AND sees)]) AS n FROM u""")
def assemble_report(s, d):
    return journey.assemble_report(clicks(s, d), _known(s, d))

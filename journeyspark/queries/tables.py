"""The driver tables as click log and profiles, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Event types as touchpoint codes.
TOUCH_OF = {"view": 1, "click": 4, "signup": 10, "error": 16, "purchase": 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    touch = F.element_at(F.create_map(*[F.lit(x) for kv in TOUCH_OF.items() for x in kv]), F.col("event_type"))
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    bought = F.col("event_type") == "purchase"
    log = e.select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), touch.alias("touch"), F.col("value").alias("duration"), F.col("event_id").alias("ord"),
        F.when(k % 2 == 0, "MOBILE").otherwise("FIXED").alias("device"), (bought & (F.col("event_id") % 3 == 0)).cast("int").alias("purchase_own"), bought.cast("int").alias("purchase_any"),
        F.when(bought, F.col("event_id")).alias("purchase_id"),
    )
    return log.where(F.coalesce("duration", F.lit(0.0)) > 0)


CLICKS = """clicks AS (
  SELECT user_id, ts, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 4 WHEN 'signup' THEN 10 WHEN 'error' THEN 16 ELSE 20 END AS touch,
         value AS duration, event_id AS ord,
         CASE WHEN regexp_extract(props, '([0-9]+)', 1)::INT % 2 = 0 THEN 'MOBILE' ELSE 'FIXED' END AS device,
         (event_type = 'purchase' AND event_id % 3 = 0)::INT AS purchase_own, (event_type = 'purchase')::INT AS purchase_any,
         CASE WHEN event_type = 'purchase' THEN event_id END AS purchase_id
  FROM events WHERE coalesce(value, 0) > 0)"""

NUMBERED = CLICKS + """, flagged AS (
  SELECT *, CASE WHEN lag(touch) OVER w = touch THEN 0 ELSE 1 END AS new FROM clicks WINDOW w AS (PARTITION BY user_id ORDER BY ts, ord)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM flagged)"""

RUNS = NUMBERED + """, runs AS (
  SELECT user_id, run, min(ts) AS ts, arg_min(touch, (ts, ord)) AS touch, arg_min(duration, (ts, ord)) AS duration, arg_min(ord, (ts, ord)) AS ord
  FROM numbered GROUP BY user_id, run)"""

EVENTS = NUMBERED + """, built AS (
  SELECT user_id, run, min(ts) AS ts, sum(duration) AS duration, arg_min(touch, (ts, ord)) AS touch, min(ord) AS ord,
         max((device = 'MOBILE')::INT) AS device_mobile, max(purchase_own) AS purchase_own, max(purchase_any) AS purchase_any
  FROM numbered GROUP BY user_id, run),
gapped AS (SELECT *, coalesce(greatest((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, ord))) / 3.6e9, 0), 0) AS gap_h FROM built),
ev AS (SELECT *, ln(1 + gap_h) AS gap_log, ln(1 + duration) AS duration_log FROM gapped)"""

POSITIONS = EVENTS + """, counted AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
    coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, ord)) > 1800000000)::INT, 0) AS brk FROM ev),
pos AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, ord) AS rn FROM counted WHERE n >= 3)"""

#: Integer-coded profiles of customers: six small codes, of which some are missing.
PROFILE_COLUMNS = ("gender", "age", "region", "household", "income", "stage")


def raw_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles as text, with '--' where the key or a multiple of it ends a cycle of seven or eleven."""
    c = table(spark, sf_dir, "customer")
    k, bal = F.col("c_custkey"), F.floor(F.col("c_acctbal")).cast("long")
    gap = lambda n, v: F.when(n, "--").otherwise(v.cast("string"))
    seg = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), 1) for x in (s, i)]), F.col("c_mktsegment"))
    return c.select(
        k.alias("user_id"), gap(k % 7 == 0, k % 2 + 1).alias("gender"), gap(k % 11 == 0, 18 + F.pmod(bal, F.lit(60))).alias("age"),
        gap(k % 77 == 0, F.col("c_nationkey") % 5 + 1).alias("region"), gap(k % 154 == 0, F.pmod(bal, F.lit(5)) + 1).alias("household"),
        gap((k % 13 == 0) | (k % 77 == 0), F.pmod(F.floor(bal / 100), F.lit(8)) + 1).alias("income"), gap(k % 77 == 0, seg).alias("stage"),
    )


_BAL = "floor(c_acctbal)::BIGINT"
_MOD = lambda x, n: f"((({x}) % {n} + {n}) % {n})"
RAW_PROFILES = f"""raw AS (
  SELECT c_custkey AS user_id, CASE WHEN c_custkey % 7 = 0 THEN '--' ELSE (c_custkey % 2 + 1)::VARCHAR END AS gender,
         CASE WHEN c_custkey % 11 = 0 THEN '--' ELSE (18 + {_MOD(_BAL, 60)})::VARCHAR END AS age,
         CASE WHEN c_custkey % 77 = 0 THEN '--' ELSE (c_nationkey % 5 + 1)::VARCHAR END AS region,
         CASE WHEN c_custkey % 154 = 0 THEN '--' ELSE ({_MOD(_BAL, 5)} + 1)::VARCHAR END AS household,
         CASE WHEN c_custkey % 13 = 0 OR c_custkey % 77 = 0 THEN '--' ELSE ({_MOD(f'floor({_BAL} / 100)::BIGINT', 8)} + 1)::VARCHAR END AS income,
         CASE WHEN c_custkey % 77 = 0 THEN '--' ELSE (CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 END)::VARCHAR END AS stage
  FROM customer)"""

PROFILES = RAW_PROFILES + ", profiles AS (SELECT user_id, " + ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in PROFILE_COLUMNS) + " FROM raw)"
_MISS = " + ".join(f"({c} IS NULL)::INT" for c in PROFILE_COLUMNS)
KEPT = PROFILES + f", kept AS (SELECT * FROM profiles WHERE ({_MISS}) * 2 <= {len(PROFILE_COLUMNS)})"

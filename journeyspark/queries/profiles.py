"""Queries over customers and orders as profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from journeyspark.contracts import TOUCH_CODES
from journeyspark.functions import metrics
from journeyspark.functions.draws import uniform_sql
from journeyspark.functions.lineage import written
from journeyspark.operators import clean, journey, prepare, profile, splits
from journeyspark.plans import models, training
from journeyspark.sources import dimensions, files

from .tables import CLICKS, KEPT, PROFILE_COLUMNS, PROFILES, RUNS, clicks, raw_profiles, table

Q: dict = {}
COLS = list(PROFILE_COLUMNS)


def q(sql: str | None = None):
    return lambda f: Q.setdefault(f.__name__, (f, sql))[0]


def profiles(s, d):
    return clean.coerce_numeric(files.blank_missing(raw_profiles(s, d)), COLS)


def kept(s, d):
    return clean.sparsity_filter(profiles(s, d), COLS)


def kept_table(s, d):
    """`kept`, written, for what reads it several times."""
    return written(kept(s, d), "kept")


def _round(df, cols, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in cols else c for c in df.columns])


@q(f"WITH {PROFILES} SELECT * FROM profiles")
def coerce_numeric(s, d):
    return profiles(s, d)


@q(f"WITH {PROFILES}" + " UNION ALL ".join(f" SELECT '{c}' AS \"column\", count(*) FILTER (raw.{c} IS NOT NULL AND p.{c} IS NULL) AS lost FROM raw JOIN profiles p USING (user_id)" for c in COLS))
def coercion_losses(s, d):
    return clean.coercion_losses(raw_profiles(s, d), COLS)


@q("SELECT min_by(o_orderkey, o_orderkey) AS o_orderkey, o_custkey, min_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def dedupe_first(s, d):
    return clean.dedupe_first(table(s, d, "orders"), "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


@q("SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 5 <> 0")
def keyed_rows(s, d):
    raw = table(s, d, "customer").select(F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.concat("c_custkey", F.lit(".0"))).alias("user_id"))
    return clean.keyed(raw, "user_id")


@q(f"WITH {KEPT} SELECT * FROM kept")
def sparsity_filter(s, d):
    return kept(s, d)


@q(f"WITH {PROFILES} SELECT user_id, gender, age, region FROM profiles WHERE region IS NOT NULL")
def known_region(s, d):
    return profiles(s, d).where("region is not null").select("user_id", "gender", "age", "region")


@q("SELECT event_id, value FROM events WHERE coalesce(CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END, 0) > 0")
def positive_duration(s, d):
    return clean.positive_duration(table(s, d, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, None).otherwise(F.col("value")).alias("value")), "value")


@q("SELECT event_id, epoch_us(date_trunc('second', ts)) AS ts_us FROM events WHERE event_id % 6 <> 0")
def parse_time(s, d):
    text = F.when(F.col("event_id") % 6 == 0, "not a date").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    return table(s, d, "events").withColumn("x", text).select("event_id", F.unix_micros(clean.parse_time("x")).alias("ts_us")).where("ts_us is not null")


@q(f"WITH {CLICKS} SELECT c.ord, c.touch, d.name FROM clicks c LEFT JOIN {dimensions.sql_values('type_touch')} ON c.touch = d.code".replace("AS dim(code, name)", "AS d(code, name)"))
def label_codes(s, d):
    return dimensions.label(clicks(s, d).select("ord", "touch"), "touch", "type_touch", "name")


@q(f"SELECT c_custkey, coalesce(d.name, 'Channel #' || (c_custkey % 24)::VARCHAR) AS name FROM customer LEFT JOIN {dimensions.sql_values('type_touch')} ON c_custkey % 24 = d.code".replace("AS dim(code, name)", "AS d(code, name)"))
def label_fallback(s, d):
    return dimensions.label(table(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 24).cast("int").alias("code")), "code", "type_touch", "name", "Channel #").select("c_custkey", "name")


@q(f"WITH {PROFILES} SELECT user_id, coalesce(age, -1) AS age, coalesce(income, -1) AS income FROM profiles")
def fill_value(s, d):
    return clean.fill_value(profiles(s, d).select("user_id", "age", "income"), ["age", "income"], -1)


@q(f"WITH {CLICKS} SELECT d.code, d.name, count(c.touch) AS n FROM {dimensions.sql_values('type_touch')} LEFT JOIN clicks c ON c.touch = d.code GROUP BY ALL".replace("AS dim(code, name)", "AS d(code, name)"))
def dimension_usage(s, d):
    used = clicks(s, d).groupBy("touch").agg(F.count("*").alias("n"))
    return dimensions.options(s, "type_touch").join(used, F.col("code") == F.col("touch"), "left").select("code", "name", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@q("SELECT n_nationkey AS code, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) || '!' ELSE n_name END AS name FROM nation")
def dimension_resync(s, d):
    now = table(s, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    wanted = now.where("code % 2 = 0").withColumn("name", F.concat(F.upper("name"), F.lit("!")))
    return dimensions.resync(dimensions.resync(now, wanted, "code"), wanted, "code")


_INFO = {"customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}, "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}, "region": {"r_regionkey": "int", "r_name": "string"}}


@q(" UNION ALL ".join(f"""SELECT '{t}' AS "table", unnest({list(own)}) AS "column", unnest({list(own.values())}) AS type, count(*) AS rows, unnest([{', '.join(f'count({c})' for c in own)}]) AS non_null FROM {t}""" for t, own in _INFO.items()))
def dataset_info(s, d):
    return files.dataset_info({t: table(s, d, t) for t in _INFO})


def _form(s, d):
    """Form rows from customers: valid ones, and each seventh, eleventh or thirteenth with a fault."""
    k = F.col("c_custkey")
    c = table(s, d, "customer")
    code = lambda n, hi: (k % hi + 1).cast("string").alias(n)
    return c.select(
        k.alias("id"), code("GenderID", 2), F.when(k % 7 == 0, "abc").when(k % 11 == 0, "121").otherwise(F.concat(F.lit(" "), (k % 90).cast("string"), F.lit("+"))).alias("Age"),
        code("SPSS_Regio5", 5), F.when(k % 13 == 0, "0").otherwise((k % 5 + 1).cast("string")).alias("BAS_huishoudgrootte"), code("BAS_werkzaamheid_resp", 9), (k % 3).cast("string").alias("afg_kinderen_huishouden"),
        code("BAS_bruto_jaarinkomen", 8), code("AFG_sk2015", 5), code("BAS_voltooide_opleiding8_resp", 8), F.when(k % 17 == 0, " ").otherwise((k % 9 + 1).cast("string")).alias("SPSS_Lifestage"),
        F.when(k % 19 == 0, "fax").otherwise("EMAIL ").alias("step_1_channel"), (k % 24).cast("string").alias("step_2_channel"),
    )


_K = "c_custkey"
_BADSTEP = f"({_K} % 24) NOT IN ({', '.join(map(str, TOUCH_CODES))})"
_ERRORS = f"""SELECT {_K} AS id, array_to_string(list_filter([CASE WHEN {_K} % 7 = 0 THEN 'Age:not_a_number' WHEN {_K} % 11 = 0 THEN 'Age:out_of_range' END,
 CASE WHEN {_K} % 13 = 0 THEN 'BAS_huishoudgrootte:out_of_range' END, CASE WHEN {_K} % 17 = 0 THEN 'SPSS_Lifestage:required' END, CASE WHEN {_K} % 19 = 0 THEN 'step_1_channel:not_a_number' END,
 CASE WHEN {_BADSTEP} THEN 'step_2_channel:unknown_code' END], lambda x: x IS NOT NULL), ',') AS errors,
 CASE WHEN {_K} % 7 = 0 THEN NULL WHEN {_K} % 11 = 0 THEN 121 ELSE {_K} % 90 END::INT AS age, CASE WHEN {_K} % 19 = 0 THEN NULL ELSE 20 END::INT AS step FROM customer"""


@q(_ERRORS)
def validate_profiles(s, d):
    v = clean.validate_form(_form(s, d))
    each = F.array_sort(F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])))
    return v.select("id", F.array_join(each, ",").alias("errors"), F.col("values.Age").alias("age"), F.col("values.step_1_channel").alias("step"))


@q(f"SELECT id, (id % 24)::INT AS step2, 20 AS step3, age AS f_age FROM ({_ERRORS}) WHERE errors = ''")
def feature_frame(s, d):
    return clean.to_features(clean.validate_form(_form(s, d))).select("id", "step2", "step3", F.col("f_Age").alias("f_age"))


@q(f"WITH names AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Email' WHEN 1 THEN ' RETARGETING' WHEN 2 THEN 'flight ticket APP' ELSE 'fax' END AS x FROM customer) SELECT id, d.code FROM names LEFT JOIN {dimensions.sql_values('type_touch')} ON lower(trim(x)) = lower(d.name)".replace("AS dim(code, name)", "AS d(code, name)"))
def name_to_code(s, d):
    x = F.element_at(F.array(*[F.lit(v) for v in ("Email", " RETARGETING", "flight ticket APP", "fax")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), x.alias("x")).select("id", clean.name_to_code("x").alias("code"))


@q(f"WITH {CLICKS}, known AS (SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 3 <> 0) SELECT ord FROM clicks WHERE user_id IN (SELECT user_id FROM known)")
def semi_known(s, d):
    known = table(s, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user_id"))
    return clicks(s, d).join(known, "user_id", "left_semi").select("ord")


@q(f"WITH {CLICKS}, known AS (SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 3 <> 0) SELECT count(*) AS dropped, count(DISTINCT user_id) AS users FROM clicks WHERE user_id NOT IN (SELECT user_id FROM known)")
def anti_unknown(s, d):
    known = table(s, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user_id"))
    return clicks(s, d).join(known, "user_id", "left_anti").agg(F.count("*").alias("dropped"), F.count_distinct("user_id").alias("users"))


_WIN = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, ord) AS rn FROM runs),
win AS (SELECT user_id, max(touch) FILTER (rn = 1) AS step1, max(touch) FILTER (rn = 2) AS step2, max(touch) FILTER (rn = 3) AS step3 FROM ranked WHERE rn <= 3 GROUP BY user_id HAVING count(*) = 3)"""


@q(f"WITH {KEPT}, {RUNS}{_WIN} SELECT * FROM win JOIN kept USING (user_id)")
def assemble(s, d):
    return journey.assemble(clicks(s, d), kept(s, d))


_MED = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM kept)) AS {c}" for c in COLS)


@q(f"WITH {KEPT} SELECT user_id, {_MED} FROM kept")
def median_impute(s, d):
    return prepare.median_impute(kept_table(s, d), COLS)


def _knn_sql(receivers: str, donors: str) -> str:
    """(user_id, columns): rows of `receivers` with gaps filled from the five nearest rows of `donors`."""
    dist = " + ".join(f"coalesce(power(r.{c} - k.{c}, 2), 0)" for c in COLS)
    both = " + ".join(f"(r.{c} IS NOT NULL AND k.{c} IS NOT NULL)::INT" for c in COLS)
    same = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in COLS)
    return f"""asks AS (SELECT {', '.join(COLS)}, min(user_id) AS kind FROM {receivers} GROUP BY ALL), kinds AS (SELECT {', '.join(COLS)}, min(user_id) AS kind FROM {donors} GROUP BY ALL),
far AS (SELECT r.kind AS rid, kt.user_id AS donor, k.kind, sqrt(6.0 / nullif({both}, 0) * ({dist})) AS d, {', '.join(f'k.{c} AS {c}' for c in COLS)}
  FROM asks r CROSS JOIN kinds k JOIN {donors} kt ON {same('kt', 'k')} WHERE {' OR '.join(f'r.{c} IS NULL' for c in COLS)}),
""" + ", ".join(f"f_{c} AS (SELECT rid, avg({c}) AS {c} FROM (SELECT rid, {c}, row_number() OVER (PARTITION BY rid ORDER BY d, kind, donor) AS rn FROM far WHERE d IS NOT NULL AND {c} IS NOT NULL) WHERE rn <= 5 GROUP BY rid)" for c in COLS) + f""",
filled AS (SELECT b.user_id, {', '.join(f'round(coalesce(b.{c}, f_{c}.{c}, (SELECT avg({c}) FROM {donors})), 6) AS {c}' for c in COLS)}
FROM {receivers} b JOIN asks ON {same('b', 'asks')} {' '.join(f'LEFT JOIN f_{c} ON f_{c}.rid = asks.kind' for c in COLS)})"""


@q(f"WITH {KEPT}, {_knn_sql('kept', 'kept')} SELECT * FROM filled")
def knn_impute(s, d):
    return prepare.knn_impute(kept(s, d), COLS)


_SPLIT = "train AS (SELECT * FROM kept WHERE user_id % 5 <> 0), fresh AS (SELECT * FROM kept WHERE user_id % 5 = 0)"


@q(f"WITH {KEPT}, {_SPLIT}, {_knn_sql('fresh', 'train')} SELECT * FROM filled")
def impute_new_rows(s, d):
    """The imputer is fitted on some customers and fills the gaps of others."""
    x = kept_table(s, d)
    return prepare.impute(x.where("user_id % 5 = 0"), written(prepare.fit_imputer(x.where("user_id % 5 <> 0"), COLS), "imputer"), COLS)


_PART = f"part AS (SELECT k.*, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {uniform_sql(1, 'c_custkey', 'holdout')}, c_custkey) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM kept k JOIN customer ON c_custkey = user_id), train AS (SELECT * EXCLUDE (rn, n) FROM part WHERE rn > greatest(round(n * 0.2), 1))"
_FITS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, round(avg({c}), 5) AS shift, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 5) AS scale FROM filled" for c in COLS)


@q(f"WITH {KEPT}, {_PART}, {_knn_sql('train', 'train')} {_FITS}")
def training_tables(s, d):
    """What a run fits before it selects a model: held-out customers take no part in filling or scaling."""
    y = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("y"))
    mine = splits.holdout(written(kept(s, d).join(y, "user_id"), "profiles"), "y", "user_id").where("not is_test").drop("is_test")
    run, filled, _ = training.fit_tables(mine, COLS, segment=False)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.round(f"shift_{c}", 5).alias("shift"), F.round(f"scale_{c}", 5).alias("scale")) for c in COLS])
    return run.scaler.crossJoin(filled.agg(F.count("*").alias("n"))).select("n", F.explode(cells).alias("c")).select("c.column", "n", "c.shift", "c.scale")  # one row each


@q()
def new_user_channels(s, d):
    """A whole run on the orders of customers that are not divisible by five, and the priorities it ranks for the others, gaps in their profiles and all."""
    o = table(s, d, "orders")
    log = o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.substring("o_orderpriority", 1, 1).cast("int").alias("touch"), F.lit(1.0).alias("duration"), F.col("o_orderkey").alias("ord"))
    rows = written(training.prepare_rows(log, kept_table(s, d).withColumn("ord", F.col("user_id")), list(COLS)), "journeys")
    fresh = F.col("user_id") % 5 == 0
    run = training.train(rows.where(~fresh), list(COLS), [models.ROSTER["naive_bayes"]], segment=False)["run"]
    return training.score(run, rows.where(fresh)).select("user_id", "is_noise", F.transform("top", lambda t: t["code"]).alias("codes"), F.round("confidence", 4).alias("confidence"), "n_tail")


_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in COLS)
_UNIT = lambda src: ", ".join(f"({src}.{c} - m.m_{c}) / m.s_{c}" for c in COLS)


@q(f"""WITH {KEPT}, {_SPLIT}, {_knn_sql('fresh', 'train')}, whole AS (SELECT * FROM train WHERE {_WHOLE}),
m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in COLS)} FROM whole),
core AS (SELECT user_id, region::INT AS label, [{_UNIT('whole')}] AS v FROM whole, m WHERE user_id % 2 = 1), asked AS (SELECT user_id, [{_UNIT('filled')}] AS v FROM filled, m),
near AS (SELECT a.user_id, c.label, list_distance(a.v, c.v) AS d FROM asked a CROSS JOIN core c QUALIFY row_number() OVER (PARTITION BY a.user_id ORDER BY list_distance(a.v, c.v), c.user_id) = 1)
SELECT user_id, CASE WHEN d > 1 THEN -1 ELSE label END AS segment, d > 1 AS is_noise, {', '.join(f'filled.{c}' for c in COLS)} FROM near JOIN filled USING (user_id)""")
def predict_path(s, d):
    """New customers through a fitted run: imputer, scaler and gate come from other customers."""
    x = kept_table(s, d)
    old = x.where("user_id % 5 <> 0")
    whole = old.dropna(subset=COLS)
    scaler = prepare.fit_scaler(whole, COLS, "standard")
    cores = prepare.scale(whole.where("user_id % 2 = 1").withColumn("label", F.col("region").cast("int")), scaler, COLS)
    cores = cores.select(F.col("user_id").alias("id"), F.array(*COLS).alias("v"), "label", F.col("label").alias("dbscan_label"))
    run = training.Run(COLS, written(prepare.fit_imputer(old, COLS), "imputer"), scaler, None, cores, 1.0)
    return training.assign_segments(run, x.where("user_id % 5 = 0")).select("user_id", "segment", "is_noise", *COLS)


@q("""SELECT CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'machines' WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'home' ELSE 'behavioural' END AS "group", round(sum(c_acctbal), 4) AS importance FROM customer GROUP BY 1""")
def grouped_importance(s, d):
    per = table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("block")).agg(F.sum("c_acctbal").alias("mean"))
    groups = {"AUTOMOBILE": "machines", "MACHINERY": "machines", "HOUSEHOLD": "home", "FURNITURE": "home"}
    return _round(metrics.grouped_importance(per, groups), ["importance"], 4)


def _scaled_sql(shift, spread):
    cols = ", ".join(f"round((c_acctbal_{i} - {shift.format(c=f'c_acctbal_{i}')}) / CASE WHEN {spread.format(c=f'c_acctbal_{i}')} = 0 THEN 1 ELSE {spread.format(c=f'c_acctbal_{i}')} END, 6) AS c_acctbal_{i}" for i in (0, 1, 2))
    return f"WITH x AS (SELECT c_custkey, c_acctbal AS c_acctbal_0, c_nationkey::DOUBLE AS c_acctbal_1, 5.0::DOUBLE AS c_acctbal_2 FROM customer) SELECT c_custkey, {cols} FROM x"


def _scaled(s, d, kind):
    x = table(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("c_acctbal_0"), F.col("c_nationkey").cast("double").alias("c_acctbal_1"), F.lit(5.0).alias("c_acctbal_2"))
    cols = [f"c_acctbal_{i}" for i in range(3)]
    return _round(prepare.scale(x, prepare.fit_scaler(x, cols, kind), cols), cols)


@q(_scaled_sql("(SELECT quantile_cont({c}, 0.5) FROM x)", "(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM x)"))
def robust_scale(s, d):
    return _scaled(s, d, "robust")


@q(_scaled_sql("(SELECT min({c}) FROM x)", "(SELECT max({c}) - min({c}) FROM x)"))
def minmax_scale(s, d):
    return _scaled(s, d, "minmax")


@q(_scaled_sql("(SELECT avg({c}) FROM x)", "(SELECT stddev_pop({c}) FROM x)"))
def standard_scale(s, d):
    return _scaled(s, d, "standard")


@q("SELECT c_custkey, " + ", ".join(f"(coalesce(CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey % 4 END, -1) = {v})::INT AS \"g_{v}\"" for v in (-1, 0, 1, 2, 3)) + " FROM customer")
def one_hot(s, d):
    x = table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, None).otherwise(F.col("c_nationkey") % 4).alias("g"))
    return prepare.one_hot(x, "g", prepare.categories(x, "g")).drop("g")


_GROUPS = {"standard": ["age"], "minmax": ["income", "household"], "robust": ["stage"]}


@q(f"""WITH {KEPT}, m AS (SELECT user_id, {_MED} FROM kept)
SELECT user_id, round((age - (SELECT avg(age) FROM m)) / (SELECT stddev_pop(age) FROM m) + (income - (SELECT min(income) FROM m)) / (SELECT max(income) - min(income) FROM m)
 + (household - (SELECT min(household) FROM m)) / (SELECT max(household) - min(household) FROM m) + (stage - (SELECT quantile_cont(stage, 0.5) FROM m)) / (SELECT quantile_cont(stage, 0.75) - quantile_cont(stage, 0.25) FROM m)
 + age + income + household + stage, 5) AS total, 8 AS width FROM m""")
def feature_matrix(s, d):
    x = kept(s, d)
    out, _ = prepare.feature_matrix(x, x, _GROUPS, "raw+scaled")
    return out.select("user_id", F.round(F.aggregate("features", F.lit(0.0), lambda a, b: a + b), 5).alias("total"), F.size("features").alias("width"))


_LI = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@q(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, b in enumerate(_LI) for a in _LI[:i]))
def corr_matrix(s, d):
    return _round(prepare.correlations(table(s, d, "lineitem"), list(_LI)), ["r"])


@q("SELECT unnest(CASE WHEN abs(corr(l_quantity, l_extendedprice)) > 0.9 THEN ['l_quantity', 'l_discount'] ELSE ['l_quantity', 'l_extendedprice', 'l_discount'] END) AS kept FROM lineitem")
def corr_filter(s, d):
    x = table(s, d, "lineitem").withColumn("twice", F.col("l_quantity") * 2)
    kept_cols = prepare.correlation_filter(x, ["l_quantity", "twice", "l_extendedprice", "l_discount"])
    return x.agg(F.count("*")).select(F.explode(F.array(*[F.lit(c) for c in kept_cols])).alias("kept"))


@q(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS n, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS "distinct", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean,
 round(stddev_samp({c}), 4) AS std, quantile_cont({c}, 0.25)::DOUBLE AS p25, quantile_cont({c}, 0.5)::DOUBLE AS p50, quantile_cont({c}, 0.75)::DOUBLE AS p75 FROM lineitem""" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")))
def profile_columns(s, d):
    return _round(profile.profile_columns(table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"]), ["mean", "std"], 4)


@q("SELECT c_nationkey % 5 - 1 AS cluster, 'c_acctbal' AS \"column\", count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, min(c_acctbal) AS min, quantile_cont(c_acctbal, 0.5) AS p50, max(c_acctbal) AS max FROM customer GROUP BY ALL")
def cluster_profile(s, d):
    x = table(s, d, "customer").withColumn("cluster", F.col("c_nationkey") % 5 - 1)
    return _round(profile.cluster_describe(x, "cluster", ["c_acctbal"]), ["mean", "std"], 4)


@q("SELECT cluster, c_mktsegment, n, round(100.0 * n / sum(n) OVER (PARTITION BY cluster), 6) AS percent FROM (SELECT c_nationkey % 5 - 1 AS cluster, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)")
def cluster_counts(s, d):
    x = table(s, d, "customer").withColumn("cluster", F.col("c_nationkey") % 5 - 1)
    return _round(profile.cluster_counts(x, "cluster", "c_mktsegment"), ["percent"])


@q("SELECT CASE WHEN c_nationkey % 5 = 0 THEN 'cluster_noise' ELSE 'cluster_' || (c_nationkey % 5 - 1)::VARCHAR END AS cluster_name, count(*) AS n FROM customer GROUP BY 1")
def named_clusters(s, d):
    x = table(s, d, "customer").withColumn("cluster", F.col("c_nationkey") % 5 - 1)
    return profile.named_clusters(x, "cluster").groupBy("cluster_name").agg(F.count("*").alias("n"))


@q("SELECT c_nationkey % 5 - 1 AS cluster, count(*) AS n FROM customer WHERE c_nationkey % 5 > 0 GROUP BY 1")
def segment_sizes(s, d):
    return profile.segment_sizes(table(s, d, "customer").withColumn("cluster", F.col("c_nationkey") % 5 - 1), "cluster")


@q(f"""WITH {KEPT}, m AS (SELECT user_id, {_MED} FROM kept)
SELECT user_id, round((age - (SELECT avg(age) FROM m)) / (SELECT stddev_pop(age) FROM m) + (income - (SELECT min(income) FROM m)) / (SELECT max(income) - min(income) FROM m) + 1
 + (stage - (SELECT quantile_cont(stage, 0.5) FROM m)) / (SELECT quantile_cont(stage, 0.75) - quantile_cont(stage, 0.25) FROM m) + (household - (SELECT avg(household) FROM m)) / (SELECT stddev_pop(household) FROM m), 5) AS total,
 (4 + (SELECT count(DISTINCT region) FROM m))::INT AS width FROM m""")
def static_features(s, d):
    x = prepare.median_impute(kept_table(s, d), COLS)
    out, _ = prepare.static_encoder(x, x, ["age"], ["income"], ["region"], ["stage"], ["household"])
    return out.select("user_id", F.round(F.aggregate("static", F.lit(0.0), lambda a, b: a + b), 5).alias("total"), F.size("static").alias("width"))

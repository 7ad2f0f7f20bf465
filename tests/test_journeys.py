"""Hand-written rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from journeyspark.contracts import ContractError
from journeyspark.operators import clean, journey, prepare, sequences
from journeyspark.sources import dimensions, files, synthetic

T0 = datetime(2016, 5, 1, 10)


def log(spark, rows):
    """(user, minutes, touch, duration[, device, own, any])"""
    full = [(u, T0 + timedelta(minutes=m), t, float(dur), i, *(rest or ("FIXED", 0, 0))) for i, (u, m, t, dur, *rest) in enumerate(rows)]
    return spark.createDataFrame(full, "user_id bigint, ts timestamp, touch int, duration double, ord bigint, device string, purchase_own int, purchase_any int")


def touches(df):
    return [r.touch for r in df.orderBy("user_id", "run").collect()]


def test_repeats_collapse(spark):
    assert touches(journey.compress(log(spark, [(1, 0, 3, 10), (1, 5, 3, 20), (1, 10, 3, 30), (1, 120, 7, 40)]))) == [3, 7]


def test_runs_restart_per_user(spark):
    out = journey.compress(log(spark, [(1, 0, 3, 10), (1, 5, 3, 20), (2, 0, 3, 10), (2, 5, 3, 20)])).collect()
    assert sorted((r.user_id, r.run) for r in out) == [(1, 1), (2, 1)]


def test_return_is_a_new_run(spark):
    assert touches(journey.compress(log(spark, [(1, 0, 3, 1), (1, 5, 7, 1), (1, 9, 3, 1)]))) == [3, 7, 3]


def test_cleaning_drops_bad_rows(spark):
    raw = spark.createDataFrame([(1, "not a date", "1", "10"), (1, "2016-05-01 12:00:00", "7", "10"), (1, "2016-05-01 13:00:00", "8", "0"), (1, "2016-05-01 13:00:00", "x", "5"), (None, "2016-05-01 13:00:00", "9", "5")], "user_id bigint, ts string, touch string, duration string")
    assert [r.touch for r in clean.clean_clicks(raw).collect()] == [7]


def test_newest_three(spark):
    win = journey.journey_window(log(spark, [(1, i, i, 1) for i in range(1, 7)] + [(2, 0, 1, 1), (2, 1, 2, 1)]))
    assert [tuple(r) for r in win.collect()] == [(1, 6, 5, 4)]


def test_equal_times_keep_file_order(spark):
    win = journey.journey_window(log(spark, [(1, 0, 5, 1), (1, 10, 6, 1), (1, 10, 7, 1)]))
    assert win.select("step1", "step2", "step3").first() == (6, 7, 5)


def test_inverted_window_is_caught(spark):
    ev = log(spark, [(1, i, i, 1) for i in range(1, 5)])
    bad = journey.journey_window(ev).select("user_id", F.col("step3").alias("step1"), "step2", F.col("step1").alias("step3"))
    assert journey.window_mismatches(bad, ev).count() == 1
    with pytest.raises(ValueError):
        journey.verify_window(bad, ev)


def test_durations_add_up_and_gaps(spark):
    ev = journey.build_events(log(spark, [(1, 0, 3, 10, "FIXED", 0, 0), (1, 60, 3, 20, "FIXED", 0, 0), (1, 120, 7, 40, "MOBILE", 1, 1)])).orderBy("run").collect()
    assert [(r.duration, r.device_mobile, r.purchase_own) for r in ev] == [(30.0, 0, 0), (40.0, 1, 1)]
    assert ev[0].gap_h == 0 and abs(ev[1].gap_h - 2) < 1e-9


@pytest.mark.parametrize(("seconds", "n"), [(1800, 1), (1801, 2)])
def test_session_boundary(spark, seconds, n):
    rows = spark.createDataFrame([(1, T0, 1), (1, T0 + timedelta(seconds=seconds), 2)], "user_id bigint, ts timestamp, ord bigint")
    assert journey.sessions(rows).first().n_sessions == n


def test_aggregates_of_one_input_and_sunday(spark):
    sunday = [(1, 0, 3, 10), (1, 5, 4, 20), (1, 9, 5, 20)]
    a = journey.journey_aggregates(journey.build_events(log(spark, sunday)), min_len=2).first()
    assert a.last_dow == 6 and a.last_is_weekend == 1 and a.seq_len == 2
    one = journey.journey_aggregates(journey.build_events(log(spark, sunday[:2])), min_len=2).first()
    assert one.gap_std_h == 0 and one.seq_len == 1


def test_empty_table(spark):
    ev = journey.build_events(log(spark, [(1, 0, 3, 10)]).where("false"))
    assert journey.journey_window(ev).count() == 0 and journey.build_examples(ev).count() == 0


def test_padding_keeps_the_newest(spark):
    df = spark.createDataFrame([([1, 2, 3, 99],), ([4],)], "seq_touch array<int>")
    got = df.select(sequences.pad(sequences.encode("seq_touch"), 3).alias("x")).collect()
    assert [r.x for r in got] == [[2, 3, 21], [4, 0, 0]]


def test_sparsity_keeps_exactly_half(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 1.0, 1.0)], "k int, a double, b double")
    assert sorted(r.k for r in clean.sparsity_filter(df, ["a", "b"]).collect()) == [1, 3]


def test_knn_impute_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, (60, 4)).astype(float)
    x[rng.random((60, 4)) < 0.15] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    got = prepare.knn_impute(spark.createDataFrame(rows, "user_id bigint, a double, b double, c double, d double"), ["a", "b", "c", "d"]).orderBy("user_id").collect()
    kind = {tuple(np.nan_to_num(r, nan=-1)): min(j for j in range(60) if tuple(np.nan_to_num(x[j], nan=-1)) == tuple(np.nan_to_num(r, nan=-1))) for r in x}
    for i, r in enumerate(x):
        for c in np.flatnonzero(np.isnan(r)):
            cand = []
            for j, s in enumerate(x):
                both = ~np.isnan(r) & ~np.isnan(s)
                if both.any() and not np.isnan(s[c]):
                    cand.append((round(float(np.sqrt(4 / both.sum() * ((r - s)[both] ** 2).sum())), 12), kind[tuple(np.nan_to_num(s, nan=-1))], j, s[c]))
            want = np.mean([v for *_, v in sorted(cand)[:5]]) if cand else np.nanmean(x[:, c])
            assert abs(got[i][1 + int(c)] - want) < 1e-5


def test_form_errors(spark):
    good = dict(GenderID="2", Age="30+", SPSS_Regio5="1", BAS_huishoudgrootte="4", BAS_werkzaamheid_resp="2", afg_kinderen_huishouden="2", BAS_bruto_jaarinkomen="4", AFG_sk2015="5", BAS_voltooide_opleiding8_resp="5", SPSS_Lifestage=" 7 ", step_1_channel="16", step_2_channel="EMAIL")
    bad = good | {"Age": "-3", "GenderID": "9999", "BAS_huishoudgrootte": "", "step_1_channel": "fax"}
    a, b = clean.validate_form(spark.createDataFrame([good, bad])).collect()
    assert a.errors == {} and a["values"].Age == 30 and a["values"].step_2_channel == 20
    assert b.errors == {"Age": "out_of_range", "GenderID": "unknown_code", "BAS_huishoudgrootte": "required", "step_1_channel": "not_a_number"}


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "users.csv")
    (tmp_path / "users.csv").write_text("UserID , Age\n1,--\n2,40\n3,N/A\n")
    df = files.read_csv(spark, path, ("UserID", "Age"))
    assert [r.Age for r in df.orderBy("UserID").collect()] == [None, "40", None]
    with pytest.raises(ContractError):
        files.read_csv(spark, path, ("Income",))
    with pytest.raises(FileNotFoundError, match=r"a\.csv.*b\.csv"):
        files.load_dataset(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "b.csv")})
    files.export(df, str(tmp_path / "out" / "users.csv"))
    assert files.read_directory(spark, str(tmp_path / "out"))["users"].count() == 3
    files.write_manifest(spark, {"run": {"k": 3}}, str(tmp_path / "m"))
    assert files.read_manifest(spark, str(tmp_path / "m")) == {"run": {"k": 3}}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        files.write_manifest(spark, {}, str(tmp_path / "m"), force=False)
    for _ in range(2):
        files.append_audit(df, str(tmp_path / "audit"), "2024-01-01 00:00:00")
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 6


def test_dimensions_and_synthetic(spark):
    assert dimensions.all_dimensions(spark).count() == 75
    a, b = synthetic.journeys(spark, 20), synthetic.journeys(spark.newSession(), 20)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    n = a.groupBy("UserID").count().collect()
    assert len(n) == 20 and all(8 <= r["count"] <= 20 for r in n)
    assert synthetic.profiles(spark, 300).where("Age = '--'").count() > 3


def test_samples_codes_and_overlap(spark):
    people = synthetic.profiles(spark, 300, overlap=0.3)
    clean_ = synthetic.profiles(spark, 300)
    got = files.samples({"people": people, "codes": dimensions.dimension(spark, "GenderID")}, 2).collect()
    assert sorted(r.table for r in got) == ["codes", "codes", "people", "people"] and all(r.row.startswith("{") for r in got)
    assert sorted(r.code for r in dimensions.valid_codes(spark, "GenderID").collect()) == [1, 2]
    stage = {r.UserID: r.SPSS_Lifestage for r in clean_.collect()}
    moved = sum(stage[r.UserID] != r.SPSS_Lifestage for r in people.collect())
    assert 40 <= moved <= 140 and [r.ord for r in people.orderBy("UserID").limit(3).collect()] == [0, 1, 2]

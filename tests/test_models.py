"""Segmentation, selection and streams on planted data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from journeyspark.operators import cluster, neighbors, prepare, profile, resample, splits
from journeyspark.plans import models, search, training
from journeyspark.sources import synthetic


def vectors(spark, x, y=None):
    rows = [(i, int(y[i]) if y is not None else 0, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, y int, v array<double>")


@pytest.fixture(scope="module")
def toy():
    rng = np.random.default_rng(0)
    return np.concatenate([rng.normal(0, 1, (30, 2)), rng.normal(5, 1, (6, 2))]), np.array([0] * 30 + [1] * 6)


def test_knn_join_is_exact(spark, toy):
    x, _ = toy
    got = {(r.id, r["rank"]): r.neighbour for r in neighbors.knn_join(vectors(spark, x), vectors(spark, x), 3).collect()}
    for i in range(len(x)):
        d = np.sqrt(((x[i] - x) ** 2).sum(1))
        want = [j for j in np.argsort(d, kind="stable") if j != i][:3]
        assert [got[i, r] for r in (1, 2, 3)] == want


def test_smote_fills_the_small_class_between_neighbours(spark, toy):
    x, y = toy
    out = resample.smote(vectors(spark, x, y)).collect()
    new = [r for r in out if r.id < 0]
    assert len(new) == 24 and all(r.y == 1 for r in new)
    few = x[30:]
    for r in new:
        gaps = [np.linalg.norm(a - r.v) + np.linalg.norm(r.v - b) - np.linalg.norm(a - b) for a in few for b in few]
        assert min(gaps) < 1e-9


def test_tomek_removes_ambiguous_middle(spark):
    x = np.array([(0, 0), (0.1, 0), (4.9, 0), (5, 0), (0, 5), (5, 5), (2.5, 0)])
    d = vectors(spark, x, [0, 0, 1, 1, 0, 1, 0])
    links = {(r.a, r.b) for r in resample.tomek_links(d).collect()}
    brute = set()
    yy = np.array([0, 0, 1, 1, 0, 1, 0])
    dist = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    for a in range(7):
        other = [b for b in range(7) if yy[b] != yy[a]]
        b = min(other, key=lambda j: (dist[a, j], j))
        own = lambda i: min(dist[i, j] for j in range(7) if j != i and yy[j] == yy[i])
        if dist[a, b] <= own(a) or dist[a, b] <= own(b):
            brute.add((a, b))
    assert links == brute


def test_dbscan_finds_blobs_and_outliers(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.4, (40, 3)), rng.normal(12, 0.4, (40, 3)), rng.normal(60, 3, (5, 3))])
    out = {r.id: r.label for r in cluster.dbscan(vectors(spark, x), 2.0, 5).collect()}
    assert {out[i] for i in range(40)} == {0} and {out[i] for i in range(40, 80)} == {1} and {out[i] for i in range(80, 85)} == {-1}


def test_selection_and_spectral_on_blobs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (20, 3)) for c in (0, 20, 40)])
    d = vectors(spark, x)
    assert cluster.select_k([r.asDict() for r in cluster.k_probe(d, (2, 3, 4), range(3)).collect()])["k"] == 3
    truth = d.select("id", F.floor(F.col("id") / 20).cast("int").alias("label"))
    assert cluster.adjusted_rand(cluster.spectral(d, 3, 0.05, 40, seeds=range(3)), truth).first()[0] == 1.0


def test_folds_and_holdout_are_stratified(spark):
    d = vectors(spark, np.zeros((120, 1)), [0] * 100 + [1] * 20)
    per = splits.folds(d, "y", "id").groupBy("y", "fold").count().collect()
    assert all(r["count"] == (20 if r.y == 0 else 4) for r in per)
    rare = vectors(spark, np.zeros((202, 1)), [0] * 200 + [1] * 2)
    assert splits.holdout(rare, "y", "id").where("is_test and y = 1").count() == 1


def test_choose_prefers_plain_within_the_spread():
    row = lambda n, s, f, sp, p=True: {"name": n, "sampler": s, "f1_macro": f, "spread": sp, "probabilities": p, "failed": False}
    grid = [row("a", "none", 0.60, 0.02), row("b", "none", 0.62, 0.02), row("b+smote", "smote", 0.63, 0.04), row("svc", "none", 0.9, 0.1, False)]
    assert models.choose(grid)["name"] == "a"
    assert models.choose([row("a", "none", 0.3, 0.01), row("a+smote", "smote", 0.6, 0.01)])["name"] == "a+smote"


def test_sampler_sees_training_rows_only(spark, monkeypatch):
    x = np.random.default_rng(5).normal(0, 1, (60, 2))
    seen = []
    monkeypatch.setattr(models.resample, "resampler", lambda kind, **_: lambda d: seen.append({r.id for r in d.select("id").collect()}) or d)
    out = models.cross_validate(models.Candidate("lr", models.ROSTER["logistic"].make, "smote"), vectors(spark, x, [0, 1] * 30).withColumn("y", F.col("y").cast("string")), 2)
    assert len(out) == 2 and not any(r["error"] for r in out)
    assert len(seen) == 2 and not seen[0] & seen[1] and len(seen[0] | seen[1]) == 60


COLS = ["Age", "BAS_huishoudgrootte", "SPSS_Lifestage"]


def planted(spark, n):
    clicks = synthetic.journeys(spark, n).select(F.col("UserID").alias("user_id"), F.col("TIMESPSS").alias("ts"), (F.col("type_touch") % 3 + 1).alias("touch"), F.col("Duration").alias("duration"), "ord")
    prof = synthetic.profiles(spark, n).withColumnRenamed("UserID", "user_id").replace("--", None)
    return clicks, prof.select("user_id", "ord", *COLS)


def test_train_end_to_end(spark, tmp_path):
    clicks, prof = planted(spark, 120)
    later = prof.limit(5).withColumns({"ord": F.col("ord") + 1000, "Age": F.lit("17")})  # second rows of a user don't count
    rows = training.prepare_rows(clicks, prof.unionByName(later), COLS)
    assert rows.count() > 80 and rows.where("Age is null").count() > 0 and rows.where("Age = 17").count() == 0
    got = training.train(rows, COLS, [models.ROSTER["naive_bayes"]], str(tmp_path / "out"), segment=False)
    assert 0 <= got["manifest"]["holdout"]["accuracy"] <= 1 and (tmp_path / "out" / "model").exists() and got["manifest"]["verified"]["value"]
    with pytest.raises(Exception, match="(?i)exist"):
        training.train(rows, COLS, [models.ROSTER["naive_bayes"]], str(tmp_path / "out"), segment=False, force=False)


def test_segments_artefacts_and_new_rows(spark, tmp_path):
    """Train with segments on some users, write, read back, and score users that the run has never seen, with gaps."""
    clicks, prof = planted(spark, 260)
    old = prof.where("user_id % 4 <> 0")
    rows = training.prepare_rows(clicks, old, COLS)
    got = training.train(rows, COLS, [models.ROSTER["naive_bayes"]], str(tmp_path / "run"), min_samples=8, ks=(2, 3), per_segment=True)
    told = got["manifest"]["run"]
    assert told["n_segments"] >= 2 and told["segments"] and got["manifest"]["verified"]["value"]
    run = training.load(spark, str(tmp_path / "run"))
    assert set(run.segments) == set(told["segments"]) and run.eps == told["eps"]
    steps = F.array(F.lit(1), F.lit(2))
    fresh = training.clean_profiles(prof.where("user_id % 4 = 0"), COLS).withColumns({"step2": steps[0], "step3": steps[1]})
    scored = training.score(run, fresh).collect()
    assert len(scored) == fresh.count() and any(r.Age is None for r in fresh.collect())
    assert all(len(r.top) == 3 and abs(r.confidence + r.tail - 100) < 1e-6 for r in scored)
    again = {r.user_id: r.top for r in training.score(got["run"], fresh).collect()}
    assert all(again[r.user_id] == r.top for r in scored)
    filled = training.assign_segments(run, fresh).collect()
    cores = run.cores.collect()
    scale = run.scaler.first()
    for r in filled[:20]:
        v = np.array([(r[c] - scale[f"shift_{c}"]) / scale[f"scale_{c}"] for c in COLS])
        d = [(np.linalg.norm(v - np.array(c.v)), c.id, c.label if c.label is not None else c.dbscan_label) for c in cores]
        near = min(d)
        assert r.is_noise == (near[0] > run.eps) and (r.is_noise or abs(min(d)[0] - near[0]) < 1e-9 and r.segment in {x[2] for x in d if x[0] < near[0] + 1e-9})


def test_held_out_users_take_part_in_no_fit(spark, monkeypatch):
    """What is fitted gets the training users' rows alone, gaps and all; held-out users only pass through what came out."""
    clicks, prof = planted(spark, 120)
    rows = training.prepare_rows(clicks, prof, COLS)
    marked = splits.holdout(splits.drop_rare(rows.withColumn("y", F.col("step1").cast("string")), "y"), "y", "user_id")
    held = {r.user_id for r in marked.where("is_test").collect()}
    fitted, placed, fits, selected = [], [], [], []
    spy = lambda seen, real: lambda d, *args, **named: seen.append({r.user_id for r in d.select("user_id").collect()}) or real(d, *args, **named)
    monkeypatch.setattr(training, "fit_tables", spy(fitted, training.fit_tables))
    monkeypatch.setattr(training.prepare, "fit_imputer", spy(fits, prepare.fit_imputer))
    monkeypatch.setattr(training.prepare, "fit_scaler", spy(fits, prepare.fit_scaler))
    monkeypatch.setattr(training, "assign_segments", (lambda real: lambda run, d: placed.append({r.user_id for r in d.collect()}) or real(run, d))(training.assign_segments))
    monkeypatch.setattr(models, "cross_validate", (lambda real: lambda c, d, **named: selected.append({r.id for r in d.collect()}) or real(c, d, **named))(models.cross_validate))
    training.train(rows, COLS, [models.ROSTER["naive_bayes"]], segment=False)
    mine = {r.user_id for r in marked.where("not is_test").collect()}
    assert held and fitted == [mine] and fits == [mine, mine] and placed == [held] and selected == [mine]


def labelled(spark, n=90, seed=7):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.8, (n // 3, 3)) for c in (0, 4, 8)])
    return vectors(spark, np.abs(x), [i // (n // 3) for i in range(n)]).withColumn("y", F.col("y").cast("string"))


@pytest.mark.parametrize("name", sorted(models.ROSTER))
def test_every_candidate_fits_and_predicts(spark, name):
    d = splits.holdout(labelled(spark), "y", "id")
    c = models.ROSTER[name]
    pred, labels = models.predict(models.fit(c, d.where("not is_test")), d.where("is_test"))
    rows = pred.collect()
    assert labels == ["0", "1", "2"] and sum(r.y_true == r.y_pred for r in rows) >= 0.8 * len(rows)
    assert all(r.probs is None or abs(sum(r.probs) - 1) < 1e-6 for r in rows) and (not c.probabilities or all(r.probs for r in rows))


def test_variants_grid_and_choice(spark):
    d = labelled(spark).where("y <> '2' or id % 3 = 0")  # one class is small
    grid = models.variants([models.ROSTER["logistic"], models.ROSTER["naive_bayes"]])
    assert [c.label for c in grid][:5] == ["logistic", "logistic+smote", "logistic+adasyn", "logistic+smote_tomek", "naive_bayes"]
    results = [r for c in (*grid[:4], grid[4]) for r in models.cross_validate(c, d, 2)]
    assert not any(r["error"] for r in results)
    won = models.choose(models.summary(results))
    assert won["sampler"] == "none" and won["f1_macro"] > 0.8


def test_failures_are_results_until_all_fail(spark):
    d = labelled(spark)
    bad = models.Candidate("bad", lambda k, n: 1 / 0)
    got = search.evaluate([bad, models.ROSTER["naive_bayes"]], d, d)
    assert "division" in got[0]["error"] and got[1]["error"] is None
    with pytest.raises(ValueError, match="no candidate"):
        search.evaluate([bad], d, d)
    with pytest.raises(ValueError, match="no candidate"):
        models.choose(models.summary(models.cross_validate(bad, d, 2)))


def test_feature_sets_baselines_and_search(spark):
    p = splits.three_way(labelled(spark), "y", "id")
    whole = tuple(p.where(f"part = '{x}'").drop("part") for x in ("train", "val", "test"))
    noise = tuple(x.withColumn("v", F.array((F.col("id") % 2).cast("double"))) for x in whole)
    got = search.choose_feature_set({"noise": noise, "whole": whole}, [models.ROSTER["logistic"]])
    assert got["set"] == "whole" and got["test"]["accuracy"] > 0.8
    grid = search.baseline_grid({"noise": noise, "whole": whole}, [models.ROSTER["logistic"], models.ROSTER["naive_bayes"]])
    assert len(grid) == 4 and sum(r["test_f1"] is not None for r in grid) == 2
    trials = search.random_search(whole[0], whole[1], trials=2, knobs={"numTrees": (5, 10), "maxDepth": (2, 3)})
    assert len(trials) == 2 and trials[0]["f1_macro"] >= trials[1]["f1_macro"]


def test_segment_models_need_enough_rows(spark):
    d = labelled(spark).withColumn("segment", F.when(F.col("id") % 9 == 0, 1).otherwise(0))
    assert set(models.fit_segments(models.ROSTER["naive_bayes"], d, least=30)) == {0}


def test_notes_and_drift():
    run = {"segments": 1, "smallest_segment": 12, "imputed_share": 0.4, "k": 5, "k_low": 2, "k_high": 5, "cv_f1": 0.9, "holdout_f1": 0.6}
    assert len(models.integrity_notes(run)) == 5 and models.integrity_notes({}) == []
    assert models.split_drift({"train": 70, "val": 15}, {"train": 70, "val": 14, "test": 16}) == {"test": (0, 16), "val": (15, 14)}


def test_algorithm_table(spark):
    rng = np.random.default_rng(6)
    d = vectors(spark, np.concatenate([rng.normal(c, 0.3, (20, 2)) for c in (0, 9)]))
    rows = {r.algorithm: r for r in cluster.algorithm_table(d, 2, range(1)).collect()}
    assert {"kmeans", "gaussian_mixture", "bisecting_kmeans", "spectral_laplacian", "spectral_nearest_10"} <= set(rows)
    assert rows["kmeans"].silhouette > 0.8 and all(r.seconds > 0 and r.noise == 0 for r in rows.values())


def test_spectral_on_a_neighbour_graph(spark):
    rng = np.random.default_rng(12)
    turn = np.arange(60) / 30 * 2 * np.pi + rng.normal(0, 0.02, 60)
    ring = np.stack([np.cos(turn), np.sin(turn)], 1) * np.where(np.arange(60) < 30, 1.0, 6.0)[:, None]  # k-means can't part them
    d = vectors(spark, ring)
    truth = d.select("id", (F.col("id") >= 30).cast("int").alias("label"))
    assert cluster.adjusted_rand(cluster.spectral_graph(d, 2, 6, seeds=range(3)), truth).first()[0] == 1.0


def test_meetings_over_many_blocks(spark, monkeypatch):
    """Small blocks, so that rows go to pivots, groups are ruled out and labels are split: the same answers as brute force."""
    monkeypatch.setattr(neighbors, "ROWS", 32)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 1.0, (60, 3)) for c in (0, 30, 60, 90)] + [np.zeros((40, 3))])
    y = [i % 5 for i in range(len(x))]
    d = vectors(spark, x, y)
    dist = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    order = lambda i, ok: sorted((dist[i, j], j) for j in range(len(x)) if j != i and ok(j))[:4]
    for kind, ok in (({}, lambda i: lambda j: True), ({"within": "y"}, lambda i: lambda j: y[i] == y[j]), ({"other": "y"}, lambda i: lambda j: y[i] != y[j])):
        got = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in neighbors.knn_join(d, d, 4, **kind).collect()}
        for i in range(len(x)):
            for n, (far, j) in enumerate(order(i, ok(i)), 1):
                assert got[i, n][0] == j and abs(got[i, n][1] - far) < 1e-9
    pairs = {(r.id, r.neighbour) for r in neighbors.eps_join(d, 1.5).collect()}
    assert pairs == {(i, j) for i, j in zip(*np.nonzero(dist <= 1.5))}
    for limit in (cluster.EDGES, 0):  # components in one task, and by joins
        monkeypatch.setattr(cluster, "EDGES", limit)
        got = {r.id: (r.is_core, r.label) for r in cluster.dbscan(d, 1.5, 8).collect()}
        core = (dist <= 1.5).sum(1) >= 8
        comp = np.arange(len(x))
        for _ in range(len(x)):
            new = np.array([min([comp[j] for j in np.flatnonzero((dist[i] <= 1.5) & core)] + [comp[i]]) if core[i] else comp[i] for i in range(len(x))])
            if (new == comp).all():
                break
            comp = new
        names = {r: n for n, r in enumerate(sorted({comp[i] for i in np.flatnonzero(core)}))}
        for i in range(len(x)):
            reach = [names[comp[j]] for j in np.flatnonzero((dist[i] <= 1.5) & core)]
            assert got[i] == (bool(core[i]), names[comp[i]] if core[i] else min(reach, default=-1))
    lab = d.withColumn("label", F.col("y"))
    a = [[dist[i, [j for j in range(len(x)) if y[j] == c and j != i]].mean() for c in range(5)] for i in range(len(x))]
    s = [(min(v for c, v in enumerate(r) if c != y[i]) - r[y[i]]) / max(min(v for c, v in enumerate(r) if c != y[i]), r[y[i]]) for i, r in enumerate(a)]
    assert abs(cluster.silhouette(lab).first()[0] - np.mean(s)) < 1e-9
    assert -1 <= cluster.silhouette(lab, sample=50).first()[0] <= 1


def test_new_ids_are_unique_for_any_labels_and_ids(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(0, 1, (60, 2))
    rows = [((i % 7) * 10_000 + i * 100_000_000, ("click", "view", "a long label")[0 if i < 30 else 1 if i < 45 else 2], [float(v) for v in r]) for i, r in enumerate(x)]
    d = spark.createDataFrame(rows, "id bigint, y string, v array<double>")
    for grow in (resample.smote, resample.adasyn):
        out = grow(d).collect()
        assert len({r.id for r in out}) == len(out) > 60
        assert {r.id: r.y for r in out if r.id >= 0} == {i: y for i, y, _ in rows}
    assert sorted(r["count"] for r in resample.smote(d).groupBy("y").count().collect()) == [30, 30, 30]
    kept, removed, _ = resample.smote_tomek(d)
    assert abs(kept.count() - 90 * (1 - removed)) < 1e-6


def test_approximate_forms(spark):
    x = spark.range(1000).select((F.col("id") % 100).cast("double").alias("a"), F.col("id").alias("distance"))
    row, exact = ({r.column: r for r in profile.profile_columns(x, ["a"], approx=a).collect()}["a"] for a in (True, False))
    assert abs(row.distinct - 100) <= 10 and exact.distinct == 100 and abs(row.p50 - exact.p50) <= 1
    assert prepare.fit_scaler(x, ["a"], "robust", approx=True).first()["shift_a"] == pytest.approx(49.5, abs=1)
    assert [r.eps for r in cluster.eps_candidates(x, approx=True).collect()] == pytest.approx([700, 750, 800, 850, 900], abs=5)


def test_streams_of_sessions_counts_and_scores(spark, tmp_path):
    from journeyspark.streaming import scoring

    clicks = synthetic.journeys(spark, 6).select(F.col("UserID").alias("user_id"), F.col("TIMESPSS").alias("ts"), F.col("type_touch").alias("touch"), "ord")
    clicks.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(clicks.schema).parquet(str(tmp_path / "in"))
    for name, make in (("sessions", scoring.session_counts), ("touches", scoring.touch_counts)):
        q = make(s).writeStream.outputMode("complete" if name == "touches" else "append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    total = clicks.count()
    assert spark.table("touches").agg(F.sum("n")).first()[0] == total
    assert scoring.session_counts(clicks).agg(F.sum("clicks")).first()[0] == total and spark.table("sessions").count() <= scoring.session_counts(clicks).count()
    d = labelled(spark)
    model = models.fit(models.ROSTER["naive_bayes"], d)
    d.drop("y").coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = spark.readStream.schema(d.drop("y").schema).parquet(str(tmp_path / "rows"))
    q = scoring.score_stream(rows, lambda x: models.predict(model, x)[0].select("id", "y_pred")).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r.id, r.y_pred) for r in models.predict(model, d)[0].collect()}
    assert {(r.id, r.y_pred) for r in spark.table("scored").collect()} == want


def test_journey_stream(spark, tmp_path):
    from journeyspark.operators import journey
    from journeyspark.streaming.scoring import journey_stream

    clicks = synthetic.journeys(spark, 10).select(F.col("UserID").alias("user_id"), F.col("TIMESPSS").alias("ts"), F.col("type_touch").alias("touch"), F.col("Duration").alias("duration"), "ord")
    clicks.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(clicks.schema).parquet(str(tmp_path / "in"))
    q = journey_stream(s).writeStream.outputMode("update").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in journey.journey_window(journey.compress(clicks)).collect()}
    assert {(r.user_id, r.step1, r.step2, r.step3) for r in spark.table("windows").collect()} == want

"""The whole run: journeys and profiles to segments, selection, one holdout score, artefacts; and new rows through the same steps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from journeyspark.contracts import require
from journeyspark.functions import metrics
from journeyspark.functions.lineage import written
from journeyspark.operators import clean, cluster, journey, prepare, splits
from journeyspark.sources import files

from . import models


@dataclass
class Run:
    """What a run leaves behind: enough to score rows that it has never seen."""

    columns: list[str]
    imputer: DataFrame
    scaler: DataFrame
    model: PipelineModel | None
    cores: DataFrame | None = None
    eps: float | None = None
    k: int = 5
    segments: dict[int, PipelineModel] = field(default_factory=dict)


def clean_profiles(profiles: DataFrame, columns: list[str], order: str = "ord") -> DataFrame:
    """One row for each user, the first by `order` (its place in the file), with numbers in columns and not too many gaps."""
    require(profiles, "user_id", order, *columns, what="the profiles")
    first = clean.dedupe_first(profiles.where("user_id is not null"), "user_id", order)
    return clean.sparsity_filter(clean.coerce_numeric(first, columns), columns).select("user_id", *columns)


def prepare_rows(clicks: DataFrame, profiles: DataFrame, columns: list[str], order: str = "ord", check: bool = True) -> DataFrame:
    """Users with a window of three touches and a usable profile: (user_id, step1..3, columns), gaps as they are. Nothing is fitted here."""
    return journey.assemble(clicks, written(clean_profiles(profiles, columns, order), "profiles"), check)


def _features(rows: DataFrame, columns: list[str], segment: bool) -> DataFrame:
    parts = ["step2", "step3", *columns, *(["segment"] if segment else [])]
    return rows.withColumn("v", F.array(*[F.col(c).cast("double") for c in parts]))


def fit_tables(rows: DataFrame, columns: list[str], segment: bool = True, k: int = 5, min_samples: int = 20, ks=(2, 3, 4, 5)) -> tuple[Run, DataFrame, dict]:
    """(run without a model, rows with gaps filled, segment and is_noise, choices): imputer, scaler, gate and segments, all of the given rows alone."""
    imputer = written(prepare.fit_imputer(rows, columns), "imputer")
    filled = written(prepare.impute(rows, imputer, columns, k), "imputed")
    scaler = written(prepare.fit_scaler(filled, columns, "standard"), "scaler")
    run = Run(columns, imputer, scaler, None, None, None, k)
    if not segment:
        return run, filled.withColumns({"segment": F.lit(0), "is_noise": F.lit(False)}), {}
    scaled = prepare.scale(filled, scaler, columns).select(F.col("user_id").alias("id"), F.array(*columns).alias("v"))
    labels, choices = cluster.fit_segmentation(scaled, min_samples, ks)
    labels = written(labels, "segments")
    run.eps = choices["eps"]["eps"]
    run.cores = written(scaled.join(labels.where("is_core"), "id").select(F.col("id").cast("long").alias("id"), "v", "label", "dbscan_label"), "cores")
    placed = filled.join(labels.select(F.col("id").alias("user_id"), F.col("label").alias("segment")), "user_id")
    return run, placed.withColumn("is_noise", F.col("segment") < 0), choices


def train(rows: DataFrame, columns: list[str], candidates=None, out: str | None = None, segment: bool = True, seed: int = 1, force: bool = True, k: int = 5, min_samples: int = 20, ks=(2, 3, 4, 5), per_segment: bool = False) -> dict:
    """Hold out, fit everything on the rest, select by cross-validation, score the holdout once, refit the model, write and verify.

    rows come from `prepare_rows`, with their gaps. Held-out users take part in no fitted table: gaps are filled, scaled and
    placed by what the others gave, as new users' are. Noise is left out of fitting and scoring, and counted.
    The last model is of all rows, placed by the same tables.
    """
    spark = rows.sparkSession
    rows = written(rows.withColumn("y", F.col("step1").cast("string")), "rows")
    parts = splits.holdout(splits.drop_rare(rows, "y"), "y", "user_id", seed=seed)
    mine, held = (written(parts.where(F.col("is_test") == x).drop("is_test"), "part") for x in (False, True))
    made, data, choices = fit_tables(mine, columns, segment, k, min_samples, ks)
    ready = lambda d, name: written(_features(d.where("not is_noise"), columns, segment).select(F.col("user_id").alias("id"), "y", "v", "segment"), name)
    placed = written(assign_segments(made, held), "placed")
    fit_rows, test = ready(data, "training-rows"), ready(placed, "holdout-rows")
    roster = candidates or [models.ROSTER["random_forest"], models.ROSTER["logistic"]]
    results = [r for c in roster for r in models.cross_validate(c, fit_rows, seed=seed)]
    won = models.choose(models.summary(results))
    best = next(c for c in roster if c.label == won["name"])
    pred, labels_ = models.predict(models.fit(best, fit_rows), test)
    holdout = metrics.bundle(written(pred, "predictions"), labels_).first().asDict()
    every = fit_rows.unionByName(test)
    made.model = models.fit(best, every)
    made.segments = models.fit_segments(best, every) if segment and per_segment else {}
    run = {"candidate": won["name"], "cv_f1": won["f1_macro"], "holdout_f1": holdout["f1_macro"], "holdout_noise": placed.where("is_noise").count(), "k": choices.get("k", {}).get("k"), "k_low": min(ks), "k_high": max(ks), "eps": made.eps, "neighbours": k, "columns": columns, "segments": sorted(made.segments)}
    if segment:
        sizes = [r["n"] for r in fit_rows.groupBy("segment").agg(F.count("*").alias("n")).collect()]
        run |= {"n_segments": len(sizes), "smallest_segment": min(sizes)}
    manifest = {"run": run, "holdout": holdout, "choices": choices, "notes": {"list": models.integrity_notes(run | {"segments": run.get("n_segments", 99)})}, "verified": {"value": False}}
    if out:
        files.write_manifest(spark, manifest, f"{out}/manifest", force)
        save(made, out, force)
        made = load(spark, out)
        verify(made, rows.limit(1))
        manifest["verified"] = {"value": True}
        files.write_manifest(spark, manifest, f"{out}/manifest", True)
    return {"run": made, "model": made.model, "manifest": manifest, "results": results}


def save(run: Run, out: str, force: bool = False) -> None:
    """Imputer, scaler, cores and models, each a table or an MLlib model; existing ones are only replaced with force."""
    mode = "overwrite" if force else "error"
    for name in ("imputer", "scaler", "cores"):
        if getattr(run, name) is not None:
            getattr(run, name).write.mode(mode).parquet(f"{out}/{name}")
    models.save(run.model, f"{out}/model", force)
    for segment, model in run.segments.items():
        models.save(model, f"{out}/segment_{segment}", force)


def load(spark: SparkSession, out: str) -> Run:
    told = files.read_manifest(spark, f"{out}/manifest")["run"]
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    segments = {s: PipelineModel.load(f"{out}/segment_{s}") for s in told["segments"]}
    cores = read("cores") if told["eps"] is not None else None
    return Run(told["columns"], read("imputer"), read("scaler"), PipelineModel.load(f"{out}/model"), cores, told["eps"], told["neighbours"], segments)


def assign_segments(run: Run, rows: DataFrame) -> DataFrame:
    """Rows (user_id, columns with gaps, …) with gaps filled by the run's imputer, and segment and is_noise by its cores."""
    filled = written(prepare.impute(rows, run.imputer, run.columns, run.k), "filled")
    if run.cores is None:
        return filled.withColumns({"segment": F.lit(0), "is_noise": F.lit(False)})
    scaled = prepare.scale(filled, run.scaler, run.columns).select(F.col("user_id").alias("id"), F.array(*run.columns).alias("v"))
    got = cluster.assign(scaled, run.cores, run.eps).select(F.col("id").alias("user_id"), F.col("label").alias("segment"), "is_noise")
    return filled.join(got, "user_id")


def score(run: Run, rows: DataFrame, names: DataFrame | None = None, top: int = 3) -> DataFrame:
    """(user_id, segment, is_noise, top, confidence, tail, n_tail) of new rows (user_id, step2, step3, columns).

    Noise is scored and flagged. Rows of a segment with a model of its own take that one.
    """
    placed = written(_features(assign_segments(run, rows), run.columns, run.cores is not None).withColumnRenamed("user_id", "id"), "placed")
    out = None
    for segment, model in [(None, run.model), *run.segments.items()]:
        mine = placed.where(~F.col("segment").isin(*run.segments)) if segment is None and run.segments else placed if segment is None else placed.where(F.col("segment") == segment)
        pred, labels = models.predict(model, mine.select("id", "v"))
        ranked = models.rank_channels(pred, labels, names, top)
        out = ranked if out is None else out.unionByName(ranked)
    return placed.select("id", "segment", "is_noise").join(out, "id").withColumnRenamed("id", "user_id")


def verify(run: Run, rows: DataFrame) -> None:
    """Score known rows; each has channels with probabilities of 0 to 100."""
    got = score(run, rows).collect()
    if not got or any(not r.top or min(t["prob"] for t in r.top) < 0 or max(t["prob"] for t in r.top) > 100 + 1e-6 for r in got):
        raise ValueError("the reloaded run gives no valid probabilities")

"""Candidates, cross-validation, selection and scoring with MLlib. Rows carry (id, y, features)."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from journeyspark.functions import metrics
from journeyspark.functions.lineage import written
from journeyspark.operators import resample, splits

from .boosting import BoostedTrees


@dataclass
class Candidate:
    name: str
    make: object
    sampler: str | None = None
    probabilities: bool = True
    options: dict = field(default_factory=dict)

    @property
    def label(self) -> str:
        return self.name if self.sampler in (None, "none") else f"{self.name}+{self.sampler}"


def _ovr(make):
    return lambda k, n: OneVsRest(classifier=make())


# MLlib's linear SVC is binary: one against the rest, with normalised sigmoids as scores (`calibration` makes probabilities of them).
ROSTER = {
    "random_forest": Candidate("random_forest", lambda k, n: RandomForestClassifier(numTrees=60, maxDepth=8, minInstancesPerNode=2, seed=1)),
    "logistic": Candidate("logistic", lambda k, n: LogisticRegression(maxIter=60, regParam=0.001, family="multinomial", weightCol="weight")),
    "perceptron": Candidate("perceptron", lambda k, n: MultilayerPerceptronClassifier(layers=[n, 32, 16, k], maxIter=60, seed=1)),
    "naive_bayes": Candidate("naive_bayes", lambda k, n: NaiveBayes(modelType="gaussian")),
    "boosted_trees": Candidate("boosted_trees", lambda k, n: BoostedTrees(rounds=20, rate=0.3, weight="weight")),
    "linear_svc": Candidate("linear_svc", _ovr(lambda: LinearSVC(maxIter=30)), probabilities=False),
}


def variants(candidates, samplers=("none", "smote", "adasyn", "smote_tomek")) -> list[Candidate]:
    return [Candidate(c.name, c.make, s, c.probabilities) for c in candidates for s in samplers]


def _vectors(df: DataFrame) -> DataFrame:
    return df.select("id", "y", array_to_vector(F.col("v").cast("array<double>")).alias("features"), *[c for c in ("weight",) if c in df.columns])


def fit(candidate: Candidate, train: DataFrame) -> PipelineModel:
    """Fit on rows (id, y, v); only these are resampled and weighed."""
    train = resample.resampler(candidate.sampler)(train.select("id", "y", "v"))
    train = train.join(metrics.class_weights(train, "y").select("y", "weight"), "y")
    n = len(train.select("v").first()[0])
    k = train.select("y").distinct().count()
    index = StringIndexer(inputCol="y", outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc")
    return Pipeline(stages=[index, candidate.make(k, n)]).fit(_vectors(train))


def predict(model: PipelineModel, rows: DataFrame) -> tuple[DataFrame, list]:
    """(id, y_true, y_pred, probs) and the classes that probs follows; works on streams too."""
    labels = model.stages[0].labels
    out = model.transform(_vectors(rows if "y" in rows.columns else rows.withColumn("y", F.lit(None).cast("string"))))
    if "probability" in out.columns:
        probs = vector_to_array("probability")
    elif "rawPrediction" in out.columns:
        raw = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-x)))
        probs = F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))
    else:
        probs = F.lit(None).cast("array<double>")
    name = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    return out.select("id", F.col("y").cast("string").alias("y_true"), name.alias("y_pred"), F.slice(probs, 1, len(labels)).alias("probs")), labels


def unfit(e: Exception) -> bool:
    """Whether an error says that a candidate can't be fitted to these rows: a wrong argument or no convergence. All else (a lost executor, a full disk) ends the run."""
    if isinstance(e, (ValueError, TypeError, ArithmeticError, IllegalArgumentException, AnalysisException)):
        return True
    text = str(e)
    return not re.search(r"ExecutorLost|FetchFailed|OutOfMemory|No space left|SparkContext was shut down|cancelled", text) and bool(re.search(r"IllegalArgument|requirement failed|NotConverged|ArithmeticException", text))


def cross_validate(candidate: Candidate, rows: DataFrame, k: int = 3, seed: int = 1) -> list[dict]:
    """One result per fold: the measures, seconds, and an error instead of measures where the candidate can't be fitted. Training rows alone are resampled."""
    dealt = written(splits.folds(rows, "y", "id", k, seed), "folds")
    out = []
    for f in sorted(r[0] for r in dealt.select("fold").distinct().collect()):
        start = time.time()
        try:
            model = fit(candidate, dealt.where(F.col("fold") != f).drop("fold"))
            pred, labels = predict(model, dealt.where(F.col("fold") == f).drop("fold"))
            got = metrics.bundle(written(pred, "predictions"), labels if candidate.probabilities else None).first().asDict()
            error = None
        except Exception as e:
            if not unfit(e):
                raise
            got, error = {}, str(e)[:200]
        out.append({"name": candidate.label, "sampler": candidate.sampler or "none", "probabilities": candidate.probabilities, "fold": f, "seconds": time.time() - start, "error": error} | got)
    return out


def summary(results: list[dict]) -> list[dict]:
    """Mean and fold spread (population) of macro F1 for each candidate, in grid order."""
    out = []
    for name in dict.fromkeys(r["name"] for r in results):
        own = [r for r in results if r["name"] == name]
        f = [r["f1_macro"] for r in own if not r["error"]]
        mean = sum(f) / len(f) if f else float("-inf")
        out.append({"name": name, "sampler": own[0]["sampler"], "probabilities": own[0]["probabilities"], "f1_macro": mean, "spread": (sum((x - mean) ** 2 for x in f) / len(f)) ** 0.5 if f else 0.0, "failed": not f})
    return out


def choose(results: list[dict]) -> dict:
    """The best mean macro F1; within its spread the first candidate in grid order that doesn't resample. Only candidates with probabilities."""
    rows = [r for r in results if r["probabilities"] and not r["failed"]]
    if not rows:
        raise ValueError("no candidate with probabilities could be fitted")
    best = max(rows, key=lambda r: r["f1_macro"])
    plain = [r for r in rows if r["sampler"] == "none" and r["f1_macro"] >= best["f1_macro"] - best["spread"]]
    return plain[0] if plain else best


def save(model: PipelineModel, path: str, force: bool = False) -> PipelineModel:
    """Write a model and read it back; an existing one is only replaced with force."""
    writer = model.write()
    (writer.overwrite() if force else writer).save(path)
    return PipelineModel.load(path)


def verify(model: PipelineModel, row: DataFrame) -> DataFrame:
    """Score one known row; probabilities must be there and lie in 0..1."""
    pred, _ = predict(model, row)
    got = pred.collect()
    if not got or any(not r.probs or min(r.probs) < 0 or max(r.probs) > 1 + 1e-9 for r in got):
        raise ValueError("the reloaded model gives no valid probabilities")
    return pred


def rank_channels(scored: DataFrame, labels: list, names: DataFrame | None = None, top: int = 3) -> DataFrame:
    """(id, top: array of (code, name, prob in percent), confidence, tail, n_tail) from (id, probs)."""
    long = scored.select("id", F.posexplode("probs").alias("i", "p")).withColumn("code", F.element_at(F.array(*[F.lit(int(x)) for x in labels]), F.col("i") + 1))
    if names is not None:
        long = long.join(F.broadcast(names), "code", "left")  # the touchpoint dimension
    name = F.coalesce("name", F.concat(F.lit("Channel #"), F.col("code").cast("string"))) if names is not None else F.concat(F.lit("Channel #"), F.col("code").cast("string"))
    rn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("p"), "code"))
    best = long.withColumns({"rn": rn, "label": name}).groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("rn") <= top, F.struct("rn", "code", F.col("label").alias("name"), (100 * F.col("p")).alias("prob"))))).alias("t"),
        (100 * F.sum(F.when(F.col("rn") <= top, F.col("p")))).alias("confidence"), F.count_if(F.col("rn") > top).alias("n_tail"),
    )
    return best.select("id", F.transform("t", lambda x: F.struct(x["code"], x["name"], x["prob"])).alias("top"), "confidence", (100 - F.col("confidence")).alias("tail"), "n_tail")


def fit_segments(candidate: Candidate, rows: DataFrame, segment: str = "segment", least: int = 30) -> dict[int, PipelineModel]:
    """A model for each segment of at least `least` rows."""
    sizes = rows.groupBy(segment).count().where(F.col("count") >= least).orderBy(segment).collect()
    return {r[0]: fit(candidate, rows.where(F.col(segment) == r[0])) for r in sizes}


def integrity_notes(run: dict) -> list[str]:
    """What a reader of a run should know: few or thin segments, many imputed cells, k at the edge, a gap to the holdout."""
    notes = []
    if run.get("segments", 99) < 2:
        notes.append("fewer than two segments")
    if run.get("smallest_segment", 1e9) < 30:
        notes.append("a segment has fewer than 30 rows")
    if run.get("imputed_share", 0) > 0.2:
        notes.append("more than a fifth of the cells are imputed")
    if run.get("k") in (run.get("k_low"), run.get("k_high")) and run.get("k") is not None:
        notes.append("the number of segments lies at the edge of the range")
    if run.get("holdout_f1", 0) is None:
        notes.append("no held-out row lies in a segment")
    elif run.get("cv_f1", 0) - run.get("holdout_f1", 0) > 0.15:
        notes.append("cross-validation is better than the holdout by more than 0.15")
    return notes


def split_drift(recorded: dict[str, int], now: dict[str, int]) -> dict[str, tuple[int, int]]:
    """Parts whose recorded and present sizes differ."""
    return {k: (recorded.get(k, 0), now.get(k, 0)) for k in sorted({*recorded, *now}) if recorded.get(k, 0) != now.get(k, 0)}

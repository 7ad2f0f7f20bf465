"""Evaluation of (id, y_true, y_pred, probs): probs is an array, entry i for class labels[i]."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from journeyspark.functions.draws import uniform
from journeyspark.functions.order import place_in_class


def confusion(p: DataFrame) -> DataFrame:
    return p.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def class_report(p: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of every label that is true or predicted; zero divisions are 0."""
    cm = confusion(p)
    true = cm.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("hit"))
    pred = cm.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    both = true.join(pred, "label", "full").fillna(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    prec, rec = ratio(F.col("hit"), F.col("predicted")), ratio(F.col("hit"), F.col("support"))
    out = both.withColumns({"precision": prec, "recall": rec})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "precision", "recall", "f1", "support")


def macro(p: DataFrame) -> DataFrame:
    return class_report(p).agg(*[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")])


def weighted(p: DataFrame) -> DataFrame:
    return class_report(p).agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")])


def balanced_accuracy(p: DataFrame) -> DataFrame:
    return class_report(p).where("support > 0").agg(F.avg("recall").alias("balanced_accuracy"))


def accuracy(p: DataFrame) -> DataFrame:
    return p.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def full_report(p: DataFrame) -> DataFrame:
    """The class report with rows for accuracy, macro and weighted averages."""
    r = class_report(p).withColumn("label", F.col("label").cast("string"))
    n = F.sum("support")
    avg = r.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], n.alias("support"))
    wav = r.agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(c) * F.col("support")) / n).alias(c) for c in ("precision", "recall", "f1")], n.alias("support"))
    acc = p.agg(F.lit("accuracy").alias("label"), *[F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias(c) for c in ("precision", "recall", "f1")], F.count("*").alias("support"))
    return r.unionByName(acc).unionByName(avg).unionByName(wav)


def by_class(p: DataFrame, labels: list) -> DataFrame:
    """(id, y_true, label, prob): a row for each class."""
    return p.select("id", "y_true", F.posexplode("probs").alias("i", "prob")).withColumn("label", F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("i") + 1)).drop("i")


def top_k_hits(p: DataFrame, labels: list, k: int = 3) -> DataFrame:
    """Share of rows whose class is among the k likeliest (ties to the smaller class); 0 without probabilities."""
    return p.agg(F.coalesce(F.avg(_hit(labels, k)), F.lit(0.0)).alias("top_k"))


def _hit(labels: list, k: int):
    """1.0 where fewer than k classes come before the true one, by probability and then by label."""
    names = F.array(*[F.lit(x) for x in labels])
    at = F.array_position(names, F.col("y_true"))
    own = F.try_element_at("probs", F.greatest(at, F.lit(1)).cast("int"))
    ahead = F.filter(F.arrays_zip(F.col("probs").alias("p"), names.alias("l")), lambda c: (c["p"] > own) | ((c["p"] == own) & (c["l"] < F.col("y_true"))))
    return F.coalesce(((at > 0) & own.isNotNull() & (F.size(ahead) < min(k, len(labels)))).cast("double"), F.lit(0.0))


def _by_score(p: DataFrame, labels: list) -> DataFrame:
    """(label, prob, n, np, below, np_below, total, np_total): rows and true rows of each score, and of all lower scores of the label.

    Scores are summed in slices and then within them, so a label's scores are in many tasks.
    """
    rows = by_class(p, labels).withColumn("pos", (F.col("label") == F.col("y_true")).cast("int"))
    piece = F.floor(F.greatest(F.lit(-4.0), F.least(F.col("prob"), F.lit(4.0))) * 1024).alias("slice")
    ties = rows.groupBy("label", "prob").agg(F.count("*").alias("n"), F.sum("pos").alias("np")).select("*", piece)
    sums = ties.groupBy("label", "slice").agg(F.sum("n").alias("sn"), F.sum("np").alias("sp"))
    w, before = Window.partitionBy("label"), (Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    starts = sums.select("label", "slice", *[zero(F.sum(c).over(w.orderBy("slice").rowsBetween(*before))).alias(f"{c}0") for c in ("sn", "sp")], F.sum("sn").over(w).alias("total"), F.sum("sp").over(w).alias("np_total"))
    inside = Window.partitionBy("label", "slice").orderBy("prob").rowsBetween(*before)
    cut = ties.withColumns({"below": zero(F.sum("n").over(inside)), "np_below": zero(F.sum("np").over(inside))}).join(starts, ["label", "slice"])
    return cut.select("label", "prob", "n", "np", (F.col("below") + F.col("sn0")).alias("below"), (F.col("np_below") + F.col("sp0")).alias("np_below"), "total", "np_total")


def roc_auc(p: DataFrame, labels: list) -> DataFrame:
    """One against the rest, averaged over classes that have rows and counter-rows: Mann-Whitney with middle ranks."""
    rank = F.col("below") + (F.col("n") + 1) / 2
    auc = _by_score(p, labels).groupBy("label").agg(F.sum(rank * F.col("np")).alias("s"), F.sum("np").alias("p"), F.sum("n").alias("t")).where("p > 0 and p < t")
    return auc.agg(F.avg((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("t") - F.col("p")))).alias("roc_auc"))


def pr_auc(p: DataFrame, labels: list) -> DataFrame:
    """Average precision, averaged over classes that have rows; equal scores form one step."""
    tp, seen = F.col("np_total") - F.col("np_below"), F.col("total") - F.col("below")
    ap = _by_score(p, labels).where("np_total > 0").groupBy("label").agg(F.sum(F.col("np") / F.col("np_total") * tp / seen).alias("ap"))
    return ap.agg(F.avg("ap").alias("pr_auc"))


def bundle(p: DataFrame, labels: list | None = None) -> DataFrame:
    """All measures in one row; those of probabilities only with labels."""
    hits, n = F.sum(F.col("recall") * F.col("support")), F.sum("support")
    means = [F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")] + [(F.sum(F.col(c) * F.col("support")) / n).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")]
    out = class_report(p).agg((hits / n).alias("accuracy"), *means, F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))
    if not labels:
        return out
    rank, tp, seen = F.col("below") + (F.col("n") + 1) / 2, F.col("np_total") - F.col("np_below"), F.col("total") - F.col("below")
    per = _by_score(p, labels).groupBy("label").agg(F.sum(rank * F.col("np")).alias("s"), F.sum("np").alias("p"), F.sum("n").alias("t"), F.sum(F.when(F.col("np_total") > 0, F.col("np") / F.col("np_total") * tp / seen)).alias("ap"))
    area = (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("t") - F.col("p")))
    curves = per.agg(F.avg(F.when((F.col("p") > 0) & (F.col("p") < F.col("t")), area)).alias("roc_auc"), F.avg("ap").alias("pr_auc"))
    return out.crossJoin(top_k_hits(p, labels)).crossJoin(curves)  # one row each


def top_confusions(p: DataFrame, n: int = 20) -> DataFrame:
    return confusion(p).where("y_true <> y_pred").orderBy(F.desc("n"), "y_true", "y_pred").limit(n)


# Right-closed bands.
BANDS = {"seq_len": (0, 5, 15, 40, 100, None), "age": (0, 30, 45, 60, 120), "n_sessions": (0, 1, 3, 8, None)}


def band(column: str, edges):
    c, out = F.col(column), None
    for lo, hi in zip(edges, edges[1:]):
        name = f"({lo}, {'inf' if hi is None else hi}]"
        cond = (c > lo) if hi is None else (c > lo) & (c <= hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def banded_accuracy(p: DataFrame, column: str, edges=None) -> DataFrame:
    """(band, n, accuracy); values outside all bands are left out."""
    b = p.withColumn("band", band(column, edges or BANDS[column])).where("band is not null")
    return b.groupBy("band").agg(F.count("*").alias("n"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def grouped_accuracy(p: DataFrame, column: str) -> DataFrame:
    return p.groupBy(column).agg(F.count("*").alias("n"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def error_profile(p: DataFrame, columns) -> DataFrame:
    return p.withColumn("correct", (F.col("y_true") == F.col("y_pred")).cast("int")).groupBy("correct").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """(y, n, weight): n / (classes * count), brought to a mean of 1."""
    n = df.groupBy(y).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    raw = F.sum("n").over(every) / (F.count("*").over(every) * F.greatest(F.col("n"), F.lit(1)))
    return n.withColumn("raw", raw).withColumn("weight", F.col("raw") / F.avg("raw").over(every)).drop("raw")


def majority_baseline(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    """Test rows (id, y_true) with the most frequent class of train as y_pred, ties to the smaller."""
    top = train.groupBy(y).count().orderBy(F.desc("count"), y).limit(1).select(F.col(y).alias("y_pred"))
    return test.crossJoin(F.broadcast(top))  # one row


def permutation_importance(data: DataFrame, score, blocks: dict[str, list[str]], id_: str, repeats: int = 3, seed: int = 1) -> DataFrame:
    """(block, mean, std): how far score(data) (a number) falls when a block's columns are dealt out anew, together, over the rows.

    Two numberings of the rows, one by id hash and one by another hash for each repeat, are joined: no driver pass over rows.
    """
    spark, base, rows = data.sparkSession, score(data), []
    for block, columns in blocks.items():
        falls = []
        for r in range(repeats):
            n1 = place_in_class(data, None, uniform(seed, F.col(id_), f"keep-{r}"), id_).drop("_n")
            n2 = place_in_class(data.select(id_, *columns), None, uniform(seed, F.col(id_), f"{block}-{r}"), id_).select("_rn", *columns)
            falls.append(base - score(n1.drop(*columns).join(n2, "_rn").drop("_rn")))
        mean = sum(falls) / repeats
        rows.append((block, float(mean), float((sum((f - mean) ** 2 for f in falls) / repeats) ** 0.5)))
    return spark.createDataFrame(rows, "block string, mean double, std double")


def grouped_importance(importance: DataFrame, groups: dict[str, str], other: str = "behavioural") -> DataFrame:
    """Importances summed by feature group; features in no group count as `other`."""
    pairs = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    return importance.groupBy(F.coalesce(F.try_element_at(pairs, F.col("block")), F.lit(other)).alias("group")).agg(F.sum("mean").alias("importance"))

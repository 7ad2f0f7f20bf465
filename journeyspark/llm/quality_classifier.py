"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader.

A text is cut into lower-case word and punctuation tokens; unigrams and bigrams are hashed to 2^bits
features, and so is every trigram that the text holds already (as one feature, whatever its words); each is
weighted by its share of the text's tokens. FTRL-proximal (per-coordinate rates, L1 and L2)
visits the training documents one at a time; a score is the sigmoid of one sparse dot product.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, bucket_of, mix64, shipped, sigmoid, table

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Shares of tokens are small; this brings the features of a text to a useful size.
SCALE = 30.0
#: Stands for any trigram that came before in the same text.
AGAIN = np.uint64(0xA5A5A5A5)


def hashed(text: str | None, bits: int) -> np.ndarray:
    """The feature of every unigram, bigram and repeated trigram of the whole text, repeats kept."""
    tokens = TOKEN.findall(text.lower()) if text else []
    if not tokens:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(zlib.crc32, [t.encode("utf-8", "surrogatepass") for t in tokens]), np.uint64, len(tokens))
    two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:]
    again = np.full(len(three) - len(np.unique(three)), AGAIN, np.uint64)
    return (np.concatenate([h, two, again]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


class FtrlModel:
    """Weights of 2^bits features and a bias, with the FTRL-proximal state that they follow from."""

    def __init__(self, bits: int = 18, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0
        self.weights, self.bias = np.zeros(1 << bits, np.float32), 0.0

    def _at(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, i: np.ndarray, x: np.ndarray, y: int, weight: float = 1.0) -> None:
        w, b = self._at(i), -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha + self.l2)
        g = weight * (sigmoid(w @ x + b) - y)
        step = g * x
        self.z[i] += step - (np.sqrt(self.n[i] + step * step) - np.sqrt(self.n[i])) / self.alpha * w
        self.n[i] += step * step
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += g * g

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 3) -> "FtrlModel":
        for _ in range(epochs):
            for i, x, y in rows:
                self.update(i, x, y)
        every = np.arange(1 << self.bits)
        self.weights, self.bias = self._at(every).astype(np.float32), float(-self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha + self.l2))
        self.z = self.n = None
        return self

    def score(self, text: str | None) -> float:
        at = hashed(text, self.bits)
        return float(sigmoid(self.bias + (SCALE * 2.0 * float(self.weights[at].mean()) if len(at) else 0.0)))


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_docs: int = 6000, max_features: int = 20_000, bits: int = 18, epochs: int = 3) -> FtrlModel:
    """Learn `label` (0 or 1) from at most `max_docs` labelled documents, chosen by a hash of their ids.

    Tasks hash the sampled texts; the driver gets the sparse rows, at most `max_features` features of a training
    document (those with the least hashes, of a longer one), and runs the updates in order of the ids' hash.
    Ids may be of any type; an id with several labels has the least of them. Without labels the model scores every text 0.5.
    """
    marks = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.lit(0).alias("_y"), F.col(label).alias("_label"))
    known = bounded_sample(docs, marks, max_docs, text, doc_id, "ftrl")

    def rows(batches):
        for b in batches:
            out = []
            for t in b["_text"].to_pylist():
                at, n = np.unique(hashed(t, bits), return_counts=True)
                x = n * (SCALE * 2.0 / max(1, n.sum()))
                few = np.argsort(mix64(at.astype(np.uint64)))[:max_features] if len(at) > max_features else slice(None)
                out.append((at[few].tolist(), x[few].tolist()))
            yield pa.RecordBatch.from_pydict({"i": pa.array([i for i, _ in out], pa.list_(pa.int32())), "x": pa.array([x for _, x in out], pa.list_(pa.float32())), "y": b["_label"].cast(pa.int32()), "h": b["_h"]})

    got = known.withColumn("_h", F.xxhash64("_id")).mapInArrow(rows, "i array<int>, x array<float>, y int, h bigint").orderBy("h").toArrow()
    data = [(i.values.to_numpy().astype(np.int64), x.values.to_numpy().astype(float), y) for i, x, y in zip(got["i"], got["x"], got["y"].to_pylist(), strict=True)]
    return FtrlModel(bits).fit(data, epochs)


def quality_score(docs: DataFrame, model: FtrlModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add score (double, 0 to 1) and predicted (int: 1 if score >= threshold) to every document.

    Incoming columns of these names are replaced; all others stay. Null and empty texts score by the bias alone.
    The weights (2^bits floats) go to the tasks as one broadcast of fixed size.
    """
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")])
    held = shipped(docs.sparkSession, model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields), "score double", "predicted int"])
    names = [*src.columns, "score", "predicted"]
    at = names.index(text)

    def scored(batches):
        m = held()
        for b in batches:
            s = np.array([m.score(t) for t in b.column(at).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=names)

    return src.mapInArrow(scored, schema)


def op9_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit_quality(docs.where(~held_out), table(spark, sf_dir, "labels"))
    return quality_score(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")

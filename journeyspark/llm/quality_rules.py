"""Quality rules: counts over whole texts, and a linear-chain CRF that labels lines.

Each line that holds a word is *content* or *boilerplate*. A conditional random field over the lines of a
document (features of the line, and of which label follows which) is fitted in numpy by gradient ascent on
its exact log-likelihood; Viterbi decoding labels the lines, and the share of words in content lines decides
whether the document stays.

The tables label documents, not lines, so line labels are latent. At first a training document lends its label to its
lines. Training sequences are runs of lines of one document, and runs spliced from documents of both labels, from which
the field learns how labels change inside a text. The fitted field then labels the training lines anew; a document
keeps its new line labels where their content share agrees with the document's label, and the field is fitted again.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, sliced, table, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
N_FEATURES = 12


def line_features(words: list[str], line: str, repeated: bool) -> tuple[float, ...]:
    """Twelve numbers of about 0 to 1: what a line looks like, whatever its language."""
    n = len(words)
    joined = "".join(words)
    letters = sum(map(str.isalpha, joined))
    symbols = sum(map(line.count, SYMBOLS))
    marks = line.count("!") + line.count("?")
    upper = 1.0 if joined.isupper() else 0.0
    distinct = len(set(words)) / n
    return (
        1.0, min(1.0, 4.0 * symbols / n), min(1.0, 2.0 * marks / n), upper, 1.0 - letters / max(1, len(joined)),
        1.0 - distinct if n > 3 else 0.0, float(repeated), min(1.0, n / 50.0), min(1.0, len(joined) / n / 12.0),
        float(joined[-1] in ".!?:;\"'"), min(1.0, line.count(" | ") / n * 2.0), float(not joined[:1].isupper()),
    )


def measure(text: str | None) -> tuple[tuple[int, int, int, int, int], list[tuple[float, ...]], list[int]]:
    """The five counts of a text, and the features and word counts of its lines."""
    text = text or ""
    seen: set[str] = set()
    feats, sizes, dups = [], [], 0
    every: list[str] = []
    for line in text.split("\n"):
        words = split_words(line)
        if words:
            old = line in seen
            seen.add(line)
            dups += old
            feats.append(line_features(words, line, old))
            sizes.append(len(words))
            every += words
    n = len(every)
    windows = list(zip(every, every[1:], every[2:], every[3:], every[4:]))
    repeat = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        reach = 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeat += i + 5 - max(i, reach)
                reach = i + 5
    chars = sum(map(len, every))
    return (n, chars, sum(map(text.count, SYMBOLS)), dups, repeat), feats, sizes


def split_words(line: str) -> list[str]:
    """Words between ASCII white space; str.split() alone would also cut at other Unicode spaces."""
    return line.split() if line.isascii() and not _INFO.intersection(line) else [w.decode("utf-8", "surrogatepass") for w in line.encode("utf-8", "surrogatepass").split()]


_INFO = frozenset("\x1c\x1d\x1e\x1f")


class LineCrf:
    """Two labels: 0 boilerplate, 1 content. emit: (2, features); move: (2, 2), from row to column."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((2, N_FEATURES)) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move

    def fit(self, runs: list[tuple[np.ndarray, np.ndarray, float]], steps: int = 120, rate: float = 0.15, l2: float = 1e-3) -> "LineCrf":
        """Gradient ascent (Adam) on the log-likelihood of runs (features of the lines, their labels, weight), all at once."""
        if len({int(y) for _, labels, _ in runs for y in labels}) < 2:
            return self
        total = sum(w for _, _, w in runs)
        groups: dict[int, list] = {}
        for run in runs:  # runs of about the same length are padded together
            groups.setdefault(-(-len(run[0]) // 8), []).append(run)
        lots = [_padded(own, total) for own in groups.values()]
        want_emit = sum(np.stack([np.einsum("nt,ntf->f", weight * (gold == k), x) for k in (0, 1)]) for x, gold, weight in lots)
        pairs = lambda gold, weight, j, k: (weight[:, 1:] * (gold[:, :-1] == j) * (gold[:, 1:] == k)).sum()
        want_move = np.array([[sum(pairs(gold, weight, j, k) for _, gold, weight in lots) for k in (0, 1)] for j in (0, 1)])
        m = [np.zeros_like(self.emit), np.zeros_like(self.move)]
        v = [np.zeros_like(self.emit), np.zeros_like(self.move)]
        for step in range(1, steps + 1):
            got = [self._expected(x, weight) for x, _, weight in lots]
            grads = [want_emit - sum(e for e, _ in got) - l2 * self.emit, want_move - sum(p for _, p in got) - l2 * self.move]
            for j, (param, g) in enumerate(zip((self.emit, self.move), grads, strict=True)):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.99 * v[j] + 0.01 * g * g
                param += rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
        return self

    def _expected(self, x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected feature sums by label and label pairs, from forward and backward sums that are scaled to one at each line."""
        score = x @ self.emit.T
        emit, move, on = np.exp(score - score.max(2, keepdims=True)), np.exp(self.move - self.move.max()), weight > 0
        fwd, bwd, scale = np.empty_like(emit), np.ones_like(emit), np.ones((*weight.shape, 1))
        fwd[:, 0] = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
        for i in range(1, x.shape[1]):
            new = (fwd[:, i - 1] @ move) * emit[:, i]
            scale[:, i] = new.sum(1, keepdims=True)
            fwd[:, i] = new / scale[:, i]
        for i in range(x.shape[1] - 2, -1, -1):
            bwd[:, i] = np.where(on[:, i + 1, None], (emit[:, i + 1] * bwd[:, i + 1]) @ move.T / scale[:, i + 1], 1.0)
        p = fwd * bwd * weight[..., None]
        ahead = (emit * bwd / scale * weight[..., None])[:, 1:]
        return p.reshape(-1, 2).T @ x.reshape(-1, x.shape[2]), move * (fwd[:, :-1].reshape(-1, 2).T @ ahead.reshape(-1, 2))

    def decode(self, feats: np.ndarray) -> list[int]:
        """The likeliest labels of a document's lines (Viterbi); ties go to content."""
        score = (feats @ self.emit.T).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = score[0]
        back = []
        for s0, s1 in score[1:]:
            stay0, come0, come1, stay1 = a + m00, b + m10, a + m01, b + m11
            back.append((1 if come0 >= stay0 else 0, 1 if stay1 >= come1 else 0))
            a, b = max(stay0, come0) + s0, max(come1, stay1) + s1
        out = [1 if b >= a else 0]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def _padded(runs: list[tuple[np.ndarray, np.ndarray, float]], total: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (n, t, features), labels and weights of the lines (n, t); weights beyond a run's end are 0."""
    n, t = len(runs), max(len(d) for d, _, _ in runs)
    x, gold, weight = np.zeros((n, t, N_FEATURES)), np.zeros((n, t), int), np.zeros((n, t))
    for i, (d, y, w) in enumerate(runs):
        x[i, : len(d)], gold[i, : len(d)], weight[i, : len(d)] = d, y, w / len(d) / total
    return x, gold, weight


def spliced(content: list, junk: list, n: int, longest: int, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """n runs made of two or three pieces, in turn from runs (features, labels) of either list."""
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        parts = []
        for j in range(2 + i % 2):
            own = (content, junk)[(i // 2 + j) % 2]
            x, y = own[rng.integers(len(own))]
            m = int(rng.integers(1, min(len(x), longest // 3) + 1))
            lo = int(rng.integers(0, len(x) - m + 1))
            parts.append((x[lo : lo + m], y[lo : lo + m]))
        out.append((np.concatenate([p for p, _ in parts]), np.concatenate([q for _, q in parts])))
    return out


def train_field(runs: list[tuple[np.ndarray, np.ndarray, int]], longest: int = 64, rounds: int = 2, least: float = 0.5) -> LineCrf:
    """The field for runs (features, words per line, the document's label): labels lent at first, then found anew within what the document's label allows."""
    model = LineCrf()
    if len({y for _, _, y in runs}) < 2:
        return model
    labels = [np.full(len(x), y) for x, _, y in runs]
    for turn in range(rounds):
        if turn:
            for i, (x, n, y) in enumerate(runs):
                found = np.array(model.decode(x))
                if (n @ found >= least * n.sum()) == (y == 1):
                    labels[i] = found
        kinds = [[(x, own) for (x, _, z), own in zip(runs, labels, strict=True) if z == y] for y in (0, 1)]
        mixed = spliced(kinds[1], kinds[0], len(runs) // 2, longest)
        # The three kinds of sequences have the same weight in all.
        model = LineCrf().fit([(x, y, 1.0 / len(own)) for own in (*kinds, mixed) for x, y in own])
    return model


def fit_lines(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", max_docs: int = 4000, longest: int = 64) -> LineCrf:
    """Fit on at most `max_docs` runs of up to `longest` lines from as many labelled documents, half of each quality.

    Tasks turn the sampled texts into line features; the driver gets those numbers only, whatever the texts' lengths:
    of the runs of a longer text each may be chosen. Without documents of both kinds, no line is boilerplate.
    An id with several labels has the least of them, and null ids and labels teach nothing.
    """
    marks = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
    few = bounded_sample(docs, marks, max_docs // 2, text, doc_id, "lines").select(F.xxhash64("_id").alias("_h"), "_y", "_text")

    def numbers(batches):
        for b in batches:
            out = []
            for h, y, t in zip(b["_h"].to_pylist(), b["_y"].to_pylist(), b["_text"].to_pylist(), strict=True):
                _, feats, sizes = measure(t)
                out += [(h, i, y, np.array(feats[i : i + longest], np.float32).ravel().tolist(), sizes[i : i + longest]) for i in range(0, len(feats), longest)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["h", "i", "y", "f", "n"])

    runs = few.mapInArrow(numbers, "h bigint, i int, y int, f array<float>, n array<int>")
    runs = written(runs, "line-runs")
    few = [runs.where(F.col("y") == y).orderBy(F.xxhash64("h", "i"), "h", "i").limit(max_docs // 2) for y in (0, 1)]
    got = [r for lot in few for r in lot.collect()]
    return train_field([(np.array(r.f, float).reshape(-1, N_FEATURES), np.array(r.n), r.y) for r in got], longest)


def quality_rules(docs: DataFrame, model: LineCrf, text: str = "text", min_words: int = 10, max_repeat_percent: int = 20, min_content: float = 0.5) -> DataFrame:
    """Add the counts and the verdict to every document, keeping all its columns.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed (boolean),
    content_share (double: share of the words in lines labelled content) and kept (boolean). Columns of the
    same names that come in are replaced. Null and empty texts have no words: they fail the base rules, with a
    content share of 0. Repeated rows get the same result each; nothing depends on other rows.
    """
    kept_in = [c for c in docs.columns if c not in _ADDED]
    src = docs.select(*[F.col(f"`{c}`") for c in kept_in])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields), *(f"{c} {t}" for c, t in _ADDED.items())])

    def judge(batches):
        for b in sliced(batches):
            counts, shares = [], []
            for t in b.column(kept_in.index(text)).to_pylist():
                got, feats, sizes = measure(t)
                labels = model.decode(np.array(feats)) if feats else []
                counts.append(got)
                shares.append(sum(n for n, y in zip(sizes, labels, strict=True) if y) / got[0] if got[0] else 0.0)
            c = np.array(counts, np.int64).reshape(-1, 5)
            failed = (c[:, 0] < min_words) | (100 * c[:, 4] > max_repeat_percent * c[:, 0])
            share = np.array(shares, float)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c[:, i]) for i in range(5)), pa.array(failed), pa.array(share), pa.array(~failed & (share >= min_content))], names=[*kept_in, *_ADDED])

    return src.mapInArrow(judge, schema)


_ADDED = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "content_share": "double", "kept": "boolean"}


def op7_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_lines(docs, table(spark, sf_dir, "labels"))
    out = quality_rules(docs, model)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept")

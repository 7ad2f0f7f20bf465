"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency in each language. An unseen word falls back to
its character n-grams (with marks for the word's ends): to the longest length of which the model knows at
least one, and to shorter ones otherwise. A text's score is the sum over its words.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, bucket_of, shipped, table, written

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 4


def language_words(text: str | None) -> list[str]:
    """Lower-case runs of letters of the whole text; runs without any letter proper are left out."""
    found = LETTERS.findall(text.lower()) if text else []
    return found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    marked = f"\x02{word}\x03"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


#: Added to every count.
SMOOTH = 0.1
#: Up to so many numbers, a kind's log frequencies are one matrix; beyond, rows are put together when they are asked for.
MATRIX = 20_000_000


class Counts:
    """Log frequencies of the parts of one kind in each language, from the counts of the languages that have each."""

    def __init__(self, parts: dict[str, dict[int, int]], n_langs: int):
        self.index = {x: i for i, x in enumerate(parts)}
        self.starts = np.cumsum([0, *map(len, parts.values())])
        self.langs = np.array([k for own in parts.values() for k in own], np.int32)
        counts = np.array([n for own in parts.values() for n in own.values()], float)
        totals = np.bincount(self.langs, counts, n_langs) + SMOOTH * max(1, len(parts))
        self.floor = np.log(SMOOTH / totals)
        self.above = np.log((counts + SMOOTH) / SMOOTH)
        self.matrix = self._built(range(len(parts))) if len(parts) * n_langs <= MATRIX else None

    def _built(self, at) -> np.ndarray:
        out = np.tile(self.floor, (len(at), 1))
        for row, i in zip(out, at, strict=True):
            lo, hi = self.starts[i], self.starts[i + 1]
            row[self.langs[lo:hi]] += self.above[lo:hi]
        return out

    def rows(self, at: list[int]) -> np.ndarray:
        return self._built(at) if self.matrix is None else self.matrix[at]


class BackoffModel:
    """langs, and the counts of known words and of known n-grams of each length. Rows of words are found once and kept, up to `kept` numbers."""

    def __init__(self, langs: list[str], words: dict[str, dict[int, int]], parts: list[dict[str, dict[int, int]]], kept: int = 4_000_000):
        self.langs, self.kinds = langs, [Counts(x, len(langs)) for x in (words, *parts)]
        self.most = max(1000, kept // max(1, len(langs)))
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(langs)))

    def known(self, word: str) -> tuple[int, list[int]]:
        """The kind that speaks for a word (0: the word itself; else the longest n-grams of which one is known), and its parts."""
        if (i := self.kinds[0].index.get(word)) is not None:
            return 0, [i]
        for n in range(len(self.kinds) - 1, 0, -1):
            index = self.kinds[n].index
            if found := [i for g in grams(word, n) if (i := index.get(g)) is not None]:
                return n, found
        return 0, []

    def learn(self, words: list[str]) -> None:
        """Rows for new words: means over their known parts, all words of a kind at once."""
        lo = len(self.at)
        while lo + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[lo : lo + len(words)] = 0.0
        flat: list[list[int]] = [[] for _ in self.kinds]
        sizes: list[list[int]] = [[] for _ in self.kinds]
        who: list[list[int]] = [[] for _ in self.kinds]
        for i, w in enumerate(words, lo):
            self.at[w] = i
            kind, found = self.known(w)
            if found:
                flat[kind] += found
                sizes[kind].append(len(found))
                who[kind].append(i)
        for counts, at, n, rows in zip(self.kinds, flat, sizes, who, strict=True):
            if at:
                n = np.array(n)
                self.rows[rows] = np.add.reduceat(counts.rows(at), np.cumsum(n) - n, axis=0) / n[:, None]

    def totals(self, counts: Counter) -> np.ndarray:
        words, times, total = list(counts), np.fromiter(counts.values(), float, len(counts)), np.zeros(len(self.langs))
        for lo in range(0, len(words), self.most):
            some = words[lo : lo + self.most]
            if len(self.at) + len(some) > self.most:  # only speed depends on what is kept
                self.at = {}
            if new := [w for w in some if w not in self.at]:
                self.learn(new)
            total += times[lo : lo + self.most] @ self.rows[list(map(self.at.__getitem__, some))]
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(language_words(text))
        if not counts or not self.langs:
            return "und", 0.0
        total = self.totals(counts)
        best = int(total.argmax())
        return self.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", docs_per_lang: int = 600, max_words: int = 30_000) -> BackoffModel:
    """Count words and n-grams of at most `docs_per_lang` documents of each language, chosen by a hash of their ids.

    Spark counts; the driver gets the `max_words` most frequent words (found at least twice) and as many n-grams
    of each length at most, each with the counts of the languages that have it. Languages may be of any number. An id
    with several languages or texts counts once; null ids and languages teach nothing.
    """
    base = docs.where(F.col(lang).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(lang).alias("_y"))
    few = bounded_sample(docs, base, docs_per_lang, text, doc_id, "lang")

    def counted(batches):
        for b in batches:
            words: dict[str, Counter] = {}
            for t, x in zip(b["_text"].to_pylist(), b["_y"].to_pylist(), strict=True):
                words.setdefault(x, Counter()).update(language_words(t))
            found: Counter = Counter()
            for x, own in words.items():
                for w, n in own.items():
                    found[x, 0, w] += n
                    for k in range(1, LONGEST + 1):
                        for g in grams(w, k):
                            found[x, k, g] += n
            keys = list(found)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.string()), "kind": pa.array([k[1] for k in keys], pa.int32()), "part": pa.array([k[2] for k in keys], pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    each = written(few.mapInArrow(counted, "lang string, kind int, part string, n bigint").groupBy("kind", "part", "lang").agg(F.sum("n").alias("n")), "language-counts")
    langs = [r[0] for r in each.where("kind = 0").select("lang").distinct().orderBy("lang").collect()]
    places = {x: i for i, x in enumerate(langs)}
    sums = written(each.groupBy("kind", "part").agg(F.sum("n").alias("all")).where("all > 1"), "language-parts")
    top = reduce(DataFrame.unionByName, [sums.where(F.col("kind") == k).orderBy(F.desc("all"), "part").limit(max_words) for k in range(LONGEST + 1)])
    tables: list[dict] = [{} for _ in range(LONGEST + 1)]
    for r in each.join(top, ["kind", "part"]).orderBy("kind", F.desc("all"), "part", "lang").select("kind", "part", "lang", "n").collect():
        tables[r["kind"]].setdefault(r["part"], {})[places[r["lang"]]] = r["n"]
    return BackoffModel(langs, tables[0], tables[1:])


def identify_language(docs: DataFrame, model: BackoffModel, text: str = "text") -> DataFrame:
    """Add lang_pred (string) and score (double: the posterior of lang_pred) to every document.

    Texts that are null, empty or without a letter get `und` with score 0, as do all texts when the model has
    no language. Equal scores go to the language that sorts first. Incoming columns of these names are replaced.
    """
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    held = shipped(docs.sparkSession, model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields), "lang_pred string", "score double"])
    names = [*src.columns, "lang_pred", "score"]
    at = names.index(text)

    def named(batches):
        m = held()
        for b in batches:
            got = [m.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=names)

    return src.mapInArrow(named, schema)


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit_languages(docs.where(~held_out).select("doc_id", "text", "lang"))
    return identify_language(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")

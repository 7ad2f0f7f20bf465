"""The pipeline: every stage against a brute-force version, and on nulls, empty, long and repeated rows, extra columns and empty tables."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from journeyspark.llm import mixing, quality_rules, sentencepiece
from journeyspark.llm.common import table

from test_operators import SMALL, _all_pairs, _targets

STAGES = dict(corpus_pipeline.STAGES)
LONG = "\n".join(f"verse {i} the quick brown fox jumps over a lazy dog near the bank of river {i}" for i in range(3000))
EXTRA = ("h", "id", "n", "key", "print", "row", "_h", "_gone", "size", "places", "kept", "n_removed", "component_id", "in0", "_shard")


@pytest.fixture(scope="module")
def chain(spark):
    """What goes into each stage, and what comes out of the last."""
    docs, seen = table(spark, SMALL, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs.collect()
        out = stage(spark, docs, SMALL)
        assert name == "sentencepiece" or out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    seen["end"] = docs.collect()
    assert all(seen.values())
    return seen


def test_rules(spark, chain):
    model = quality_rules.fit_lines(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    keep = []
    for r in chain["quality_rules"]:
        (n, _, _, _, repeat), feats, sizes = quality_rules.measure(r.text)
        share = sum(s for s, y in zip(sizes, model.decode(np.array(feats))) if y) / n if n else 0.0
        if n >= 10 and 100 * repeat <= 20 * n and share >= 0.5:
            keep.append(r)
    assert sorted(keep) == sorted(chain["line_dedup"])


def test_lines(chain):
    docs = sorted((r.doc_id, r.text) for r in chain["line_dedup"])
    left = _all_pairs(docs)
    want = {i: left[i] for i, t in docs if left[i] == t or left[i].strip()}
    assert {r.doc_id: r.text for r in chain["ngram_jaccard_join"]} == want
    assert all(r.n_chars == len(r.text) for r in chain["ngram_jaccard_join"])


def test_near_duplicates(chain):
    sets = {}
    for r in chain["ngram_jaccard_join"]:
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    first = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            old, new = max(first[a], first[b]), min(first[a], first[b])
            first = {i: new if c == old else c for i, c in first.items()}
    assert sorted(r.doc_id for r in chain["source_mix"]) == sorted(i for i, c in first.items() if i == c)


def test_mixture(spark, chain):
    size, taken, rows = defaultdict(int), defaultdict(int), {}
    for r in chain["source_mix"]:
        size[r.source] += len(r.text.encode().split())
        rows[r.doc_id] = r
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, _targets(spark, [size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    for r in chain["sentencepiece"]:
        assert rows[r.doc_id] == r
        taken[r.source] += len(r.text.encode().split())
    longest = max(len(r.text.encode().split()) for r in rows.values())
    assert max(Counter(r.doc_id for r in chain["sentencepiece"]).values()) <= 3
    assert all(target[s] - longest <= taken[s] <= target[s] + 1e-6 for s in order)


def test_tokens(chain):
    model = sentencepiece.PieceModel(sentencepiece.read_pieces(corpus_pipeline.PIECES))
    texts = {r.doc_id: r.text for r in chain["sentencepiece"]}
    assert Counter(r.doc_id for r in chain["end"]) == Counter(r.doc_id for r in chain["sentencepiece"])
    for r in chain["end"]:
        assert r.round_trip and r.n_tokens == len(r.token_ids) and model.decode(r.token_ids) == texts[r.doc_id]


def edge_rows(spark):
    same, other = "some words that are here ten times or more in every single copy of it", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    data = [
        (1, same, "en", "a", 70), (1, same, "en", "a", 70), (2, same, "de", None, 70), (None, same, "en", "b", 70), (None, same, "en", "b", 70),
        (None, other, None, None, None), (None, other, None, "c", None), (3, None, "en", "a", None), (4, "", "en", "a", 0), (5, " \n\t", "en", "b", 3), (6, LONG, "fr", "c", len(LONG)),
        (7, LONG.replace("verse 9 the", "verse nine the"), "fr", "c", len(LONG)), (8, "é 漢字 😀 \x1d one two three four five six seven eight nine", None, "", 50), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars int")
    return df.withColumns({c: F.lit("kept" if i % 2 else i) for i, c in enumerate(EXTRA)})


@pytest.mark.parametrize("name", STAGES)
def test_edges(spark, name):
    docs = edge_rows(spark)
    out = STAGES[name](spark, docs, SMALL)
    got = [r.asDict() for r in out.collect()]
    ids = Counter((r["doc_id"], r["text"]) if "text" in r else r["doc_id"] for r in got)
    if name == "sentencepiece":
        assert len(got) == docs.count() and all(r["round_trip"] for r in got)
        return
    assert out.schema.names == docs.schema.names and out.dtypes == docs.dtypes
    assert all(r[c] == ("kept" if i % 2 else i) for r in got for i, c in enumerate(EXTRA))
    whole = Counter((r.doc_id, r.text) for r in docs.collect())
    if name == "quality_rules":
        assert not any(t is None or not t.strip() for _, t in ids) and all(whole[k] == n for k, n in ids.items())
    elif name == "line_dedup":
        assert not any(i == 2 for i, _ in ids) and all(ids[k] == n for k, n in whole.items() if k[0] in (None, 1, 3, 4, 5, 6, 8))
        (seven,) = [t for i, t in ids if i == 7]
        assert seven.startswith("verse nine the") and "\n" not in seven
    elif name == "ngram_jaccard_join":
        assert {k for k in ids if k[1] and k[1].startswith(("some", "verse", "alpha"))} == {(1, edge_rows(spark).first().text), (6, LONG), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")}
        assert set(ids.values()) == {1} and {i for i, _ in ids} == {1, 3, 4, 5, 6, 8, None}
    else:
        assert set(ids) <= set(whole) and max(n / whole[k] for k, n in ids.items() if k[1]) <= 3


@pytest.mark.parametrize("name", STAGES)
def test_empty_table(spark, name):
    assert STAGES[name](spark, edge_rows(spark).where("false"), SMALL).count() == 0


def test_mixing_shards_are_task_sized(spark):
    mixed = mixing.mix(edge_rows(spark), shard_words=500)
    assert mixed.schema["places"].metadata["shards"] > 100
    assert mixing.mixed_documents(mixed, ["doc_id"]).rdd.getNumPartitions() == mixed.schema["places"].metadata["shards"]

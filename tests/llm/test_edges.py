"""Every operator on nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from journeyspark.llm import jaccard_join, language_id, line_dedup, mixing, pii, quality_classifier, quality_rules, sentencepiece, sharding, topk_search

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
CLASHES = ("size", "places", "target", "source_size", "shard", "shard_depth", "shard_bytes", "n_bytes", "base", "spans", "lang_pred", "score", "token_ids", "n_tokens", "round_trip", "n_words", "kept", "content_share", "n_lines", "n_removed", "predicted", "_h", "_k", "h", "id", "n", "t", "fp", "node", "v", "key", "gone", "_gone", "_id", "_y", "_text", "hub", "tile")
LONG = "the quick brown fox jumps over the lazy dog near a river bank \n" * 4000 + "1.2.3.4"


def rows(spark):
    data = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a"), (1, "one two three four five six seven eight nine ten eleven", "en", "a"),
        (2, None, "en", None), (3, "", None, "b"), (4, " \n\t ", "fr", "b"), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a"),
        (5, LONG, "en", "c"), (6, "one two three four five six seven eight nine ten eleven", None, None), (7, "éàü ▁x \x1d y 漢字 😀", "fr", ""), (None, None, None, None),
    ]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string")
    return df.withColumns({c: F.lit("kept" if c.startswith("_") else 1) for c in CLASHES})


OPS = {
    "mix": lambda d: mixing.mix(d),
    "shard": lambda d: sharding.shard(d, 64),
    "pii": lambda d: pii.find_personal_data(d, pii.fit_tagger(d, epochs=1)),
    "language": lambda d: language_id.identify_language(d, language_id.fit_languages(d)),
    "sentencepiece": lambda d: sentencepiece.encode_documents(d, PIECES),
    "rules": lambda d: quality_rules.quality_rules(d, quality_rules.LineCrf()),
    "lines": lambda d: line_dedup.dedup_lines(d),
    "classifier": lambda d: quality_classifier.quality_score(d, quality_classifier.fit_quality(d, _labels(d))),
    "jaccard": lambda d: jaccard_join.jaccard_classes(d),
}


def _labels(d):
    return d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))


@pytest.mark.parametrize("op", OPS)
def test_every_row_comes_back(spark, op):
    d = rows(spark)
    out = OPS[op](d).collect()
    assert len(out) == d.count()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in d.collect())


@pytest.mark.parametrize("op", OPS)
def test_empty_table(spark, op):
    assert OPS[op](rows(spark).where("false")).count() == 0


def test_defined_results(spark):
    d = rows(spark)
    get = lambda df: {(r.doc_id, r.text): r for r in df.collect()}
    lang = get(OPS["language"](d))
    assert lang[2, None].lang_pred == lang[3, ""].lang_pred == lang[4, " \n\t "].lang_pred == "und"
    rules = get(OPS["rules"](d))
    assert rules[2, None].base_failed and not rules[2, None].kept and rules[5, LONG].n_words == 13 * 4000 + 1 and rules[5, LONG].base_failed
    enc = get(OPS["sentencepiece"](d))
    assert all(r.round_trip for r in enc.values()) and enc[2, None].n_tokens == 0
    assert enc[5, LONG].n_tokens > 40_000
    mixed = get(OPS["mix"](d))
    assert mixed[2, None].size == 0 and all(len(r.places) <= 3 or r.size == 0 for r in mixed.values())
    assert get(OPS["pii"](d))[5, LONG].base[0].kind == "ip"
    comp = {r.doc_id: r for r in OPS["jaccard"](d).where("doc_id is not null").collect()}
    assert comp[1].component_id == comp[6].component_id == 1 and comp[2].component_id == 2 and comp[4].n_shingles == 0
    out = line_dedup.dedup_lines(d).where("doc_id = 6").first()
    assert out.text == "" and out.n_removed == 1
    assert line_dedup.dedup_lines(d).where("doc_id = 1 and n_removed = 0").count() == 2


def test_topk_edges(spark):
    nan = float("nan")
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.5]), (20, [-1.0, 0.5]), (7, []), (8, [2.0])]
    v = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").select("vec_id", topk_search.quantized("embedding").alias("v"), F.lit(1).alias("key"))
    got = [tuple(r) for r in topk_search.top_k(v, F.col("vec_id") == 0, 3).orderBy("rank").collect()]
    assert got == [(0, 1, 8, 8192), (0, 2, 1, 4096), (0, 3, 2, 4096)]
    every = topk_search.top_k(v, F.col("vec_id") == 0, 50).count()
    assert every == 6
    assert topk_search.top_k(v.where("false"), F.col("vec_id") == 0).count() == 0


def test_ties_and_hot_vectors(spark):
    v = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 7), F.lit(1)).cast("array<bigint>").alias("v"))
    got = topk_search.top_k(v, F.col("vec_id") % 20 == 0, 5).collect()
    data = {r.vec_id: r.v for r in v.collect()}
    for q in range(0, 400, 20):
        want = sorted(((-sum(a * b for a, b in zip(data[q], data[i])), i) for i in data if i != q))[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_workers_take_batches_in_parts(spark):
    """A worker makes lists of few rows at a time, however many a batch has, and every row comes out."""
    import pyarrow as pa

    from journeyspark.llm.common import sliced
    from journeyspark.llm.quality_rules import LineCrf, quality_rules

    b = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    parts = list(sliced([b, b.slice(0, 0), b.slice(5, 3)]))
    assert max(p.num_rows for p in parts) <= 256 and [x for p in parts for x in p["x"].to_pylist()] == [*range(1000), 5, 6, 7]
    docs = spark.range(700).selectExpr("id as doc_id", "concat('words of text ', id) as text").coalesce(1)
    assert sorted(r.doc_id for r in quality_rules(docs, LineCrf()).collect()) == list(range(700))


def test_jaccard_writes_the_first_shingles_once(spark, monkeypatch):
    """They are the bulk of what a join leaves on disk."""
    seen, real = [], jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: (seen.append(df.columns), real(df, name))[1])
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:58]), " ".join(words), " ".join(reversed(words)), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(docs, k=3, percent=90).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4} and sum("firsts" in c for c in seen) == 1

"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing to target weights, SentencePiece.

Every stage takes any rows with the columns of documents, extra columns of any name included, which stay; an empty table
gives an empty result. What a stage does with nulls, empty and repeated rows is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from journeyspark.llm.common import renamed, table, written
from journeyspark.llm.jaccard_join import jaccard_classes
from journeyspark.llm.line_dedup import dedup_lines
from journeyspark.llm.mixing import mix, mixed_documents
from journeyspark.llm.quality_rules import fit_lines, quality_rules
from journeyspark.llm.sentencepiece import encode_documents

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject; null, empty and blank texts are among them. Each row is judged by its text alone, so repeated rows stay or go together, and null ids are rows like others."""
    model = fit_lines(docs, table(spark, sf_dir, "labels"))
    base, name, back = renamed(docs, docs.columns)
    return quality_rules(base, model, text=name["text"]).where("kept").select(*back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete lines that an earlier document has; documents of which nothing is left go. n_chars follows the text.

    Earlier is a smaller id. Rows with a null id or text, empty texts and rows that repeat an id with its text keep their lines
    (the next stage keeps one of the repeated).
    """
    base, name, back = renamed(docs, docs.columns)
    out = dedup_lines(base, text=name["text"], doc_id=name["doc_id"])
    out = out.where((F.col("n_removed") == 0) | (F.trim(name["text"]) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn(name["n_chars"], F.when(F.col("n_removed") > 0, F.length(name["text"])).otherwise(F.col(name["n_chars"])).cast(docs.schema["n_chars"].dataType))
    return out.select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 or more of their five-word shingles, the one with the smallest id stays.

    Rows with a null id count as documents after all others, one for each different text. Of rows that repeat an id with
    its text one stays, the least in the other columns. Texts without words link with nothing and stay.
    """
    base, name, back = renamed(docs, docs.columns)
    text, doc_id = F.col(name["text"]), F.col(name["doc_id"])
    unnamed = F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(1 << 62)  # beyond any id in use
    rows = base.withColumn("key", F.coalesce(doc_id.cast("long"), unnamed)).withColumn("print", F.xxhash64(text, F.length(text)))
    gone = written(jaccard_classes(rows.select("key", text.alias("text")), k=5, percent=80, doc_id="key").where("component_id <> doc_id").select(F.col("doc_id").alias("key")).distinct(), "near-duplicates")
    left = rows.join(gone, "key", "left_anti")
    twice = written(left.groupBy("key", "print").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"), F.col("print").alias("p")), "repeated")
    again = (F.col("key") == F.col("k")) & F.col("print").eqNullSafe(F.col("p"))
    one = left.join(twice, again, "left_semi").groupBy("key", "print").agg(F.min(F.struct(*base.columns)).alias("row")).select("row.*")
    return left.join(twice, again, "left_anti").select(*base.columns).unionByName(one).select(*back)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: a row for each copy, shuffled within their shards. A null source is a source; rows equal in id, text and source are taken together."""
    base, name, back = renamed(docs, docs.columns)
    mixed = mix(base, text=name["text"], source=name["source"], doc_id=name["doc_id"])
    return mixed_documents(mixed, base.columns).select(*back)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document of the mix, a row for each row; null and empty texts have none."""
    return encode_documents(docs.select("doc_id", "source", "text"), PIECES).select("doc_id", "source", "n_tokens", "round_trip", "token_ids")


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mix", mixture),
    ("sentencepiece", tokens),
]

#: No stage's model or alignment can be written in SQL; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before it has written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs

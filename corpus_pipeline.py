"""A corpus pipeline of the operators in docmill.llm.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents; the last
one returns (doc_id, n_tokens, ids_sha256, decoded_sha256). Between stages the rows are written as Parquet and read again.

Cases: nulls, empty texts, repeated rows, empty tables and extra columns are treated as each operator states; rows with a null
id are kept as rows of their own, except that equal texts are near duplicates whatever their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import _base, bpe, mixing, simhash, substrings, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the threshold; the model is fitted on the labels of these documents."""
    model = toxicity.train(docs, _base.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(~F.col("is_toxic")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id."""
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that also occur elsewhere; documents of which nothing is left go."""
    cleaned = substrings.deduplicate(docs)
    left = cleaned.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumns({"text": text, "n_chars": n_chars}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources say."""
    return mixing.expand(mixing.mix(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The first stage is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = _base.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = _base.settle(docs, f"stage{i}")
    return docs

"""A corpus pipeline: from raw documents to token ids, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``.  All but the last return the columns of ``docs``.  No stage
reads anything else, so an empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import exact_dedup, langid, minhash, mixing
from reviewloom.llm.common import keep, whole_row
from reviewloom.llm.queries import bpe_digests


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, however sure it is: short and mixed texts stay.

    All with letters, where no row is labelled.
    """
    model = langid.train(docs)
    found = docs.select(whole_row(docs), langid.identify(model, spark, F.col("text")).alias("found"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return found.where(F.col("found.lang_pred") != langid.UNDETERMINED).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return exact_dedup.exact_dedup(docs)[1]


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal texts, the row with the smallest id."""
    return minhash.kept_rows(docs, minhash.near_dedup(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.repeated(mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each document, the number of tokens and digests of the ids and of what they decode to."""
    return bpe_digests(docs)


STAGES = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("mix", mix),
    ("tokens", tokens),
]

# SQL expresses neither the trained model nor signatures and tokens; tests hold the rows
# against the stages done by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to encoded training text.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written as
Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import line_dedup, mixing, quality_rules, simhash, unigram_pieces
from kinweave.llm.common import table
from kinweave.llm.queries import MODEL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that weak supervision over the quality rules keeps."""
    return quality_rules.keep_quality(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten different documents or more go.

    Documents whose fingerprints are equal or linked, directly or not, count as one: the next stage keeps one of them, and
    a text of which there are ten copies would otherwise lose every line. No other document keeps a frequent line.
    """
    docs = docs.select(*COLUMNS)
    groups = table(simhash.near_duplicates(docs).select(F.col("fp").alias("g"), "root").distinct(), "groups")
    counts = line_dedup.line_counts(docs, group_of=simhash.fingerprints_of, groups=groups)
    out = line_dedup.line_dedup(docs, min_docs=10, counts=counts)
    return out.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest id."""
    return simhash.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the tempered weights of their sources say."""
    return mixing.realise(mixing.mix(docs.select(*COLUMNS)), COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return unigram_pieces.encode(docs, MODEL)


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near_copies), ("source mixing", mixture), ("sentencepiece tokens", tokens)]

#: EM, SimHash and the exponent's bisection have no SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, name.replace(" ", "-"))
    return docs

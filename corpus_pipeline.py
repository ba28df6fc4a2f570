"""The corpus pipeline: from raw documents to token ids, in five stages that each call one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs is what its predecessor kept, written as
Parquet and read again. All stages but the last return the columns of documents, whole rows of what they were given.

In every stage null texts count as empty ones, extra columns of any name pass, and an empty table gives an empty one.
Rows that repeat an id and a text leave the second stage as one; rows with null ids stay unless an equal or
like text with an id does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.llm import bpe, decontaminate, exact_dedup, quality, simhash
from lynceus.llm.common import table
from lynceus.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 7), fitted on labels of these documents, doesn't reject; equal texts share a fate."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each different text (operator 9): the one with the smallest id, or one without an id if there is no other."""
    return exact_dedup.drop_duplicates(docs)


def keep_unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 5): the one with the smallest id. Texts without words are alike."""
    return simhash.drop_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs (operator 10); an empty benchmark has none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (operator 6), with digests of them and of the text that they decode to; empty texts have none."""
    coded = bpe.encode_and_decode(docs, tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_first_copies),
    ("simhash near dedup", keep_unlike),
    ("benchmark decontamination", keep_uncontaminated),
    ("bpe encoding and decoding", tokenize),
]

#: The classifier and the fingerprints can't be written in SQL; tests/llm/test_entry.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents under sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, f"stage{k}")
    return docs

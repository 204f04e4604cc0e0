"""From raw documents to token ids: toxic documents go, near copies go, repeated passages are cut, sources are mixed to
target weights, and what is left is encoded. Each stage is written as Parquet and read again by the next one.

Every stage keeps rows with a null id or null text in so far as its operator's module says, keeps all columns whatever their
names (but for the last, which returns its own four), takes equal rows as its operator does, and gives no rows for an empty
table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm import bpe, jaccard, mixing, suffix, toxicity
from lumenspark.llm.shared import new_folder, remove
from lumenspark.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. It learns from the labels of documents at hand."""
    ship_package(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of a similarity of 0.8 or more on five-word shingles connect."""
    ship_package(spark)
    return jaccard.drop_near_duplicates(docs, 5, 80, 100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that a document of a smaller id has."""
    ship_package(spark)
    out = suffix.cut_repeats(docs)
    length = F.length("text").cast("long")
    return out.withColumn("n_chars", F.when(length < F.col("n_chars"), length).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and token ids of every document."""
    ship_package(spark)
    coded = bpe.encode_documents(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL can express neither the classifier nor BPE; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's table goes once the next one is written; the last one's input stays, as its result is lazy."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Every stage calls one operator of ``clickloom.llm`` on all rows that the stage before it kept. All but the last return the
columns of ``documents``; extra columns, whatever their names, are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import mixing, ngram_join, pieces, pii, toxicity
from clickloom.llm.words import small_batches
from clickloom.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the model trained on the table of labels scores below 0.5 stay; null and empty texts score 0."""
    small_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct("*").alias("row"), toxicity.toxicity(spark, model, "text").alias("tox"))
    return rows.where("tox.score < 0.5").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 the one with the smallest id stays."""
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text become their kind in brackets; ``n_chars`` is counted anew. A null text stays null."""
    small_batches(spark)
    hidden = docs.withColumn("text", pii.masked(spark, pii.train(docs)))
    return hidden.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows the mix takes, twice where it takes them twice. Texts without words are in no mix."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of each text."""
    small_batches(spark)
    own = docs.select("doc_id", "lang", "source", pieces.coded(spark, pieces.load(), decoded=False).alias("own"))
    return own.select("doc_id", "lang", "source", F.size("own.ids").cast("long").alias("n_ids"), F.col("own.ids").alias("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can't express a trained model or the best path of pieces; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

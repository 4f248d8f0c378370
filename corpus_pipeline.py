"""The corpus pipeline: documents through five stages, each written and read again.

Every stage but the last returns the columns of documents and keeps every row that it does
not reject; what it changes in a text shows in n_chars.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalsieve.llm import line_templates, packing, quality_classifier, secrets, simhash
from evalsieve.scale import settle


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_good(docs, labels)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, by the rule of `op5_line_templates`.

    Every row stays, also one of which nothing is left; a null text stays null, equal rows are
    cut alike, and an empty table gives an empty one.
    """
    return _counted(line_templates.drop_recurring(docs, name="_llm_dropped")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of `op7_simhash`: three-word shingles, two bits.

    Texts without words, null ones among them, are one group. Of equal rows one stays, a null
    doc_id ranks first, and an empty table gives an empty one.
    """
    return simhash.one_of_each(docs, words=3, radius=2)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return _counted(secrets.mask_secrets(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' tokens as pieces of sequences of 4096."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(settle(packing.token_pieces(docs, path, with_ids=False)))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", pack),
]
#: Most stages cannot be written in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs

"""A pipeline from documents to packed sequences. Counted as part of the subpackage of text operators.

1. language: documents without a language go. 2. exact: of equal texts, one stays. 3. near: of each component of near-duplicates (5-word
shingles, Jaccard similarity 0.8 or more), one stays. 4. secrets: secrets are masked; every document stays. 5. packing: token sequences of what is left.

Null text has no language and goes in the first stage. Repeated rows are copies: one stays. Extra columns are carried to the last stage,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logstrata.llm import exact_dedup, language, packing, secrets, simhash
from logstrata.llm.common import documents, shared_folder


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.representatives(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", by_language), ("exact", exact), ("near", near), ("secrets", masked), ("packing", packed)]

#: SQL can't express the language network, the fingerprints' components or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written to the session's shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # the next stage reads this one's rows only
            place = spark._jvm.org.apache.hadoop.fs.Path(before)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        before = path
    return docs

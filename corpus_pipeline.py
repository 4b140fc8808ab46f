"""A training-corpus pipeline of five operators; each stage is written as Parquet and read again as the next one's docs.

1. quality: documents that the classifier rejects go.
2. near_duplicates: of each class of the n-gram Jaccard join the document with the smallest id stays (one row of it).
3. secrets: secrets in texts are replaced by a mark, and n_chars follows.
4. mixture: sources are mixed to their target weights; a document taken twice stands there twice, one not taken goes.
5. tokens: every remaining row encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256.

Rows with a null text or id pass like others: a null text is an empty one (and rejected by stage 1), null ids are no
duplicates of one another. Very long texts pass whole through every stage. Extra columns of documents are kept up to the last
stage, whatever their names; that one reads id and text only. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import jaccard_join, mixture, quality, secret_scan, sentencepiece_codec
from shelfspark.llm.common import ensure_checkpoint_dir, labels
from shelfspark.llm.queries import tokenizer_model


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, labels(spark, sf_dir)))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # class ids are ids of the class; rows that repeat an id: one of them, whichever has the smallest text hash. Only ids and
    # hashes are grouped, so texts are shuffled once, by the keys of the join, and rows alike are already together when folded
    classes = jaccard_join.join(docs).where("doc_id = class_id").select("doc_id").distinct()
    key = ["doc_id", "h"]
    marked = docs.select("doc_id", F.xxhash64("text", "source", "lang").alias("h"), F.struct(*docs.columns).alias("row"))
    first = marked.groupBy("doc_id").agg(F.min("h").alias("h")).join(classes, "doc_id")
    kept = marked.join(first, key).dropDuplicates(key).unionByName(marked.where("doc_id IS NULL"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # by ranges of shard and order: a shard's rows stand together, in its shuffle, and large shards have many tasks
    place = ["mix_shard", "mix_order"]
    mixed = mixture.assign(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")).repartitionByRange(*place).sortWithinPartitions(*place)
    return mixed.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(docs, tokenizer_model())


STAGES = [("quality", keep_quality), ("near_duplicates", one_of_each_class), ("secrets", without_secrets), ("mixture", to_target_weights), ("tokens", tokens)]
#: Trained classifiers, a randomised join and a subword model are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what passes between them is in the shared folder of spark.checkpoint.dir."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The document pipeline: quality, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before it kept, and returns a DataFrame;
all but the last return the columns of ``documents``. ``run`` writes each stage's result in the shared folder as
Parquet and reads it again as the next one's input; a table is deleted once the stage after it is written, the last one
too, since the result is a checkpoint.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpweave.llm import decontaminate, nearby, packing, pii, quality
from corpweave.session import cut, removed, shared_dir, ship

#: The key of the pseudonyms; a real run takes its own from a secret store.
PII_KEY = "corpus pipeline, not a secret"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; it learns from labels of documents not held out."""
    ship(spark)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = quality.learn(docs.where(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score_column(F.col("text"), model) >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Texts are linked whose SimHash fingerprints of five-word shingles differ in thirteen bits or fewer, and whose sets of
    these shingles have an exact Jaccard similarity of 0.8 or more."""
    ship(spark)
    return nearby.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With pseudonyms for personal data; n_chars follows the text."""
    done = pii.pseudonymised(docs, PII_KEY)
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else done


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    ship(spark)
    pieces = packing.tokenised(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", pseudonymise),
    ("packing", pack),
]

#: No stage but the third can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    at, before = f"{shared_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            docs, now = cut(out), at
        else:
            out.write.parquet(now := f"{at}/{k}-{name}")
            docs = spark.read.parquet(now)
        if before:
            removed(spark, before)
        before = now
    removed(spark, at)
    return docs

"""The corpus pipeline: language identification, quality, near-duplicates and packing over the documents table.

Each stage takes all that the one before it kept, is written as Parquet and read again; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balancebeam.llm import langid, packing, quality, shingles
from balancebeam.llm.common import shared_folder, workers_import

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised with a calibrated score; a document without letters goes."""
    workers_import(spark)
    return langid.predict(docs, langid.fit(docs)).where(~F.col("rejected")).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality classifier accepts."""
    workers_import(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates: a Jaccard similarity of at least 0.8 over five-word shingles.

    Candidates are what the SimHash trie links within two bits, and what shares a MinHash band; whole sets decide.
    """
    workers_import(spark)
    return shingles.dedup(docs, budget=2).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    workers_import(spark)
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language ID", language), ("quality classifier", good_quality), ("SimHash near-dedup", one_of_each), ("packing", packed)]
ORACLE_SQL = None  # trained models, XXH64 shingles and token ids are beyond SQL; tests/llm holds brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

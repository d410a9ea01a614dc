"""The corpus pipeline over `documents`: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. doc_id is the key: of rows that repeat it one stays from the second stage on. Rows
without an id are judged by what they hold where a stage judges single texts (1, 4 and 5); where
documents are compared (2 and 3) they are compared with nothing and stay as they are. Null and empty
texts have no language and go in the first stage; later stages keep them. Other columns may be null.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airledger.llm import bpe, decontamination, language, minhash, suffixes
from airledger.llm.shared import read_table, shared_folder

#: Fit above which the learned languages explain a document: 0 is that of n-grams of equal chances.
LEAST_FIT = 0.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those whose mixture of learned languages explains them no
    better than chance; the model is learned from all documents that name their language."""
    model = language.learn(docs)
    found = language.identify(docs.withColumn("row", F.struct(*docs.columns)), model, "row")
    return found.where((F.col("lang_pred") != "und") & (F.col("fit") > LEAST_FIT)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8 or more) the smallest doc_id stays,
    and of rows that repeat it the one of the smallest text."""
    kept = minhash.near_duplicates(docs, words=5).where("kept").select("doc_id").distinct()
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    firsts = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("row")).select("doc_id", "row.*")
    return firsts.select(docs.columns).union(docs.where("doc_id is null"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut bytes covered by 100-byte strings that start earlier; documents of which nothing is left go."""
    kept = suffixes.remove_repeats(docs.where("doc_id is not null"), keep_text=True).where("n_bytes = 0 or n_removed < n_bytes").select("doc_id", F.col("kept_text").alias("text"))
    rest = docs.drop("text", "n_chars").join(kept, "doc_id").withColumn("n_chars", F.length("text").cast("long"))
    return rest.select(docs.columns).union(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of ten words of a benchmark item."""
    keyed = docs.withColumn("key", F.struct("doc_id", F.xxhash64("text")))
    hit = decontamination.contamination(keyed, read_table(spark, sf_dir, "benchmark"), id_col="key").where("contaminated").select("key").distinct()
    return keyed.join(hit, "key", "left_anti").select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to."""
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return coded.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("decontaminate", decontaminate), ("tokenise", tokenise)]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each result written as Parquet and read again by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

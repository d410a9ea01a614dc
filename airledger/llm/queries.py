"""The registered queries of the numbered operators, each over its whole table, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, conversations, decontamination, language, licences, minhash, packing, projection, pseudo_likelihood, quality, suffixes, warc
from .ngrams import held_out
from .shared import read_table, shared_folder


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned from the labelled rows that are not held out."""
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.learn(documents, labels.where(~held_out("doc_id", 3, 1)))
    scored = quality.score(documents.withColumn("row", F.struct("doc_id", held_out("doc_id", 3, 1).alias("held_out"))), model, "row")
    return scored.select("row.doc_id", "row.held_out", "score", "predicted")


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known licence that every document, and lines of it, are in canonical form."""
    return licences.scan(read_table(spark, sf_dir, "documents")).withColumn("line_licences", F.concat_ws(",", "line_licences"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.9 or more."""
    return projection.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every document's mixture, learned from the rows that are not held out."""
    documents = read_table(spark, sf_dir, "documents")
    model = language.learn(documents.where(~held_out("doc_id", 5, 0)))
    found = language.identify(documents.withColumn("row", F.struct("doc_id", held_out("doc_id", 5, 0).alias("held_out"))), model, "row")
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", "languages", "shares", "fit")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 2-word shingles have similarity 0.8 or more."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=2)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a string of 100 bytes covers which also starts earlier."""
    return suffixes.remove_repeats(read_table(spark, sf_dir, "documents"))


def op7_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to ZIP-packaged WARC archives in the shared folder, and read back."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    return warc.read_archives(warc.write_archives(read_table(spark, sf_dir, "pages"), folder)).drop("payload", "url")


def op8_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document encoded by the many-language vocabulary, and decoded again."""
    ranks = bpe.read_ranks(spark, vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return coded.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summed conditional log-probability of the tokens of every document."""
    documents = read_table(spark, sf_dir, "documents")
    return pseudo_likelihood.score(documents, pseudo_likelihood.train(documents))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of ten consecutive words of a benchmark item."""
    found = decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("items", "hits")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every document as pieces of at most 1,024 ids, packed into as few sequences as best-fit decreasing needs."""
    pieces = packing.cut(read_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("token_ids")).drop("token_ids"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """Groups and links of two tokenizers' tokens over every document."""
    return alignment.align(read_table(spark, sf_dir, "documents"), byte_level or public_tokenizers.path("byte_bpe_50k.json"), pieces or public_tokenizers.path("piece_bpe_32k.model"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    rows = read_table(spark, sf_dir, "conversations")
    found = conversations.repair(conversations.damage(rows)).withColumnRenamed("conv_id", "of")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return every.select("conv_id", *[F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns if c != "of"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_classifier, op2_licence_scan, op3_embedding_near_dedup, op4_language_id, op5_minhash_near_dedup, op6_suffix_dedup, op7_warc_archives, op8_byte_bpe, op9_masked_pseudo_likelihood, op10_benchmark_decontamination, op11_best_fit_packing, op12_cross_tokenizer_alignment, op13_conversation_repair]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_licence_scan": licences.oracle_sql()}
